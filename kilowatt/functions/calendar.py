"""Calendar fields of a timestamp, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed names of the reference's calendar features.
CALENDAR_FIELDS = ("dow", "doy", "day", "month", "hour", "minute")


def calendar_columns(ts: Column | str) -> list[Column]:
    """dow (1 = Sunday .. 7), doy, day of month, month, hour, minute."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return [
        F.dayofweek(t).alias("dow"),
        F.dayofyear(t).alias("doy"),
        F.dayofmonth(t).alias("day"),
        F.month(t).alias("month"),
        F.hour(t).alias("hour"),
        F.minute(t).alias("minute"),
    ]


def truncate(ts: Column | str, unit: str = "hour") -> Column:
    """Start of the hour / minute / day / month / year as TIMESTAMP_NTZ.

    Built from the wall-clock fields, so a TIMESTAMP_NTZ input is truncated
    without any time zone: ``date_trunc`` would pass through the session
    zone, where a wall-clock time inside a daylight-saving gap moves by an
    hour. Null stays null.
    """
    t = F.col(ts) if isinstance(ts, str) else ts
    zero = F.lit(0)
    fields = {
        "year": (F.year(t), F.lit(1), F.lit(1), zero, zero),
        "month": (F.year(t), F.month(t), F.lit(1), zero, zero),
        "day": (F.year(t), F.month(t), F.dayofmonth(t), zero, zero),
        "hour": (F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), zero),
        "minute": (F.year(t), F.month(t), F.dayofmonth(t), F.hour(t), F.minute(t)),
    }
    if unit not in fields:
        return F.date_trunc(unit, t).cast("timestamp_ntz")
    y, mo, d, h, mi = fields[unit]
    return F.make_timestamp_ntz(y, mo, d, h, mi, F.lit(0))
