"""Input preparation for the load table (PRE1-PRE4).

The reference receives its table with these columns already made; the
driver tables do not have them, so they are derived here:

* ``hourly``: bucket events to a regular series (one partial + final agg).
* ``calendar``: dow, doy, day, month, hour, minute.
* ``lag_by_time``: the value h hours earlier, matched on time, not row
  position, so gaps in the series give nulls instead of wrong values.
* ``asof_join``: the latest right row at or before each left row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from kilowatt.functions.calendar import calendar_columns, truncate
from kilowatt.operators.partitioning import materialize


def hourly(
    df: DataFrame,
    ts: str,
    value: str,
    keys: Sequence[str] = (),
    out_ts: str = "hour_ts",
    out_value: str = "load",
    unit: str = "hour",
) -> DataFrame:
    """Sum ``value`` per (keys, hour); also the number of rows, ``n_events``.

    Sum and count combine map-side, so a key holding a third of all rows
    still sends one row per (key, hour) and partition to the shuffle.
    """
    return df.groupBy(*keys, truncate(ts, unit).alias(out_ts)).agg(
        F.sum(value).alias(out_value), F.count(F.lit(1)).alias("n_events")
    )


#: Periods of one piece of a key's grid.
GRID_PIECE = 4_096


def regular(series: DataFrame, ts: str, value: str, keys: Sequence[str] = (), unit: str = "hour", fill: float | None = 0.0,
            counts: Sequence[str] = ()) -> DataFrame:
    """series with a row for every period between the first and the last of each
    key: (keys, ts, value, counts).

    A period without a row has the value ``fill`` (None: null), and 0 in the
    columns ``counts``. ``series`` has one row per (keys, ts), as :func:`hourly`
    gives. A key's grid is made in pieces of GRID_PIECE periods that are dealt
    out before they are filled in, so one key over many years is not one task.
    Rows with a null time are left out; a null key is a key of its own.
    """
    step = F.expr(f"INTERVAL 1 {unit}")
    piece = F.expr(f"INTERVAL {GRID_PIECE} {unit}")
    own = series.where(F.col(ts).isNotNull()).select(*keys, ts, value, *counts)
    ends = own.groupBy(*keys).agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    # without keys an empty series has one row of nulls
    begun = ends.where("first IS NOT NULL").select(*keys, "last", F.explode(F.sequence("first", "last", piece)).alias("begin")).repartition(*keys, "begin")
    upto = F.least(F.col("last"), F.col("begin") + piece - step)
    grid = begun.select(*keys, F.explode(F.sequence(F.col("begin"), upto, step)).alias(ts))
    empty = grid.select(*keys, ts, F.lit(None).cast(own.schema[value].dataType).alias(value), *[F.lit(None).cast(own.schema[c].dataType).alias(c) for c in counts], F.lit(0).alias("there"))
    # one shuffle on (keys, time): a grid row and at most one of the series meet
    met = empty.unionByName(own.withColumn("there", F.lit(1))).groupBy(*keys, ts).agg(
        F.max("there").alias("there"), F.max(value).alias(value), *[F.max(c).alias(c) for c in counts])
    filled = F.when(F.col("there") == 1, F.col(value)).otherwise(F.lit(fill))
    return met.select(*keys, ts, filled.alias(value), *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def calendar(df: DataFrame, ts: str) -> DataFrame:
    """Add dow (1 = Sunday), doy, day, month, hour, minute of ``ts``."""
    return df.select("*", *calendar_columns(ts))


def lag_by_time(
    series: DataFrame,
    ts: str,
    value: str,
    hours: Sequence[int] = (24, 48),
    keys: Sequence[str] = (),
    prefix: str = "t_m",
) -> DataFrame:
    """Add ``{prefix}{h}``: ``value`` at ``ts - h hours`` for the same keys.

    ``series`` must have one row per (keys, ts), as :func:`hourly` gives.
    Instead of one join per lag, each row is exploded into itself plus one
    copy per offset (moved forward by h), and all copies meet in a single
    aggregation on (keys, ts): one scan and one shuffle whatever the number
    of lags, each group at most ``1 + len(hours)`` rows, so no key can blow
    up a task. Hours with no row h hours earlier get null (gaps stay gaps).
    """
    keys = list(keys)
    row = F.struct(*[F.col(c) for c in series.columns])
    v = F.col(value).cast("double")
    # as in an equi-join on the keys, a null key matches nothing: its
    # shifted copies carry no value
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    copies = [F.struct(F.col(ts).alias("t"), F.lit(0).alias("h"), v.alias("v"), row.alias("row"))]
    for h in hours:
        copies.append(F.struct(
            (F.col(ts) + F.make_dt_interval(F.lit(0), F.lit(int(h)))).alias("t"), F.lit(int(h)).alias("h"),
            F.when(keyed, v).alias("v"),
            F.lit(None).cast(series.select(row.alias("r")).schema["r"].dataType).alias("row"),
        ))
    exploded = series.select(*keys, F.explode(F.array(*copies)).alias("__c"))
    aggs: list[Column] = [F.max(F.when(F.col("__c.h") == 0, F.col("__c.row"))).alias("__row")]
    aggs += [F.max(F.when(F.col("__c.h") == h, F.col("__c.v"))).alias(f"{prefix}{h}") for h in hours]
    grouped = exploded.groupBy(*keys, F.col("__c.t").alias("__ts")).agg(*aggs).where(F.col("__row").isNotNull())
    return grouped.select("__row.*", *[f"{prefix}{h}" for h in hours])


def _epoch_seconds(df: DataFrame, ts: str) -> Column:
    kind = df.schema[ts].dataType
    if isinstance(kind, TimestampNTZType):
        return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")
    if isinstance(kind, TimestampType):
        return F.col(ts).cast("long")
    return F.col(ts).cast("long")


#: A list of up to so many hot buckets is sent to every task; a longer one is joined by a shuffle.
BROADCAST_BUCKETS = 200_000


def asof_join(
    left: DataFrame,
    right: DataFrame,
    left_ts: str,
    right_ts: str,
    keys: Sequence[str] = (),
    right_cols: Sequence[str] | None = None,
    tiebreak: str | None = None,
    bucket_seconds: int = 3_600,
    prefix: str = "",
    max_bucket_rows: int = 4_000_000,
) -> DataFrame:
    """Left join each left row to the latest right row with the same keys
    and ``right_ts <= left_ts``. Left rows without one get nulls.

    Plan (no per-key window, so a hot key cannot land in one task):

    1. Both sides get a time bucket ``floor(epoch / bucket_seconds)``. One
       partial aggregation over both gives every (keys, bucket) its number of
       rows and its last right row. Buckets of more than ``max_bucket_rows``
       rows are cut into ``ceil(rows / max_bucket_rows)`` equal time slices,
       and for these the last right row of each slice is found again. Bucket
       ids stay in time order.
    2. The last right row is carried forward to the following buckets by a
       window over that summary, which has one row per (key, bucket)
       whatever the data volume.
    3. Left rows, right rows and one carried-in row per (keys, bucket)
       are shuffled once on (keys, bucket) and ordered in time; the last
       right payload seen so far is each left row's match. Right rows
       come first at equal times (``at or before``); among right rows at
       one time the largest ``tiebreak`` wins.

    Rows with a null key or time match nothing: right ones are left out, left
    ones go around the plan and come back with nulls, so they never meet in
    a task. The largest task holds one key's rows for one time slice: about
    ``max_bucket_rows`` unless many rows share one timestamp.
    """
    keys = list(keys)
    right_cols = list(right_cols) if right_cols is not None else [
        c for c in right.columns if c not in keys and c != right_ts
    ]
    payload_cols = [right_ts] + [c for c in right_cols if c != right_ts]
    tb = F.col(tiebreak) if tiebreak else F.lit(0)
    width = int(bucket_seconds)

    def usable(ts: str) -> Column:
        found = F.col(ts).isNotNull()
        for k in keys:
            found = found & F.col(k).isNotNull()
        return found

    def bucketed(df: DataFrame, ts: str) -> DataFrame:
        return df.where(usable(ts)).withColumn("__e", _epoch_seconds(df, ts)).withColumn("__b0", F.floor(F.col("__e") / width))

    payload = F.struct(*[F.col(c).alias(f"{prefix}{c}") for c in payload_cols])
    lx = bucketed(left, left_ts).select(*keys, "__e", "__b0", F.col(left_ts).alias("__t"), F.struct(*[F.col(c) for c in left.columns]).alias("__l"))
    rx = bucketed(right, right_ts).select(*keys, "__e", "__b0", F.col(right_ts).alias("__t"), tb.alias("__tb"), payload.alias("__r"))
    left_type, payload_type, tb_type = lx.schema["__l"].dataType, rx.schema["__r"].dataType, rx.schema["__tb"].dataType

    # (1) rows, wish for a match, and last right row of every (keys, bucket)
    def summarised(lefts: DataFrame, rights: DataFrame, bucket: str) -> DataFrame:
        both = lefts.select(*keys, bucket, F.lit(None).cast(rx.schema["__t"].dataType).alias("__t"), F.lit(None).cast(tb_type).alias("__tb"),
                            F.lit(None).cast(payload_type).alias("__r"), F.lit(True).alias("__want")).unionByName(
            rights.select(*keys, bucket, "__t", "__tb", "__r", F.lit(False).alias("__want")))
        return both.groupBy(*keys, bucket).agg(
            F.count(F.lit(1)).alias("__n"), F.bool_or("__want").alias("__want"),
            F.max_by("__r", F.when(F.col("__r").isNotNull(), F.struct("__t", "__tb"))).alias("__last"))

    per = materialize(summarised(lx, rx, "__b0"))
    hot = per.where(F.col("__n") > int(max_bucket_rows)).select(
        *keys, "__b0", F.ceil(F.col("__n") / F.lit(int(max_bucket_rows))).alias("__k"))
    n_hot = hot.count()
    shift = F.lit(1 << 20)  # bucket id: coarse bucket * 2^20 + time slice in it
    if n_hot:
        told = F.broadcast(hot) if n_hot <= BROADCAST_BUCKETS else hot
        piece = F.floor((F.col("__e") - F.col("__b0") * width) * F.col("__k") / width)

        def sliced(df: DataFrame) -> DataFrame:
            return df.join(told, on=[*keys, "__b0"], how="left").withColumn(
                "__b", F.col("__b0") * shift + F.coalesce(piece, F.lit(0)))

        lx, rx = sliced(lx), sliced(rx)
        cold = per.join(told.select(*keys, "__b0"), [*keys, "__b0"], "left_anti").withColumn("__b", F.col("__b0") * shift)
        again = summarised(lx.where(F.col("__k").isNotNull()), rx.where(F.col("__k").isNotNull()), "__b")
        columns = [*keys, "__b", "__want", "__last"]
        summary = cold.select(*columns).unionByName(again.select(*columns))
    else:
        lx, rx = (df.withColumn("__b", F.col("__b0") * shift) for df in (lx, rx))
        summary = per.withColumn("__b", F.col("__b0") * shift)

    # (2) carried forward over buckets
    w = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        summary.withColumn("__carry", F.last("__last", ignorenulls=True).over(w))
        .where(F.col("__want") & F.col("__carry").isNotNull())
        .select(
            *keys,
            "__b",
            F.lit(0).alias("__o"),
            F.lit(None).cast(left.schema[left_ts].dataType).alias("__t"),
            F.lit(0).alias("__s"),
            F.lit(None).cast(tb_type).alias("__tb"),
            F.lit(None).cast(left_type).alias("__l"),
            F.col("__carry").alias("__r"),
        )
    )
    rights = rx.select(
        *keys, "__b", F.lit(1).alias("__o"), "__t", F.lit(0).alias("__s"), "__tb",
        F.lit(None).cast(left_type).alias("__l"), "__r",
    )
    lefts = lx.select(
        *keys, "__b", F.lit(1).alias("__o"), "__t", F.lit(1).alias("__s"), F.lit(None).cast(tb_type).alias("__tb"), "__l",
        F.lit(None).cast(payload_type).alias("__r"),
    )
    allrows = carry.unionByName(rights).unionByName(lefts)
    # (3) one shuffle on (keys, bucket); the last payload so far is the match.
    w2 = (
        Window.partitionBy(*keys, "__b")
        .orderBy("__o", "__t", "__s", "__tb")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    matched = allrows.withColumn("__m", F.last("__r", ignorenulls=True).over(w2)).where(F.col("__s") == 1).select("__l", "__m")
    unmatched = left.where(~usable(left_ts)).select(
        F.struct(*[F.col(c) for c in left.columns]).alias("__l"), F.lit(None).cast(payload_type).alias("__m"))
    return matched.unionByName(unmatched).select("__l.*", "__m.*")
