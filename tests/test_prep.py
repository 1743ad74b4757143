"""Hourly series, time lags with gaps, and the as-of join against brute force."""

import datetime as dt
import random

from pyspark.sql import functions as F

from kilowatt.operators.prep import asof_join, calendar, hourly, lag_by_time
from tests.conftest import SF_SMALL


def test_lag_by_time_gap_gives_null(spark):
    base = dt.datetime(2024, 1, 1)
    hours = [0, 1, 2, 24, 26, 48, 49]  # hour 25 and 50 missing
    rows = [(base + dt.timedelta(hours=h), float(h)) for h in hours]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, load double")
    out = {r["ts"]: (r["t_m24"], r["t_m48"]) for r in lag_by_time(df, "ts", "load").collect()}
    assert out[base + dt.timedelta(hours=24)] == (0.0, None)
    assert out[base + dt.timedelta(hours=26)] == (2.0, None)
    assert out[base + dt.timedelta(hours=48)] == (24.0, 0.0)
    assert out[base + dt.timedelta(hours=49)] == (None, 1.0)  # hour 25 missing
    assert len(out) == len(hours)


def test_hourly_and_calendar(spark):
    rows = [(dt.datetime(2024, 3, 3, 5, 59, 59), 1.0), (dt.datetime(2024, 3, 3, 5, 0, 0), 2.0),
            (dt.datetime(2024, 3, 3, 6, 0, 0), 4.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    h = {r["hour_ts"]: (r["load"], r["n_events"]) for r in hourly(df, "ts", "v").collect()}
    assert h == {dt.datetime(2024, 3, 3, 5): (3.0, 2), dt.datetime(2024, 3, 3, 6): (4.0, 1)}
    assert dict(hourly(df, "ts", "v").dtypes)["hour_ts"] == "timestamp_ntz"
    c = calendar(df, "ts").where(F.col("v") == 4.0).first()
    # 2024-03-03 is a Sunday: dow 1 (Sunday = 1 .. Saturday = 7).
    assert (c["dow"], c["doy"], c["day"], c["month"], c["hour"], c["minute"]) == (1, 63, 3, 3, 6, 0)


def _brute_asof(left, right):
    out = {}
    for lid, key, lts in left:
        cands = [(rts, rid) for rid, rkey, rts in right if rkey == key and rts <= lts]
        out[lid] = max(cands)[1] if cands else None
    return out


def test_asof_join_matches_brute_force(spark):
    rnd = random.Random(3)
    base = dt.datetime(2024, 1, 1)
    left = [(i, rnd.randint(0, 3), base + dt.timedelta(minutes=rnd.randint(0, 6000))) for i in range(300)]
    right = [(1000 + i, rnd.randint(0, 3), base + dt.timedelta(minutes=rnd.randint(0, 6000))) for i in range(200)]
    # exact ties between a left and a right time count as "at or before"
    right.append((5000, left[0][1], left[0][2]))
    ldf = spark.createDataFrame(left, "id long, k int, ts timestamp_ntz")
    rdf = spark.createDataFrame(right, "rid long, k int, rts timestamp_ntz")
    for bucket, cap in ((600, 4_000_000), (86_400, 4_000_000), (10**7, 4_000_000), (86_400, 5), (10**7, 7)):
        # small caps force hot buckets to be cut into time slices
        got = {r["id"]: r["rid"] for r in asof_join(ldf, rdf, "ts", "rts", keys=["k"], tiebreak="rid",
                                                     bucket_seconds=bucket, max_bucket_rows=cap).collect()}
        assert got == _brute_asof(left, right), (bucket, cap)


def test_asof_join_hot_key(spark):
    """One key holding most rows still gives exact matches."""
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    hot = ev.withColumn("user_id", F.when(F.col("event_id") % 3 != 0, F.lit(1)).otherwise(F.col("user_id")))
    clicks = hot.where(F.col("event_type") == "click").select("event_id", "user_id", "ts")
    views = hot.where(F.col("event_type") == "view").select(
        "user_id", F.col("ts").alias("vts"), F.col("event_id").alias("vid"))
    got = {r["event_id"]: r["vid"] for r in asof_join(clicks, views, "ts", "vts", ["user_id"], tiebreak="vid",
                                                        bucket_seconds=86_400, max_bucket_rows=3).collect()}
    left = [(r["event_id"], r["user_id"], r["ts"]) for r in clicks.collect()]
    right = [(r["vid"], r["user_id"], r["vts"]) for r in views.collect()]
    assert got == _brute_asof(left, right)


def test_hour_truncation_ignores_session_zone(spark):
    """A wall-clock time inside a daylight-saving gap keeps its own hour."""
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 2, 30), 1.0)], "ts timestamp_ntz, v double")
        got = hourly(df, "ts", "v").first()["hour_ts"]
        assert got == dt.datetime(2024, 3, 10, 2, 0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_daily_panel_reading_is_latest_before_period(spark):
    from kilowatt.plans import forecast as fc

    s = fc.load_series(spark, SF_SMALL, ["user_id"], unit="day", observed="view")
    assert s.where(F.col("obs_ts") > F.col("hour_ts")).count() == 0
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").where(F.col("event_type") == "view")
    # brute force for every (user, day): latest view at or before the day start
    latest = (
        s.select("user_id", "hour_ts").join(ev.select("user_id", "ts"), "user_id")
        .where(F.col("ts") <= F.col("hour_ts")).groupBy("user_id", "hour_ts").agg(F.max("ts").alias("want"))
    )
    joined = s.join(latest, ["user_id", "hour_ts"], "left")
    assert joined.where(~F.col("obs_ts").eqNullSafe(F.col("want"))).count() == 0


def test_asof_join_nulls(spark):
    """Null keys match nothing (as in SQL); a null left time matches nothing;
    right rows with a null time are ignored; every left row is kept."""
    t = dt.datetime(2024, 1, 1, 12)
    left = spark.createDataFrame([(1, 7, t), (2, None, t), (3, 7, None)], "id long, k int, ts timestamp_ntz")
    right = spark.createDataFrame(
        [(10, 7, t - dt.timedelta(hours=1)), (11, None, t - dt.timedelta(hours=1)), (12, 7, None)],
        "rid long, k int, rts timestamp_ntz",
    )
    got = {r["id"]: r["rid"] for r in asof_join(left, right, "ts", "rts", keys=["k"], tiebreak="rid").collect()}
    assert got == {1: 10, 2: None, 3: None}


def test_lag_null_key_matches_nothing(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(None, base, 1.0), (None, base + dt.timedelta(hours=24), 2.0),
            ("a", base, 3.0), ("a", base + dt.timedelta(hours=24), 4.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, load double")
    out = {(r["k"], r["ts"]): r["t_m24"] for r in lag_by_time(df, "ts", "load", keys=["k"]).collect()}
    assert out[("a", base + dt.timedelta(hours=24))] == 3.0
    assert out[(None, base + dt.timedelta(hours=24))] is None
    assert len(out) == 4


def test_asof_join_keeps_left_rows_without_key_or_time(spark):
    """A third of the left rows cannot match; they come back with nulls, around the plan."""
    left = [(i, None if i % 3 == 0 else "k", None if i % 5 == 0 else dt.datetime(2024, 1, 1, i % 24)) for i in range(300)]
    ldf = spark.createDataFrame(left, "id int, k string, ts timestamp_ntz")
    rdf = spark.createDataFrame([(1, "k", dt.datetime(2024, 1, 1, 5)), (2, None, dt.datetime(2024, 1, 1, 1)), (3, "k", None)], "rid int, k string, rts timestamp_ntz")
    for cap in (4_000_000, 3):
        got = {r["id"]: r["rid"] for r in asof_join(ldf, rdf, "ts", "rts", keys=["k"], tiebreak="rid", max_bucket_rows=cap).collect()}
        assert got == {i: 1 if k and t and t.hour >= 5 else None for i, k, t in left}


def test_asof_join_with_a_hot_list_too_long_to_send(spark, monkeypatch):
    from kilowatt.operators import prep

    monkeypatch.setattr(prep, "BROADCAST_BUCKETS", 0)
    left = spark.createDataFrame([(i, "k", dt.datetime(2024, 1, 1, 0, i % 60)) for i in range(200)], "id int, k string, ts timestamp_ntz")
    right = spark.createDataFrame([(i, "k", dt.datetime(2024, 1, 1, 0, i)) for i in range(0, 60, 7)], "rid int, k string, rts timestamp_ntz")
    got = {r["id"]: r["rid"] for r in asof_join(left, right, "ts", "rts", keys=["k"], tiebreak="rid", max_bucket_rows=20).collect()}
    assert got == {i: (i % 60) // 7 * 7 for i in range(200)}
