"""Windows from panes equal windows of events; sketches stay within their stated errors."""

import bisect
import datetime as dt
import itertools

from pyspark.sql import functions as F

from corvane.operators import panes
from corvane.plans import overlay
from corvane.streaming import jobs

EVENTS = "/root/testdata/sf0.01/events.parquet"


def rows_of(frame, *columns):
    return sorted(map(repr, frame.select(*columns).collect()))


def test_windows_from_panes_equal_copied_events(spark):
    events = overlay.audit(spark.read.parquet(EVENTS)).withColumn("created_at", F.col("created_at").cast("timestamp"))
    for length, slide in (("60 minutes", "5 minutes"), ("24 hours", "6 hours"), ("10 minutes", "10 minutes")):
        kinds = "start", "actor_sub", "attempts", "denied", "denial_ratio"
        got, want = panes.identity_windows(events, length, slide), jobs.windowed_stats(events, length, slide)
        assert rows_of(got, *kinds) == rows_of(want, *kinds)
    plan = panes.identity_windows(events)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") <= 1


def test_distinct_targets(spark):
    rows = [("a", "query", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), f"t{i % 40}") for i in range(2000)] + [("a", "query", dt.datetime(2024, 1, 1, 9), None)]
    events = spark.createDataFrame(rows, "actor_sub string, action string, created_at timestamp, target string")
    got = panes.identity_windows(events, "60 minutes", "5 minutes", "target").orderBy("start").collect()
    assert {r.targets for r in got[:-12]} == {40} and {r.targets for r in got[-12:]} == {0} and sum(r.attempts for r in got) == 12 * len(rows)


def test_the_same_frames_in_streaming(spark, tmp_path):
    source = tmp_path / "events"
    events = overlay.audit(spark.read.parquet(EVENTS)).withColumn("created_at", F.col("created_at").cast("timestamp"))
    at = F.col("created_at").cast("long")
    cuts = [0, *events.select(at.alias("t")).approxQuantile("t", [0.3, 0.6], 0.01), 1 << 40]
    for low, high in itertools.pairwise(cuts):  # files in the order of time
        events.where((at >= low) & (at < high)).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(source)).withWatermark("created_at", "1 hour")
    got = jobs.drained(panes.identity_windows(stream, "2 hours", "1 hour"))
    want = panes.identity_windows(events, "2 hours", "1 hour")
    closed = {repr(r) for r in want.select("start", "actor_sub", "attempts", "denied").collect()}
    found = rows_of(got, "start", "actor_sub", "attempts", "denied")
    assert set(found) <= closed and len(found) == len(set(found)) > 0.9 * len(closed)


def test_rolling_quantiles_stay_within_the_rank_error(spark):
    start = F.timestamp_seconds(F.lit(1_700_000_040) + F.floor(F.col("id") / 50))
    samples = spark.range(120_000).select(F.lit("s").alias("stage"), start.alias("ts"), (F.abs(F.hash("id")) % 100_003 / 7.0).alias("value"))
    qs = [0.5, 0.95, 0.99]
    got = panes.rolling_quantiles(samples, ["stage"], "value", qs).orderBy("start").collect()
    held = sorted((r.ts.timestamp(), r.value) for r in samples.collect())
    worst = 0.0
    for r in got:
        begin = r.start.timestamp()
        values = sorted(v for t, v in held[bisect.bisect_left(held, (begin,)) : bisect.bisect_left(held, (begin + 600,))])
        assert r.n == len(values)
        for q in qs:
            x = r[f"p{round(q * 100)}"]
            low, high = bisect.bisect_left(values, x) / len(values), bisect.bisect_right(values, x) / len(values)
            worst = max(worst, max(low - q, q - high, 0))
    print("worst rank error:", worst)
    assert len(got) > 40 and worst <= panes.KLL_ERROR
