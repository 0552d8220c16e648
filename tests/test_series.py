"""Pieces of hot series give the rows of one window over each whole series, and share the work."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from corvane.operators import analytics, metrics, series
from corvane.plans import overlay

EVENTS = "/root/testdata/sf0.01/events.parquet"


@pytest.fixture(scope="module")
def samples(spark):
    rnd = random.Random(7)
    rows, at = [], 1_700_000_000
    for i in range(3000):
        at += rnd.choice([1, 1, 5, 300])
        rows.append(("hot" if i % 10 else rnd.choice(["b", "c", None]), at, float(rnd.choice([i, i, 0, 5])), i))
    rows += [("hot", at + 1, 1.0, 9001), ("lone", 5, 2.0, 9002)]
    return spark.createDataFrame(rows, "name string, at long, value double, n int").withColumn("ts", F.timestamp_seconds("at")).drop("at")


def same(a, b):
    columns = sorted(b.columns)
    assert sorted(a.columns) == columns
    return sorted(map(repr, a.select(columns).collect())) == sorted(map(repr, b.select(columns).collect()))


@pytest.mark.parametrize("parts", [1, 13])
def test_range_functions_over_cuts(samples, parts):
    laid = series.pieces(samples, ["name"], parts=parts)
    for seconds in (10, 2000, 10**6):  # shorter and longer than a piece
        assert same(series.increase(laid, seconds), metrics.increase(samples, ["name"], seconds))
        assert same(series.over_time(laid, seconds, "max"), metrics.over_time(samples, ["name"], seconds, "max"))
        assert same(series.changes(laid, seconds), metrics.changes(samples, ["name"], seconds))


def test_one_series_of_all_events_is_shared_out(spark):
    events = overlay.audit(spark.read.parquet(EVENTS)).withColumn("actor_sub", F.lit("one"))
    laid = series.pieces(events, ["actor_sub"], "created_at", ["event_id"], 16)
    sizes = [r["count"] for r in laid.rows.groupBy("_piece").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * median(sizes) and laid.cuts.count() == 15
    assert same(series.pairs(events, 21600, 16), analytics.boundary_pairs(events, 21600))


def test_no_samples(samples):
    laid = series.pieces(samples.limit(0), ["name"])
    assert series.increase(laid, 5).count() == series.changes(laid, 5).count() == 0


def test_ranges_are_merged_from_running_figures(spark, samples):
    """No frame is summed up again for each sample; all aggregates, times before 1970 and samples without a time or value."""
    odd = spark.createDataFrame([("hot", None, 4.0, 1), ("hot", None, 6.0, 2), (None, -70, 3.0, 3), (None, -61, None, 4), (None, -60, 5.0, 5), ("nil", 7, None, 6)], "name string, at long, value double, n int")
    every = samples.unionByName(odd.withColumn("ts", F.timestamp_seconds("at")).drop("at"))
    laid = series.pieces(every, ["name"], "ts", ["n"], 5)
    for seconds in (0, 10, 2000):
        for how in ("max", "min", "sum", "count", "avg"):
            got = series.over_time(laid, seconds, how)
            assert same(got, metrics.over_time(every, ["name"], seconds, how)), (seconds, how)
            assert "specifiedwindowframe(RangeFrame, -" not in got._jdf.queryExecution().optimizedPlan().toString()
