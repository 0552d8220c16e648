"""Counters that only grow, buckets that hold those below, and tables of cells as an expression."""

import datetime as dt

from pyspark.sql import functions as F

from corvane.operators import catalogue, metrics
from corvane.sources import exposition, parsers

AT = dt.datetime(2024, 1, 1, 12)


def minute(m, s=0):
    return AT + dt.timedelta(minutes=m, seconds=s)


def test_counters_and_histograms(spark):
    rows = spark.createDataFrame([(minute(0, 5), "a", 0.3, 2), (minute(0, 50), "a", 5.0, 1), (minute(2), "b", None, 7), (minute(3), "a", 0.5, None)], "ts timestamp, stage string, seconds double, n int")
    got = {(r.ts, r.labels.get("outcome")): r.value for r in catalogue.counter(rows, "x_total", "ts", F.col("n"), outcome=F.col("stage")).collect()}
    assert got == {(minute(0), "a"): 3.0, (minute(2), "b"): 7.0, (minute(3), "a"): 3.0}
    made = catalogue.histogram(rows, "x", "ts", F.col("seconds"), [0.5, 1.0], stage=F.col("stage")).collect()
    assert {r.labels.get("stage") for r in made} == {"a"}
    last = {(r.metric, r.labels.get("le")): r.value for r in made if r.ts == minute(3)}
    assert last == {("x_bucket", "0.5"): 2.0, ("x_bucket", "1"): 2.0, ("x_bucket", "+Inf"): 3.0, ("x_sum", None): 5.8, ("x_count", None): 3.0}


def test_every_metric_of_the_catalogue_is_made_and_exposed(spark):
    searches = spark.createDataFrame([(minute(0), "ok", True, 3, 1, 2), (minute(1), "denied", False, 0, 0, 0)], "ts timestamp, outcome string, fallback boolean, n_results int, n_dropped int, n_windows int")
    timings = spark.createDataFrame([(minute(0), "total", 0.2)], "ts timestamp, stage string, seconds double")
    jobs = spark.createDataFrame([(minute(0), "ingestion", "succeeded"), (minute(0), "publish", "failed")], "ts timestamp, kind string, outcome string")
    docs = spark.createDataFrame([("queued", None, minute(-2))], "status string, queue_published_at timestamp, created_at timestamp")
    flagged = spark.createDataFrame([("query_rate", 2)], "signal string, identities long")
    checked = spark.createDataFrame([("verified", 5), ("missing", 1)], "outcome string, n long")
    made = catalogue.samples(searches, timings, jobs, docs, flagged, checked, F.lit(minute(10)))
    names = {r.metric for r in made.select("metric").distinct().collect()}
    for name, kind, labels in metrics.CATALOGUE:
        own = {n for n in names if n == name or (kind == "histogram" and n in (f"{name}_bucket", f"{name}_sum", f"{name}_count"))}
        assert len(own) == (3 if kind == "histogram" else 1), name
        assert all(set(labels) <= set(r.labels) for r in made.where(F.col("metric").isin(*own)).collect())
    gauges = {r.metric: r.value for r in made.where("metric like '%unpublished%'").collect()}
    assert gauges == {"unpublished_documents": 1.0, "oldest_unpublished_seconds": 720.0}
    last = made.where("metric = 'stage_seconds_bucket'").select(exposition.metric_line(F.col("metric"), F.col("labels"), F.col("value")).alias("value"))
    back = exposition.stage_histograms(exposition.read_exposition(last.union(made.where("metric in ('stage_seconds_sum', 'stage_seconds_count')").select(exposition.metric_line(F.col("metric"), F.col("labels"), F.col("value"))))), "stage_seconds")
    assert {(r.le, r.cum) for r in back.collect()} == {(e, float(e >= 0.2)) for e in [*catalogue.SECONDS, float("inf")]}


def test_grids_as_an_expression_equal_plain_tables(spark):
    grids = [[["a", None, " b\t"], [None, "", " "], [" c", "d|e", "f"]], [[None, ""]], [], [["x"]], [[""], ["late head", "two"]]]
    frame = spark.createDataFrame([(i, g) for i, g in enumerate(grids)], "i int, g array<array<string>>")
    assert {r.i: r.t for r in frame.select("i", parsers.grid_markdown(F.col("g")).alias("t")).collect()} == {i: parsers.table_markdown(g) for i, g in enumerate(grids)}
