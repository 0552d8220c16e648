"""The samples of every metric of metrics.CATALOGUE, made from the tables that the engine keeps: (ts, metric, labels, value).

Counters and histograms are counted by minute first, so a running total goes over minutes of a series and not over its events. Gauges are read at one time. No label names a person.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the upper edges of histograms, in seconds and in results
SECONDS = [0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0]
RESULTS = [0, 1, 2, 5, 10, 20, 50]


def _labels(**labels: Column) -> Column:
    return F.create_map(*(x for name, c in labels.items() for x in (F.lit(name), c.cast("string")))) if labels else F.create_map().cast("map<string,string>")


def _running(by_minute: DataFrame, by: list[str], value: str) -> Column:
    return F.sum(value).over(Window.partitionBy(*by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)).cast("double")


def counter(rows: DataFrame, metric: str, ts: str, amount: Column | None = None, **labels: Column) -> DataFrame:
    """A total that only grows, at the end of each minute that has rows, for each set of labels. amount: what a row adds (one)."""
    named = rows.select(F.date_trunc("minute", ts).alias("ts"), *(c.alias(f"_{n}") for n, c in labels.items()), (F.lit(1) if amount is None else amount).cast("double").alias("_a"))
    names = [f"_{n}" for n in labels]
    per = named.groupBy("ts", *names).agg(F.sum("_a").alias("_n"))
    return per.select("ts", F.lit(metric).alias("metric"), _labels(**{n: F.col(f"_{n}") for n in labels}).alias("labels"), _running(per, names, "_n").alias("value"))


def histogram(rows: DataFrame, metric: str, ts: str, value: Column, edges: list[float], **labels: Column) -> DataFrame:
    """metric_bucket, metric_sum and metric_count: running numbers of rows at or below each edge, and of all; a row without a value is left out."""
    names = [f"_{n}" for n in labels]
    named = rows.select(F.date_trunc("minute", ts).alias("ts"), *(c.alias(f"_{n}") for n, c in labels.items()), value.cast("double").alias("_v")).where("_v is not null")
    per = named.groupBy("ts", *names).agg(*(F.count_if(F.col("_v") <= e).alias(f"_le{i}") for i, e in enumerate(edges)), F.count("*").alias("_n"), F.sum("_v").alias("_s"))
    own = {n: F.col(f"_{n}") for n in labels}
    edge = [F.struct(F.lit(f"{metric}_bucket").alias("metric"), _labels(**own, le=F.lit(f"{e:g}")).alias("labels"), _running(per, names, f"_le{i}").alias("value")) for i, e in enumerate(edges)]
    every = F.struct(F.lit(f"{metric}_bucket").alias("metric"), _labels(**own, le=F.lit("+Inf")).alias("labels"), _running(per, names, "_n").alias("value"))
    rest = [F.struct(F.lit(f"{metric}_{n}").alias("metric"), _labels(**own).alias("labels"), _running(per, names, c).alias("value")) for n, c in (("sum", "_s"), ("count", "_n"))]
    return per.select("ts", F.array(*edge, every, *rest).alias("_x")).select("ts", F.inline("_x"))


def gauges(values: DataFrame, metric: str, now: Column, value: str, **labels: Column) -> DataFrame:
    return values.select(now.alias("ts"), F.lit(metric).alias("metric"), _labels(**labels).alias("labels"), F.col(value).cast("double").alias("value"))


def samples(searches: DataFrame, timings: DataFrame, jobs: DataFrame, documents: DataFrame, flagged: DataFrame, checked: DataFrame, now: Column) -> DataFrame:
    """All families at once.

    searches (ts, outcome, fallback, n_results, n_dropped, n_windows); timings (ts, stage, seconds); jobs (ts, kind: ingestion or publish, outcome); documents as
    lifecycle.backlog() takes them; flagged (signal, identities) as analytics.flagged_counts() gives; checked (outcome, n) as lifecycle.outcome_counts() does.
    """
    from .lifecycle import backlog

    behind = backlog(documents, now)
    kind = lambda k: jobs.where(F.col("kind") == k)
    parts = [
        counter(searches, "queries_total", "ts", outcome=F.col("outcome")),
        counter(searches.where("fallback"), "rerank_fallbacks_total", "ts"),
        counter(searches, "rerank_windows_total", "ts", F.col("n_windows")),
        counter(searches, "below_floor_total", "ts", F.col("n_dropped")),
        histogram(searches, "results_returned", "ts", F.col("n_results"), RESULTS),
        histogram(timings, "stage_seconds", "ts", F.col("seconds"), SECONDS, stage=F.col("stage")),
        counter(kind("ingestion"), "ingestion_jobs_total", "ts", outcome=F.col("outcome")),
        counter(kind("publish"), "queue_publish_total", "ts", outcome=F.col("outcome")),
        gauges(behind, "unpublished_documents", now, "unpublished"),
        gauges(behind.withColumn("oldest_seconds", F.coalesce("oldest_seconds", F.lit(0))), "oldest_unpublished_seconds", now, "oldest_seconds"),
        gauges(flagged, "anomaly_flagged_identities", now, "identities", signal=F.col("signal")),
        gauges(checked.where("outcome <> 'verified'"), "integrity_failures", now, "n", outcome=F.col("outcome")),
    ]
    out = parts[0].withColumn("ts", F.col("ts").cast("timestamp"))
    for part in parts[1:]:
        out = out.unionByName(part.withColumn("ts", F.col("ts").cast("timestamp")))
    return out
