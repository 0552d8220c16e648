"""Time-series queries over (ts, metric, labels..., value): range functions, alerts and ratios.

A range function at a sample looks back over the range's seconds with a range frame on its series; partitions are series, not metrics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _back(series: list[str], seconds: int, ts: str):
    return Window.partitionBy(*series).orderBy(F.col(ts).cast("timestamp").cast("long")).rangeBetween(-seconds, 0)


def increases(samples: DataFrame, series: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """samples with `step`: growth since the series' last sample; after a reset the value itself; 0 at the first."""
    before = F.lag(value).over(Window.partitionBy(*series).orderBy(ts))
    step = F.when(before.isNull(), F.lit(0.0)).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    return samples.withColumn("step", step)


def increase(samples: DataFrame, series: list[str], seconds: int, ts: str = "ts", value: str = "value", out: str = "increase") -> DataFrame:
    return increases(samples, series, ts, value).withColumn(out, F.sum("step").over(_back(series, seconds, ts))).drop("step")


def rate(samples: DataFrame, series: list[str], seconds: int, ts: str = "ts", value: str = "value", out: str = "rate") -> DataFrame:
    return increase(samples, series, seconds, ts, value, out).withColumn(out, F.col(out) / seconds)


def over_time(samples: DataFrame, series: list[str], seconds: int, how: str, ts: str = "ts", value: str = "value") -> DataFrame:
    """how: max, min, avg, sum or count, over the range; out in a column of that name."""
    return samples.withColumn(how, getattr(F, how)(value).over(_back(series, seconds, ts)))


def changes(samples: DataFrame, series: list[str], seconds: int, ts: str = "ts", value: str = "value") -> DataFrame:
    before = F.lag(value).over(Window.partitionBy(*series).orderBy(ts))
    rows = samples.withColumn("_c", F.coalesce((F.col(value) != before).cast("int"), F.lit(0)))
    return rows.withColumn("changes", F.sum("_c").over(_back(series, seconds, ts))).drop("_c")


def ratio(part: Column, whole: Column, least: float = 0.001) -> Column:
    """part / whole with the base held off 0."""
    return part / F.greatest(whole, F.lit(least))


def or_zero(total: Column) -> Column:
    return F.coalesce(total, F.lit(0.0))


def sustained(samples: DataFrame, series: list[str], condition: Column, seconds: int, ts: str = "ts", ties: list[str] = []) -> DataFrame:  # noqa: B006
    """(series, since, until): runs of consecutive samples that meet the condition for at least the seconds.

    Samples of one time are taken in the order of `ties`, and those that do not meet the condition first among equals, so they end a run.
    """
    order = Window.partitionBy(*series).orderBy(ts, *ties, "_on").rowsBetween(Window.unboundedPreceding, 0)
    rows = samples.withColumn("_on", F.coalesce(condition, F.lit(False)))
    rows = rows.withColumn("_run", F.count_if(~F.col("_on")).over(order))
    runs = rows.where("_on").groupBy(*series, "_run").agg(F.min(ts).alias("since"), F.max(ts).alias("until"))
    age = F.col("until").cast("timestamp").cast("long") - F.col("since").cast("timestamp").cast("long")
    return runs.where(age >= seconds).drop("_run")


def stale(samples: DataFrame, series: list[str], now: Column, seconds: int, ts: str = "ts") -> DataFrame:
    """(series, last, stale): whether the latest sample is older than the seconds."""
    last = samples.groupBy(*series).agg(F.max(ts).alias("last"))
    return last.withColumn("stale", now.cast("timestamp").cast("long") - F.col("last").cast("timestamp").cast("long") > seconds)


def over_threshold(samples: DataFrame, value: str, warn: float, critical: float | None = None) -> DataFrame:
    severity = F.when(F.col(value) > critical, "critical") if critical is not None else F.when(F.lit(False), "critical")
    return samples.withColumn("severity", severity.when(F.col(value) > warn, "warning"))


# metric definitions: name, kind, labels
CATALOGUE = [
    ("queries_total", "counter", ["outcome"]),
    ("stage_seconds", "histogram", ["stage"]),
    ("rerank_fallbacks_total", "counter", []),
    ("ingestion_jobs_total", "counter", ["outcome"]),
    ("queue_publish_total", "counter", ["outcome"]),
    ("unpublished_documents", "gauge", []),
    ("oldest_unpublished_seconds", "gauge", []),
    ("rerank_windows_total", "counter", []),
    ("below_floor_total", "counter", []),
    ("results_returned", "histogram", []),
    ("anomaly_flagged_identities", "gauge", ["signal"]),
    ("integrity_failures", "gauge", ["outcome"]),
]


def outcome_counter(audit: DataFrame, ts: str = "created_at") -> DataFrame:
    """queries_total by minute from audit rows: (ts, metric, outcome, value) as a counter that only grows."""
    outcome = F.when(F.col("action") == "query.denied", "denied").when(F.col("result_count") == 0, "empty").otherwise("ok")
    per = audit.where(F.col("action").isin("query", "query.denied")).groupBy(F.date_trunc("minute", ts).alias("ts"), outcome.alias("outcome")).agg(F.count("*").alias("_n"))
    total = F.sum("_n").over(Window.partitionBy("outcome").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    return per.select("ts", F.lit("queries_total").alias("metric"), "outcome", total.cast("double").alias("value"))


# -- alerts and panels over the catalogue -----------------------------------------------------------------------


def latency_quantile(buckets: DataFrame, q: float, seconds: int, series: list[str], ts: str = "ts") -> DataFrame:
    """(ts, series, value): the quantile of each bucket histogram's growth over the range, at each sample time.

    buckets: (ts, series, le, value), cumulative in le and growing in time.
    """
    from .evaluation import histogram_quantile

    grown = increase(buckets, [*series, "le"], seconds, ts, "value", "cum")
    key = F.to_json(F.struct(ts, *series))
    total = Window.partitionBy(ts, *series)
    rows = grown.withColumn("_key", key).withColumn("total_count", F.max("cum").over(total)).select("_key", ts, *series, "le", "cum", "total_count")
    at = rows.select("_key", ts, *series).distinct()
    return histogram_quantile(rows.select("_key", "le", "cum", "total_count"), q, "_key").join(at, "_key").select(ts, *series, "value")


def latency_alerts(buckets: DataFrame, seconds: int = 600, warn: float = 1.0, critical: float = 2.5, ts: str = "ts") -> DataFrame:
    """The 95th percentile of stage `total` against both thresholds."""
    values = latency_quantile(buckets.where("stage = 'total'"), 0.95, seconds, ["stage"], ts)
    return over_threshold(values, "value", warn, critical)


def fallback_ratio(fallbacks: DataFrame, queries: DataFrame, seconds: int, ts: str = "ts") -> DataFrame:
    """(ts, ratio): growth of fallbacks over growth of queries, series of a counter summed at each sample time; a missing one counts as 0."""
    total = lambda samples, name: increase(samples, ["metric"], seconds, ts, "value", name).groupBy(ts).agg(F.sum(name).alias(name))
    rows = total(queries, "_all").join(total(fallbacks, "_some"), ts, "left")
    return rows.select(ts, ratio(or_zero(F.col("_some")), F.col("_all")).alias("ratio"))


def hourly_growth(samples: DataFrame, series: list[str], ts: str = "ts") -> DataFrame:
    """Growth of a counter over the last hour at each sample: queries, finished jobs."""
    return increase(samples, series, 3600, ts)


def total_or_zero(samples: DataFrame, at: DataFrame, ts: str = "ts", seconds: int = 3600) -> DataFrame:
    """(ts, increase) at each time of `at`: the growth of all series of a counter over the range, 0 where no series has a sample."""
    grown = increase(samples, ["series"], seconds, ts).groupBy(ts).agg(F.sum("increase").alias("_grown"))
    return at.select(ts).distinct().join(grown, ts, "left").select(ts, or_zero(F.col("_grown")).alias("increase"))


def growth_alert(samples: DataFrame, series: list[str], seconds: int, most: float, ts: str = "ts") -> DataFrame:
    """Samples at which a counter has grown by more than `most` within the range: denials, failed or exhausted jobs, failed publication."""
    return increase(samples, series, seconds, ts).where(F.col("increase") > most)


def peak_alert(samples: DataFrame, series: list[str], seconds: int, most: float = 0.0, ts: str = "ts") -> DataFrame:
    """Samples at which a gauge has been over `most` within the range: flagged identities, failed integrity checks."""
    return over_time(samples, series, seconds, "max", ts).where(F.col("max") > most)


def coverage(scored: Column, total: Column) -> Column:
    """scored / total, null without any."""
    return F.try_divide(scored.cast("double"), total)


def milliseconds(seconds: Column) -> Column:
    """Whole milliseconds, halves to even."""
    return F.bround(seconds * 1000, 0).cast("long")
