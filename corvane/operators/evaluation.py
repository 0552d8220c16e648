"""Quality of retrieval and answers: rank metrics, leaks, means, baselines, percentiles and histograms."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import staged


def with_gain(results: DataFrame, golden: DataFrame) -> DataFrame:
    """results (qid, rank, filename) with gain: 1 at the first rank of an expected name, else 0."""
    expect = golden.select("qid", F.explode("expect").alias("filename")).distinct().withColumn("_e", F.lit(True))
    first = F.row_number().over(Window.partitionBy("qid", "filename").orderBy("rank")) == 1
    rows = results.withColumn("_first", first).join(expect, ["qid", "filename"], "left")
    return rows.withColumn("gain", (F.coalesce("_e", F.lit(False)) & F.col("_first")).cast("int")).drop("_e", "_first")


def rank_metrics(results: DataFrame, golden: DataFrame) -> DataFrame:
    """(qid, recall, precision, reciprocal_rank, ndcg, p1, p3, p5, returned, first_rank, leaks); all metrics null where nothing is expected.

    golden: (qid, expect, forbid, top_k). recall and precision count distinct expected names found; precision divides by returned rows.
    """
    rows = with_gain(results, golden)
    hit = F.col("gain") == 1
    per = rows.groupBy("qid").agg(
        F.count("*").alias("returned"),
        F.sum("gain").alias("_found"),
        F.min(F.when(hit, F.col("rank"))).alias("first_rank"),
        F.sum(F.when(hit, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("_dcg"),
        *(F.count_if(hit & (F.col("rank") <= k)).alias(f"_p{k}") for k in (1, 3, 5)),
        F.array_distinct(F.collect_list("filename")).alias("_names"),  # top_k names
    )
    out = golden.join(per, "qid", "left")
    none = F.size("expect") == 0
    found, returned = F.coalesce("_found", F.lit(0)), F.coalesce("returned", F.lit(0))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size("expect"), "top_k"))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    scored = lambda value: F.when(~none, value)
    at = lambda k: scored(F.when(F.lit(k) <= F.col("top_k"), F.coalesce(f"_p{k}", F.lit(0)) / k)).alias(f"p{k}")
    return out.select(
        "qid",
        scored(found / F.greatest(F.lit(1), F.size(F.array_distinct("expect")))).alias("recall"),
        scored(F.try_divide(found, returned)).alias("precision"),
        scored(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).alias("reciprocal_rank"),
        scored(F.coalesce("_dcg", F.lit(0.0)) / ideal).alias("ndcg"),
        at(1),
        at(3),
        at(5),
        returned.alias("returned"),
        scored(F.col("first_rank")).alias("first_rank"),
        F.size(F.array_intersect(F.coalesce("_names", F.array().cast("array<string>")), "forbid")).alias("leaks"),
    )


def report(metrics: DataFrame) -> DataFrame:
    """Means over queries, nulls left out; noise is the mean number returned where nothing is expected."""
    mean = lambda c: F.avg(c).alias(f"mean_{c}")
    return metrics.agg(*map(mean, ("recall", "precision", "reciprocal_rank", "ndcg")), F.sum("leaks").alias("leaks"), F.avg(F.when(F.col("recall").isNull(), F.col("returned"))).alias("abstention_noise"))


def recall_misses(metrics: DataFrame) -> DataFrame:
    return metrics.where("recall < 1").select("qid", "recall")


def average_precision(judged: DataFrame) -> DataFrame:
    """(qid, ap) of (qid, rank, relevant): the mean of precision at relevant ranks, 0 without any."""
    order = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = judged.withColumn("_hits", F.count_if("relevant").over(order)).withColumn("_at", F.count("*").over(order))
    return rows.groupBy("qid").agg(F.coalesce(F.avg(F.when(F.col("relevant"), F.col("_hits") / F.col("_at"))), F.lit(0.0)).alias("ap"))


def judge_report(judged: DataFrame) -> DataFrame:
    """Means of judged answers, how many abstentions were right, undetermined or without a tool call."""
    names = [c for c, t in judged.dtypes if t == "double"]
    abstention = judged["abstention_correct"]
    failed = [F.count_if(~F.coalesce("tool_called", F.lit(False))).alias("tool_call_failures")] if "tool_called" in judged.columns else []
    return judged.agg(*failed, *(F.avg(c).alias(f"mean_{c}") for c in names), F.avg(abstention.cast("int")).alias("abstention_accuracy"), F.count_if(abstention.isNull()).alias("undetermined"))


def score_in_range(value: Column) -> Column:
    """The score if it is a number from 0 to 1, else null."""
    return F.when(value.between(0.0, 1.0), value)


def claim_ratio(claims: Column) -> Column:
    """Supported share of an array of (claim, supported); null without claims."""
    return F.try_divide(F.size(F.filter(claims, lambda c: c["supported"])), F.size(claims))


def aligned(relevance: Column, n_contexts: Column) -> Column:
    """Whether judged contexts bear the indices 0 to n - 1, each once and in order."""
    return F.transform(relevance, lambda r: r["index"]) == F.when(n_contexts > 0, F.sequence(F.lit(0), n_contexts - 1)).otherwise(F.array().cast("array<int>"))


def against_baseline(current: DataFrame, baseline: DataFrame, tolerance: float, gated: list[str] | None = None) -> DataFrame:
    """(metric, current, baseline, delta, comparable, regressed, gates) from (metric, value): a drop of more than the tolerance regresses."""
    rows = current.select("metric", F.col("value").alias("current")).join(baseline.select("metric", F.col("value").alias("baseline")), "metric", "full")
    delta = F.col("current") - F.col("baseline")
    gates = F.col("metric").isin(gated) if gated is not None else F.lit(True)
    return rows.select("metric", "current", "baseline", delta.alias("delta"), delta.isNotNull().alias("comparable"), F.coalesce(delta < -tolerance, F.lit(False)).alias("regressed"), gates.alias("gates"))


def may_compare(current: str, baseline: str, allow_change: bool = False) -> bool:
    """Runs of different configurations are not compared unless that is allowed."""
    return allow_change or current == baseline


def percentiles(samples: DataFrame, by: list[str], value: str, qs: list[float]) -> DataFrame:
    """Exact nearest-rank percentiles, a group of nulls included.

    Values are counted by group and value and laid out by ranges of both, once, as a staged table: running counts within a range start from
    those of the group's ranges before it, so no task gets a group's values. Ranks are worked out in decimals: 0.07 of 100 values is the 7th.
    """
    found = samples.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    cut = staged(found.repartitionByRange(*by, "_v").withColumn("_piece", F.spark_partition_id()))
    sizes = cut.groupBy(*by, "_piece").agg(F.sum("_n").alias("_m"))  # a row for each range and group in it
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumns({"_base": F.coalesce(F.sum("_m").over(before), F.lit(0)), "n": F.sum("_m").over(Window.partitionBy(*by))}).drop("_m")
    inside = Window.partitionBy(*by, "_piece").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    upto = cut.withColumn("_upto", F.sum("_n").over(inside)).alias("u").join(sizes.alias("s"), _equal([*by, "_piece"], "u", "s"))
    upto = upto.select(*(F.col(f"u.{c}").alias(c) for c in by), "_v", "n", (F.col("_base") + F.col("_upto")).alias("_upto"))
    rank = lambda q: F.ceil(F.lit(Decimal(str(q))) * F.col("n").cast("decimal(20,0)"))
    ranks = upto.groupBy(*by).agg(*(F.min(F.when(F.col("_upto") >= rank(q), F.col("_v"))).alias(f"p{round(q * 100)}") for q in qs), F.max("n").alias("n"))
    if by:
        every = samples.select(*by).distinct().alias("e").join(ranks.alias("r"), _equal(by, "e", "r"), "left")
        ranks = every.select(*(F.col(f"e.{c}").alias(c) for c in by), *(F.col(f"r.{c}").alias(c) for c in ranks.columns if c not in by))
    return ranks.withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def _equal(columns: list[str], one: str, other: str) -> Column:
    """Equality of all columns of two aliased frames, nulls too."""
    return reduce(and_, (F.col(f"{one}.{c}").eqNullSafe(F.col(f"{other}.{c}")) for c in columns))


def histogram_delta(snapshots: DataFrame) -> DataFrame:
    """(stage, le, cum, total_sum, total_count): each stage's growth from snapshot 0 to snapshot 1; a stage that was absent starts at 0."""
    keys = ["stage", "le"]
    at = lambda i: snapshots.where(F.col("snapshot") == i).select(*keys, *(F.col(c).alias(f"{c}_{i}") for c in ("cum", "total_sum", "total_count")))
    rows = at(1).join(at(0), keys, "left")
    return rows.select(*keys, *((F.col(f"{c}_1") - F.coalesce(f"{c}_0", F.lit(0.0))).alias(c) for c in ("cum", "total_sum", "total_count")))


def histogram_quantile(delta: DataFrame, q: float, by: str = "stage") -> DataFrame:
    """(by, value): linear within the first bucket whose cumulative count reaches q * count; the last finite edge beyond; null if empty."""
    order = Window.partitionBy(by).orderBy("le")
    rows = delta.withColumn("_edge", F.coalesce(F.lag("le").over(order), F.lit(0.0))).withColumn("_below", F.coalesce(F.lag("cum").over(order), F.lit(0.0)))
    rows = rows.withColumn("_target", q * F.col("total_count"))
    span = F.col("cum") - F.col("_below")
    inside = F.col("_edge") + (F.col("le") - F.col("_edge")) * F.when(span == 0, 1.0).otherwise(F.try_divide(F.col("_target") - F.col("_below"), span))
    value = F.when(F.col("le") == F.lit(float("inf")), F.col("_edge")).otherwise(inside)
    first = F.min(F.when(F.col("cum") >= F.col("_target"), F.struct("le", value.alias("v"))))
    return rows.groupBy(by).agg(F.when(F.max("total_count") > 0, first["v"]).alias("value"))


def suspect_stages(delta: DataFrame) -> DataFrame:
    """(stage, mean, p95, suspect): a stage whose mean is not 0 while its p95 is missing or under half the mean."""
    mean = delta.groupBy("stage").agg(F.max(F.try_divide(F.col("total_sum"), F.col("total_count"))).alias("mean"))
    rows = mean.join(histogram_quantile(delta, 0.95).withColumnRenamed("value", "p95"), "stage")
    return rows.withColumn("suspect", F.coalesce((F.col("mean") != 0) & (F.col("p95").isNull() | (F.col("p95") < F.col("mean") / 2)), F.lit(False)))


def kill_rate(killed: Column, survived: Column) -> Column:
    return F.try_divide(killed.cast("double"), killed + survived)


def latest_report(reports: DataFrame, before: str | None = None) -> DataFrame:
    """The report with the greatest name, before the given one."""
    rows = reports if before is None else reports.where(F.col("name") < before)
    return rows.orderBy(F.desc("name")).limit(1)
