"""Audit, calibration and dashboard aggregations. Each is one or two partial aggregations on its key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# defaults of the anomaly signals
RATE, DENIAL_RATIO, LEAST_ATTEMPTS, SINGLETON_RATIO, PAIRS, PAIR_SECONDS = 30, 0.3, 10, 0.6, 5, 300


def _seconds(ts: str) -> Column:
    return F.col(ts).cast("timestamp").cast("double")


def boundary_pairs(events: DataFrame, seconds: int = PAIR_SECONDS) -> DataFrame:
    """events with `is_pair`: a success right after a denial of the same actor, within the seconds; ties by event_id."""
    order = Window.partitionBy("actor_sub").orderBy("created_at", "event_id")
    asked = events.where(F.col("action").isin("query", "query.denied")).withColumn("_before", F.lag("action").over(order)).withColumn("_when", F.lag("created_at").over(order))
    pair = (F.col("action") == "query") & (F.col("_before") == "query.denied") & (_seconds("created_at") - _seconds("_when") <= seconds)
    return asked.withColumn("is_pair", F.coalesce(pair, F.lit(False))).drop("_before", "_when")


def identity_stats(events: DataFrame, seconds: int = PAIR_SECONDS) -> DataFrame:
    """One row for each actor with a query or a denied one: counts, ratios (0 without a base) and denial-success pairs."""
    rows = boundary_pairs(events, seconds)
    success, denied = F.col("action") == "query", F.col("action") == "query.denied"
    stats = rows.groupBy("actor_sub").agg(
        F.count("*").alias("attempts"),
        F.count_if(denied).alias("denied"),
        F.count_if(success).alias("success"),
        F.count_if(success & (F.col("result_count") <= 1)).alias("singleton_or_empty"),
        F.count_if("is_pair").alias("boundary_pairs"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return stats.withColumn("denial_ratio", ratio("denied", "attempts")).withColumn("singleton_rate", ratio("singleton_or_empty", "success"))


def with_signals(stats: DataFrame, rate: int = RATE, denial: float = DENIAL_RATIO, least: int = LEAST_ATTEMPTS, singleton: float = SINGLETON_RATIO, pairs: int = PAIRS) -> DataFrame:
    """stats with the array of signals that each actor shows; thresholds apply to unrounded ratios."""
    signals = F.array_compact(
        F.array(
            F.when(F.col("attempts") >= rate, "query_rate"),
            F.when((F.col("attempts") >= least) & (F.col("denial_ratio") >= denial), "denial_ratio"),
            F.when((F.col("success") >= least) & (F.col("singleton_rate") >= singleton), "singleton_or_empty"),
            F.when(F.col("boundary_pairs") >= pairs, "boundary_mapping"),
        )
    )
    return stats.withColumn("signals", signals)


def flagged_counts(flagged: DataFrame) -> DataFrame:
    return flagged.select(F.explode("signals").alias("signal")).groupBy("signal").agg(F.count("*").alias("identities"))


def within(events: DataFrame, now: Column, minutes: int = 60) -> DataFrame:
    return events.where((F.col("created_at") >= now - F.make_dt_interval(mins=F.lit(minutes))) & (F.col("created_at") <= now))


# -- agreement of suggesters with curators ----------------------------------------------------------------------


def _ranked(decisions: DataFrame, levels: DataFrame, columns: list[str]) -> DataFrame:
    ranks = levels.select(F.upper("value").alias("_v"), F.col("rank").alias("_r"))
    for c in columns:
        decisions = decisions.join(F.broadcast(ranks.toDF(f"_v_{c}", f"rank_{c}")), F.upper(c) == F.col(f"_v_{c}"), "left").drop(f"_v_{c}")
    return decisions


def agreement(decisions: DataFrame, levels: DataFrame) -> DataFrame:
    """(suggester, accepted, overridden, unresolved, rate) for marking, caveats, precedent and llm.

    decisions: flat advisory outcomes, of rows that have one. The rate is over resolved ones, null without any.
    """
    d = _ranked(decisions, levels, ["flagged_classification", "final_classification", "precedent_classification", "llm_suggested_classification", "assigned_classification"])

    def verdict(asked: Column, target: str) -> Column:
        known = F.col(f"rank_{target}").isNotNull() & F.col("rank_final_classification").isNotNull()
        return F.when(asked & ~known, "unresolved").when(asked & (F.col("rank_final_classification") >= F.col(f"rank_{target}")), "accepted").when(asked, "overridden")

    caveats = F.size(F.coalesce("flagged_caveats", F.array().cast("array<string>"))) > 0
    held = F.size(F.array_except("flagged_caveats", F.coalesce("final_releasability", F.array().cast("array<string>")))) == 0
    higher = F.coalesce(F.col("rank_llm_suggested_classification") > F.col("rank_assigned_classification"), F.lit(False))
    outcomes = {
        "marking": verdict(F.coalesce("marking_mismatch_flagged", F.lit(False)) & F.col("flagged_classification").isNotNull(), "flagged_classification"),
        "caveats": F.when(caveats & held, "accepted").when(caveats, "overridden"),
        "precedent": verdict(F.col("precedent_classification").isNotNull(), "precedent_classification"),
        "llm": verdict(F.col("llm_suggested_classification").isNotNull() & higher, "llm_suggested_classification"),
    }
    rows = d.select(F.explode(F.array(*(F.struct(F.lit(k).alias("suggester"), v.alias("outcome")) for k, v in outcomes.items()))).alias("x")).select("x.*").where("outcome is not null")
    n = {k: F.count_if(F.col("outcome") == k) for k in ("accepted", "overridden", "unresolved")}
    return rows.groupBy("suggester").agg(*(c.alias(k) for k, c in n.items())).withColumn("rate", F.try_divide(F.col("accepted"), F.col("accepted") + F.col("overridden")))


def pii_acted_on(decisions: DataFrame) -> DataFrame:
    """(finder, approved_unchanged, approved_corrected, rejected, unresolved, rate): what curators did with documents that had findings."""
    changed = F.upper("assigned_classification") != F.upper("final_classification")
    outcome = F.when(F.col("action") == "document.reject", "rejected").when(changed.isNull(), "unresolved").when(changed, "approved_corrected").otherwise("approved_unchanged")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    finders = F.array_compact(F.array(F.when(size("pii_regex_kinds") > 0, "regex"), F.when(size("pii_llm_kinds") > 0, "llm")))
    rows = decisions.select(F.explode(finders).alias("finder"), outcome.alias("outcome"))
    n = {k: F.count_if(F.col("outcome") == k) for k in ("approved_unchanged", "approved_corrected", "rejected", "unresolved")}
    acted = F.col("approved_corrected") + F.col("rejected")
    return rows.groupBy("finder").agg(*(c.alias(k) for k, c in n.items())).withColumn("rate", F.try_divide(acted, acted + F.col("approved_unchanged")))


def verdict_agreement(decisions: DataFrame) -> DataFrame:
    """(scored, skipped, agreed, rate): unanimous verdicts on all of a document's findings against what its curator did."""
    verified, false, total = (F.coalesce(F.col(c), F.lit(0)) for c in ("pii_regex_llm_verified_count", "pii_regex_llm_likely_false_positive_count", "pii_regex_count"))
    changed = F.upper("assigned_classification") != F.upper("final_classification")
    acted = F.when(F.col("action") == "document.reject", F.lit(True)).otherwise(changed)
    unanimous = (verified > 0) & (verified == total) & ((false == 0) | (false == verified)) & acted.isNotNull()
    rows = decisions.where(total > 0).select(unanimous.alias("u"), (acted == (false == 0)).alias("a"))
    out = rows.agg(F.count_if("u").alias("scored"), F.count_if(~F.col("u")).alias("skipped"), F.count_if(F.col("u") & F.col("a")).alias("agreed"))
    return out.withColumn("rate", F.try_divide(F.col("agreed"), F.col("scored")))


# -- dashboards -------------------------------------------------------------------------------------------------


def status_counts(documents: DataFrame) -> DataFrame:
    """One row: all documents, those pending and those approved."""
    status = F.col("status")
    return documents.agg(F.count("*").alias("total"), F.count_if(status == "pending_review").alias("pending"), F.count_if(status == "approved").alias("approved"))


def counts_by(documents: DataFrame, *by: str) -> DataFrame:
    return documents.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by)


def hourly(rows: DataFrame, by: str, ts: str = "created_at") -> DataFrame:
    """(by, hour, n) with a 0 for each hour without rows between a key's first and last."""
    n = rows.groupBy(by, F.date_trunc("hour", ts).alias("hour")).agg(F.count("*").alias("n"))
    span = n.groupBy(by).agg(F.min("hour").alias("_a"), F.max("hour").alias("_b"))
    grid = span.select(by, F.explode(F.sequence("_a", "_b", F.expr("interval 1 hour"))).alias("hour"))
    return grid.join(n, [by, "hour"], "left").select(by, "hour", F.coalesce("n", F.lit(0)).alias("n"))
