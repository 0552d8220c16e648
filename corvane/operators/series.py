"""Range functions over series of any size: series are cut into pieces by time, and what a piece needs from before its cut is carried over.

Samples are sorted by ranges on (series, time), so a series with a third of all samples spans many pieces, each of about equal size, and small series share one. A cut falls within
a series at most once a piece, so cuts are no more than pieces. Over each cut goes the series' last sample before it (for steps and changes). Sums, extremes and counts over a range
are merged from running figures of seconds (ranged). The results are those of one window over each whole series.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import staged


@dataclass(frozen=True)
class Pieces:
    """rows: the samples with `_piece`, a staged table; cuts: (series..., _piece, _start) for each piece that continues a series, fewer than there are pieces."""

    rows: DataFrame
    cuts: DataFrame
    series: tuple[str, ...]
    ts: str
    ties: tuple[str, ...]


def _seconds(ts: str) -> Column:
    return F.col(ts).cast("timestamp").cast("long")


def _same(a: DataFrame, names: tuple[str, ...], prefix: str) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & a[c].eqNullSafe(F.col(f"{prefix}{c}"))
    return out


def pieces(samples: DataFrame, series: list[str], ts: str = "ts", ties: list[str] = [], parts: int | None = None) -> Pieces:  # noqa: B006
    """The samples in `parts` pieces (the session's shuffle partitions if None). Samples of one series and time stay in one piece, in the order of `ties`."""
    order = [*(F.asc(c) for c in series), F.asc(ts)]
    laid = samples.repartitionByRange(parts, *order) if parts else samples.repartitionByRange(*order)
    rows = staged(laid.withColumn("_piece", F.spark_partition_id()))
    runs = rows.groupBy(*series, "_piece").agg(F.min(ts).alias("_start"))
    # a series' first piece has no cut before it; neighbours in the order of ranges, so a window over series suffices
    before = F.lag("_piece").over(Window.partitionBy(*series).orderBy("_piece"))
    cuts = staged(runs.withColumn("_before", before).where("_before is not null").drop("_before"))
    return Pieces(rows, cuts, tuple(series), ts, tuple(ties))


def _within(laid: Pieces) -> Window:
    return Window.partitionBy("_piece", *laid.series).orderBy(laid.ts, *laid.ties)


def previous(laid: Pieces, columns: list[str]) -> DataFrame:
    """laid.rows with `_before`, a struct of the columns in the series' sample before; null at its first."""
    one = F.struct(*columns)
    spanning = F.broadcast(laid.cuts.select(*(F.col(c).alias(f"_s_{c}") for c in laid.series)).distinct())
    ends = laid.rows.join(spanning, _same(laid.rows, laid.series, "_s_"), "left_semi").groupBy(*laid.series, "_piece").agg(F.max_by(one, F.struct(laid.ts, *laid.ties)).alias("_last"))
    carried = ends.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*laid.series).orderBy("_piece"))).where("_carried is not null")
    carried = F.broadcast(carried.select(*(F.col(c).alias(f"_c_{c}") for c in laid.series), F.col("_piece").alias("_at"), "_carried"))  # no more than pieces
    rows = laid.rows.join(carried, _same(laid.rows, laid.series, "_c_") & (F.col("_piece") == F.col("_at")), "left")
    return rows.withColumn("_before", F.coalesce(F.lag(one).over(_within(laid)), "_carried")).drop("_carried", "_at", *(f"_c_{c}" for c in laid.series))


# fixed values: for each aggregate the figures of a second of samples, how two such are merged, and what is read from them
_PARTS = {
    "sum": ({"_a": F.sum}, {"_a": F.sum}, lambda: F.col("_a")),
    "count": ({"_a": F.count}, {"_a": F.sum}, lambda: F.col("_a")),
    "max": ({"_a": F.max}, {"_a": F.max}, lambda: F.col("_a")),
    "min": ({"_a": F.min}, {"_a": F.min}, lambda: F.col("_a")),
    "avg": ({"_a": F.sum, "_b": F.count}, {"_a": F.sum, "_b": F.sum}, lambda: F.col("_a") / F.nullif(F.col("_b"), F.lit(0))),
}


def ranged(laid: Pieces, rows: DataFrame, seconds: int, how: str, value: str, out: str) -> DataFrame:
    """rows (of laid, with further columns) with `out`: the aggregate `how` (of _PARTS) of `value` over the range's seconds up to each sample.

    Samples are reduced to a row for each series and second, and time is cut into blocks as long as the range, so that every range is the end of one block and the
    beginning of the next. Both are running aggregates, one from each side of a block: the work is in proportion to the seconds, however many samples
    a range holds; nothing is subtracted; and no task gets more of a series than two ranges of seconds.
    """
    first, merged, read = _PARTS[how]
    names, length, running = laid.series, F.lit(seconds + 1), (Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_second", _seconds(laid.ts))
    each = rows.groupBy(*names, "_second").agg(*(f(value).alias(p) for p, f in first.items()))
    each = each.withColumn("_block", F.col("_second") - F.pmod("_second", length))
    begun = Window.partitionBy(*names, "_block").orderBy("_second").rowsBetween(*running)
    heads = each.select(*names, "_second", *(f(p).over(begun).alias(p) for p, f in merged.items()))
    # each range that begins in the block before asks there, at its first second
    asking = each.where(F.col("_second") - F.col("_block") < seconds).select(
        *names, (F.col("_second") - seconds).alias("_second"), *(F.lit(None).cast(each.schema[p].dataType).alias(p) for p in first), (F.col("_block") - length).alias("_block"), F.lit(True).alias("_asks")
    )
    left = Window.partitionBy(*names, "_block").orderBy(F.desc("_second")).rangeBetween(*running)
    tails = each.withColumn("_asks", F.lit(False)).unionByName(asking).withColumns({p: f(p).over(left) for p, f in merged.items()})
    tails = tails.where("_asks").select(*names, (F.col("_second") + seconds).alias("_second"), *first)
    found = heads.unionByName(tails).groupBy(*names, "_second").agg(*(f(p).alias(p) for p, f in merged.items()))
    found = found.select(*(F.col(c).alias(f"_r_{c}") for c in (*names, "_second")), read().alias(out))
    return rows.join(found, _same(rows, (*names, "_second"), "_r_")).drop("_second", *(f"_r_{c}" for c in (*names, "_second")))


def increases(laid: Pieces, value: str = "value") -> DataFrame:
    """laid.rows with `step`: growth since the series' last sample; after a reset the value itself; 0 at the first."""
    rows, before = previous(laid, [value]), F.col(f"_before.{value}")
    step = F.when(before.isNull(), F.lit(0.0)).when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    return rows.withColumn("step", step).drop("_before")


def increase(laid: Pieces, seconds: int, value: str = "value", out: str = "increase") -> DataFrame:
    return ranged(laid, increases(laid, value), seconds, "sum", "step", out).drop("step", "_piece")


def over_time(laid: Pieces, seconds: int, how: str, value: str = "value") -> DataFrame:
    """how: max, min, avg, sum or count, over the range; out in a column of that name."""
    return ranged(laid, laid.rows, seconds, how, value, how).drop("_piece")


def changes(laid: Pieces, seconds: int, value: str = "value") -> DataFrame:
    rows = previous(laid, [value]).withColumn("_c", F.coalesce((F.col(value) != F.col(f"_before.{value}")).cast("int"), F.lit(0)))
    return ranged(laid, rows.drop("_before"), seconds, "sum", "_c", "changes").drop("_c", "_piece")


def pairs(events: DataFrame, seconds: int, parts: int | None = None) -> DataFrame:
    """analytics.boundary_pairs() where one actor may have a third of all events: query events with `is_pair`."""
    asked = events.where(F.col("action").isin("query", "query.denied"))
    rows = previous(pieces(asked, ["actor_sub"], "created_at", ["event_id"], parts), ["action", "created_at"])
    gap = F.col("created_at").cast("timestamp").cast("double") - F.col("_before.created_at").cast("timestamp").cast("double")
    pair = (F.col("action") == "query") & (F.col("_before.action") == "query.denied") & (gap <= seconds)
    return rows.withColumn("is_pair", F.coalesce(pair, F.lit(False))).drop("_before", "_piece")
