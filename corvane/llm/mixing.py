"""Mixing sources to target weights by Pfair scheduling.

Each source's rows, in a hashed order, form blocks of about BLOCK characters, so that a source of long documents gets its share of the text, not of
the rows. With weights w / period, block k of a source is released at slot
floor(k * period / w) and due by ceil((k + 1) * period / w); earliest deadline first gives each slot one block. After a period
every source has exactly its share and the schedule repeats, so one period is worked out (a fold over its slots in one
small row) and a block's slot follows from its number alone. While all sources last, none is ever a whole block off its share.

Only DataFrame functions run here. A source's rows are summed up within hashed chunks of about CHUNK characters, chunks within groups of GROUP, whose sums are
added up before the rows; no task gets a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, quoted, unpacked

BLOCK, PERIOD, CHUNK, GROUP = 1 << 17, 1000, 1 << 23, 1024
MOST_SOURCES = 1024
SPARE = 16
STRETCH = 128  # slots that are folded into one array


def tempered(counts: DataFrame, exponent: float = 0.5) -> DataFrame:
    """(source, weight): sizes to a power, so that large sources are damped."""
    return counts.select("source", F.pow(F.col("size").cast("double"), F.lit(exponent)).alias("weight"))


def shares(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """(source, share, number, period): positive whole shares that sum to the period, by largest remainder.

    The period is raised to SPARE slots a source where it has fewer. All rows meet in one task: MOST_SOURCES at most.
    """
    every = Window.partitionBy()
    out = weights.withColumn("n", F.count("*").over(every))
    out = out.withColumn("period", F.greatest(F.lit(period).cast("long"), SPARE * F.col("n")))
    exact = F.col("weight") / F.sum("weight").over(every) * (F.col("period") - F.col("n"))
    out = out.withColumn("exact", exact).withColumn("least", F.floor("exact").cast("long"))
    out = out.withColumn("spare", F.col("period") - F.col("n") - F.sum("least").over(every))
    out = out.withColumn("turn", F.row_number().over(Window.orderBy((F.col("least") - F.col("exact")), "source")))
    share = 1 + F.col("least") + (F.col("turn") <= F.col("spare")).cast("long")
    number = F.row_number().over(Window.orderBy("source")).cast("int") - 1
    return out.select("source", share.alias("share"), number.alias("number"), "period")


def schedule(shared: DataFrame) -> DataFrame:
    """(number, turn, slot): the slot of each source's turn in one period."""
    whole = shared.groupBy("period").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "share"))), lambda x: x["share"]).alias("w"))

    def due(k: Column, w: Column) -> Column:
        return F.floor(((k + 1) * F.col("period") + w - 1) / w)

    def step(state: Column, slot: Column) -> Column:
        def candidate(w: Column, i: Column) -> Column:
            k = F.get(state["taken"], i)
            open_ = (k < w) & (F.floor(k * F.col("period") / w) <= slot)
            return F.when(open_, F.struct(due(k, w).alias("due"), i.alias("number"), k.alias("turn")))

        best = F.array_min(F.transform("w", candidate))
        moved = lambda b: F.struct(
            F.transform(state["taken"], lambda k, i: F.when(i == b["number"], k + 1).otherwise(k)).alias("taken"),
            F.concat(state["slots"], F.array(F.struct(b["number"].alias("number"), b["turn"].alias("turn"), slot.alias("slot")))).alias("slots"),
        )
        return F.get(F.transform(F.array(best), moved), F.lit(0))

    kind = "array<struct<number:int,turn:bigint,slot:bigint>>"
    taken = F.transform("w", lambda w: F.lit(0).cast("long"))
    first = F.lit(0).cast("long")

    def stretch(state: Column, begin: Column) -> Column:
        """STRETCH slots; their array is put together by itself, as each slot's turn copies it."""
        last = F.least(begin + STRETCH, F.col("period")) - 1
        start = F.struct(state["taken"].alias("taken"), F.array().cast(kind).alias("slots"))
        done = F.aggregate(F.sequence(begin, last), start, step)
        return F.get(F.transform(F.array(done), lambda d: F.struct(d["taken"].alias("taken"), F.concat(state["all"], F.array(d["slots"])).alias("all"))), F.lit(0))

    start = F.struct(taken.alias("taken"), F.array().cast(f"array<{kind}>").alias("all"))
    slots = F.aggregate(F.sequence(first, F.col("period") - 1, F.lit(STRETCH).cast("long")), start, stretch, lambda s: F.flatten(s["all"]))
    return whole.select(F.inline(slots))


def size_of_row(docs: DataFrame) -> Column:
    """One more than the characters of a row's text, by `n_chars` or else the text itself; one where there is neither. Nulls and negative numbers count as none."""
    size = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.length("text") if "text" in docs.columns else F.lit(0)
    return 1 + F.greatest(F.coalesce(size.cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))


def _hash(docs: DataFrame, key: str) -> Column:
    """The order of rows; it takes in text and size, as a third of all rows may have one key, or none."""
    more = [F.coalesce(F.col("text").cast("string"), F.lit(""))] if "text" in docs.columns else []
    return F.xxhash64(F.lit(8), key, size_of_row(docs), *more)


def mix(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK, period: int = PERIOD, source: str = "source", key: str = "doc_id") -> DataFrame:
    """docs with long columns block, slot and place: sorting by (slot, place) interleaves the sources at their target weights.

    block: the size of a block as size_of_row() counts; a row belongs to the block that its first character falls in, and one of several blocks' size leaves the next ones empty.
    place: the characters of the source before the row, so rows of a block keep their order; it tells rows of one slot apart.
    weights: (source, weight > 0); sources without one get the mean of the given ones, and without weights
    the square roots of their sizes count. Equal weights take slots in the order of the sources' names. A null source is a source of its own. Rows of a source with equal
    keys and sizes are interchangeable: their places
    may swap. All rows stay: once a source ends, its slots stay empty. An empty frame gives an empty one. Columns of docs named block, slot or place are replaced. Over
    MOST_SOURCES sources raise ValueError.
    """
    docs = docs.drop("block", "slot", "place")
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    rows = packed(docs, name.alias("_source"), F.col(key).alias("_key"), _hash(docs, key).alias("_hash"), size_of_row(docs).alias("_size"))
    counts = rows.groupBy("_source").agg(F.sum("_size").alias("size"))
    counts = counts.withColumnRenamed("_source", "source")
    n_sources = counts.limit(MOST_SOURCES + 1).count()
    if n_sources > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: group them first")
    if weights is None:
        wanted = tempered(counts)
    else:
        given = weights.select(F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("null")).alias("source"), F.col("weight").cast("double"))
        mean = F.coalesce(F.avg("weight").over(Window.partitionBy()), F.lit(1.0))
        wanted = counts.join(given, "source", "left").select("source", F.coalesce("weight", mean).alias("weight"))
    shared = shares(wanted, period)
    # one row a source and one a slot: at most MOST_SOURCES and max(period, SPARE * MOST_SOURCES)
    plan = F.broadcast(shared.join(counts, "source").withColumnRenamed("source", "_source"))
    slots = F.broadcast(schedule(shared).select(F.col("number").alias("_number"), F.col("turn").alias("_turn"), F.col("slot").alias("_slot")))

    chunks = F.ceil(F.col("size") / CHUNK)
    rows = rows.join(plan, "_source").withColumn("_chunk", F.pmod("_hash", chunks))
    sizes = rows.groupBy("_source", "_chunk").agg(F.sum("_size").alias("_sum")).withColumn("_group", F.floor(F.col("_chunk") / GROUP))
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    groups = sizes.groupBy("_source", "_group").agg(F.sum("_sum").alias("_sum"))
    groups = groups.select("_source", "_group", F.coalesce(F.sum("_sum").over(earlier("_source").orderBy("_group")), F.lit(0)).alias("_base"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier("_source", "_group").orderBy("_chunk")), F.lit(0)))
    sizes = sizes.join(groups, ["_source", "_group"]).select("_source", "_chunk", (F.col("_base") + F.col("_before")).alias("_before"))
    within = F.coalesce(F.sum("_size").over(earlier("_source", "_chunk").orderBy("_hash", "_key", "_size")), F.lit(0))
    rows = rows.withColumn("_within", within).join(sizes, ["_source", "_chunk"])
    rows = rows.withColumn("_at", F.col("_before") + F.col("_within")).withColumn("block", F.floor(F.col("_at") / block).cast("long"))
    rows = rows.withColumn("_turn", F.col("block") % F.col("share")).withColumn("_number", F.col("number")).join(slots, ["_number", "_turn"])
    slot = F.floor(F.col("block") / F.col("share")).cast("long") * F.col("period") + F.col("_slot")
    rows = rows.withColumn("slot", slot).withColumn("place", (F.col("_at") % block).cast("long"))
    instead = {c: F.col(c) for c in ("block", "slot", "place")}
    return unpacked(rows, [*docs.columns, *instead], **instead)


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows sorted into their interleaved order, without the columns that mix() added."""
    return mixed.orderBy("slot", "place").drop("block", "slot", "place")


def interleaved(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """The rows of docs, with all its columns, sorted into the interleaved order of mix(); columns named block, slot or place keep what they hold."""
    own = {c: f"_own_{c}" for c in ("block", "slot", "place") if c in docs.columns}
    mixed = in_order(mix(docs.withColumnsRenamed(own), weights))
    return mixed.withColumnsRenamed({v: k for k, v in own.items()}).select(*map(quoted, docs.columns))
