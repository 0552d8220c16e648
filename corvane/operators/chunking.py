"""Sections to chunks, in native expressions.

Prose is cut into windows of TARGET words that overlap by int(TARGET * OVERLAP); tables and images stay whole, but a table
over TABLE_MAX words is split by rows with its first two lines repeated. chunk_index runs across a document's sections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET, OVERLAP, TABLE_MAX = 512, 0.15, 700
ATOMIC = ("table", "image")
SPACE = r"(?U)\s+"


def collapse_runs(text: Column) -> Column:
    """Four or more of one non-space character become three."""
    return F.regexp_replace(text, r"(\S)\1{3,}", "$1$1$1")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """White-space separated words; none for a blank text."""
    bare = strip(text)
    return F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def window_starts(n_words: Column, target: int = TARGET, overlap: float = OVERLAP) -> Column:
    """Offsets of the windows: one if all fits, else ceil((n - target) / step) + 1; none for no words."""
    if not 0 <= overlap < 1 or target < 1:
        raise ValueError("overlap must be at least 0 and less than 1, and target positive")
    step = target - int(target * overlap)
    last = F.when(n_words <= target, F.lit(0)).otherwise(F.ceil((n_words - target) / step).cast("int") * step)
    return F.when(n_words == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), last, F.lit(step)))


def windows(text: Column, target: int = TARGET, overlap: float = OVERLAP) -> Column:
    def cut(w: Column) -> Column:
        return F.transform(window_starts(F.size(w), target, overlap), lambda s: F.array_join(F.slice(w, s + 1, target), " "))

    # binds the words once: each use of `w` inside is a variable, not the split again
    return F.flatten(F.transform(F.array(words(text)), cut))


def table_pieces(text: Column, most: int = TABLE_MAX) -> Column:
    """Row groups of at most `most` words, each with the first two lines; a row over that stays whole; under three lines all stays."""
    count = lambda line: F.size(words(line))
    lines = F.split(text, "\n", -1)

    def split_rows(x: Column) -> Column:
        head = F.slice(x, 1, 2)
        base = count(F.get(x, F.lit(0))) + count(F.get(x, F.lit(1)))
        none = F.array().cast("array<string>")
        start = F.struct(F.array().cast("array<array<string>>").alias("done"), none.alias("rows"), base.alias("n"))

        def step(state: Column, row: Column) -> Column:
            n = count(row)
            full = (F.size(state["rows"]) > 0) & (state["n"] + n > most)
            closed = F.concat(state["done"], F.array(state["rows"]))
            return F.when(full, F.struct(closed.alias("done"), F.array(row).alias("rows"), (base + n).alias("n"))).otherwise(
                F.struct(state["done"].alias("done"), F.concat(state["rows"], F.array(row)).alias("rows"), (state["n"] + n).alias("n"))
            )

        groups = F.aggregate(F.slice(x, 3, F.size(x)), start, step, lambda s: F.concat(s["done"], F.filter(F.array(s["rows"]), lambda r: F.size(r) > 0)))
        return F.transform(groups, lambda rows: F.array_join(F.concat(head, rows), "\n"))

    whole = F.array(text)
    return F.when((F.size(words(text)) <= most) | (F.size(lines) < 3), whole).otherwise(F.flatten(F.transform(F.array(lines), split_rows)))


def pieces(text: Column, content_type: Column, target: int = TARGET, overlap: float = OVERLAP, table_max: int = TABLE_MAX) -> Column:
    bare = strip(text)
    return (
        F.when(F.length(bare) == 0, F.array().cast("array<string>"))
        .when(content_type == "table", table_pieces(bare, table_max))
        .when(content_type.isin(*ATOMIC), F.array(bare))
        .otherwise(windows(collapse_runs(bare), target, overlap))
    )


def chunk_sections(sections: DataFrame, key: str = "doc_id", target: int = TARGET, overlap: float = OVERLAP, table_max: int = TABLE_MAX) -> DataFrame:
    """(key, chunk_index, text, heading, page_or_slide, content_type) from rows (key, sections array<struct>).

    sections: an array of (text, heading, page_or_slide, content_type) in reading order; one row per document, so the running index
    is a flattened position and needs no shuffle.
    """
    made = F.flatten(
        F.transform(
            "sections",
            lambda s: F.transform(
                pieces(s["text"], s["content_type"], target, overlap, table_max),
                lambda p: F.struct(p.alias("text"), s["heading"].alias("heading"), s["page_or_slide"].alias("page_or_slide"), s["content_type"].alias("content_type")),
            ),
        )
    )
    return sections.select(key, F.posexplode(made).alias("chunk_index", "_c")).select(key, "chunk_index", "_c.*")


def as_sections(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text as one section of prose."""
    none = F.lit(None)
    one = F.struct(F.col(text).alias("text"), none.cast("string").alias("heading"), none.cast("int").alias("page_or_slide"), F.lit("text").alias("content_type"))
    return documents.withColumn("sections", F.array(one)).drop(text)


def token_windows(tokens: Column, query_tokens: Column, max_length: int, overlap: float = 0.25) -> Column:
    """Windows of a token array for a pair scorer: the budget left by the query and three marks, a stride of three quarters."""
    budget = F.greatest(F.lit(1), F.lit(max_length) - F.size(query_tokens) - 3)
    stride = F.greatest(F.lit(1), F.floor(budget * (1 - overlap)).cast("int"))
    n = F.size(tokens)
    last = F.when(n <= budget, F.lit(0)).otherwise(F.ceil((n - budget) / stride).cast("int") * stride)
    return F.transform(F.sequence(F.lit(0), last, stride), lambda s: F.slice(tokens, s + 1, budget))


def bounded_contexts(contexts: DataFrame, most_chars: int, case: str = "qid") -> DataFrame:
    """contexts (case, rank, text) with each text cut to most_chars // (contexts of the case), and whether it was."""
    from pyspark.sql import Window

    room = F.floor(F.lit(most_chars) / F.count("*").over(Window.partitionBy(case))).cast("int")
    return contexts.withColumn("_room", room).withColumn("truncated", F.length("text") > F.col("_room")).withColumn("text", F.expr("left(text, _room)")).drop("_room")


def uuid5(namespace: Column, name: Column) -> Column:
    """RFC 4122 version 5 id, from the namespace's id string."""
    digest = F.sha1(F.concat(F.unhex(F.translate(namespace, "-", "")), F.encode(name, "utf-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    part = lambda i, n: F.substring(digest, i, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def chunk_id(document_id: Column, chunk_index: Column) -> Column:
    """The stable id of a chunk, so that writing it twice changes nothing."""
    return uuid5(document_id, F.concat(F.lit("chunk:"), chunk_index.cast("string")))


def carried_headings(sections: DataFrame, by: str = "doc_id", order: str = "pos", heading: str = "heading") -> DataFrame:
    """sections in which one without a heading has the nearest heading before it in its document; null before the first."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return sections.withColumn(heading, F.last(F.nullif(F.trim(heading), F.lit("")), ignorenulls=True).over(before))
