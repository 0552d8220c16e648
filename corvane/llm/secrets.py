"""Secret scans by corpus-wide ownership frequency, with DataFrame functions only.

Spans of each kind are the leftmost non-overlapping matches of a pattern: the text is parted at the matches, and the
lengths of parts and matches add up to offsets in code points. Every candidate's value is hashed; the distinct owners and repositories
that hold a hash are counted over the whole corpus. Values with MANY owners or more, or with several owners and MANY_REPOSITORIES or more repositories, are widely copied
examples; others, and all values of one owner, count as live. An owner is a value of one column, `source` unless another is named; where few sources stand for many people, values of few sources are live.
Long mixed tokens that no base pattern finds are added as spans of kind `token` if they are live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, staged, unpacked, with_id, without_id

MANY = 3
MANY_REPOSITORIES = 6
STRETCH = 256
KINDS = ["assign", "access", "hex", "token"]
# fixed values: the contract's base patterns (kind, pattern, group of the value, least length of the value)
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [("assign", ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24)]
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])"
SPAN = "struct<start:int,kind:int,stop:int,value:bigint>"
MASK = "<SECRET>"


def spans(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """An array of SPAN of the pattern's leftmost non-overlapping matches whose value has the least length."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    parts = F.split(text, pattern, -1)

    def walk(x: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            start = state["at"] + F.length(F.get(x["parts"], i))
            stop = start + F.length(F.get(x["hits"], i))
            value = F.get(x["values"], i)
            one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop"), F.xxhash64(value).alias("value"))
            more = F.when(F.length(value) >= least, F.concat(state["found"], F.array(one))).otherwise(state["found"])
            return F.struct(stop.alias("at"), more.alias("found"))

        def stretch(state: Column, begin: Column) -> Column:
            """STRETCH matches: their array grows by itself, as each step copies it."""
            start = F.struct(state["at"].alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))
            done = F.aggregate(F.sequence(begin, F.least(begin + STRETCH, F.size(x["hits"])) - 1), start, step)
            return F.get(F.transform(F.array(done), lambda d: F.struct(d["at"].alias("at"), F.concat(state["all"], F.array(d["found"])).alias("all"))), F.lit(0))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("all"))
        return F.aggregate(F.sequence(F.lit(0), F.size(x["hits"]) - 1, F.lit(STRETCH)), start, stretch, lambda s: F.flatten(s["all"]))

    once = F.transform(F.array(F.struct(parts.alias("parts"), hits.alias("hits"), values.alias("values"))), walk)
    return F.when(text.rlike(pattern), F.get(once, F.lit(0))).otherwise(F.array().cast(f"array<{SPAN}>"))


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["stop"]) & (b["start"] < a["stop"])


def scanned(docs: DataFrame, owner: str, repository: list[str]) -> DataFrame:
    """docs with `base` and `more`: the spans of the base kinds, in order, and further candidates that overlap none of them; with owner and repository.

    The text is not kept; `content` is a hash that tells rows of one id apart.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = lambda c: F.coalesce(F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(name(owner)).alias("owner"), F.xxhash64(*(name(c) for c in [owner, *repository])).alias("repository"))
    rows = rows.withColumn("content", F.xxhash64("text"))
    for k, (kind, pattern, group, least) in enumerate(BASE):
        rows = rows.withColumn(kind, spans(F.col("text"), k, pattern, group, least))
    rows = rows.withColumn("token", spans(F.col("text"), len(BASE), TOKEN, 0, 20)).drop("text")
    rows = rows.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    more = F.when(F.size("token") == 0, F.col("token")).otherwise(F.filter("token", lambda t: ~F.exists("base", lambda b: _overlaps(t, b))))
    return with_id(rows.select("doc_id", "content", "owner", "repository", "base", more.alias("more")))


def frequency(scans: DataFrame) -> DataFrame:
    """(value, owners, repositories): how many distinct ones hold each candidate; counted by owner first, so a common value is many rows no more."""
    found = scans.select("owner", "repository", F.explode(F.concat("base", "more")).alias("span")).select(F.col("span.value").alias("value"), "owner", "repository").distinct()
    by_owner = found.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def _joined(found: Column) -> Column:
    parts = F.transform(found, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string")))
    return F.array_join(parts, ",")


def widely_copied(owners: Column, repositories: Column, many: int, many_repositories: int) -> Column:
    return (owners >= many) | ((owners > 1) & (repositories >= many_repositories))


def judged(scans: DataFrame, many: int = MANY, many_repositories: int = MANY_REPOSITORIES) -> DataFrame:
    """scans with `all`: every span that stands, in order, each with its numbers of owners and repositories, and whether it is live.

    A value that a third of all rows hold is a key of the larger side of a join, which Spark splits; its frequency is one row.
    """
    one = scans.where(F.size("base") + F.size("more") > 0).select("doc_id", "content", F.explode(F.concat("base", "more")).alias("span")).distinct()
    one = one.withColumn("value", F.col("span.value")).join(frequency(scans), "value").withColumn("live", ~widely_copied(F.col("owners"), F.col("repositories"), many, many_repositories))
    one = one.where((F.col("span.kind") < len(BASE)) | F.col("live"))
    mark = F.struct(F.col("span.start").alias("start"), F.col("span.kind").alias("kind"), F.col("span.stop").alias("stop"), "owners", "repositories", "live")
    found = one.groupBy("doc_id", "content").agg(F.array_sort(F.collect_list(mark)).alias("all"))  # the spans of one text
    empty = F.array().cast("array<struct<start:int,kind:int,stop:int,owners:bigint,repositories:bigint,live:boolean>>")
    return scans.join(found, ["doc_id", "content"], "left").withColumn("all", F.coalesce("all", empty))


def scan(docs: DataFrame, owner: str = "source", repository: list[str] = ["lang"], many: int = MANY, many_repositories: int = MANY_REPOSITORIES) -> DataFrame:  # noqa: B006
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, spread (owners/repositories of each span), n_live and n_example for each row.

    A null or empty text has no span, and base_sha256 is then that of an empty string. A null owner or repository part
    counts as the empty name. Repeated rows get equal results and count once in the frequencies. Other columns are left out.
    """
    rows = judged(staged(scanned(docs, owner, repository)), many, many_repositories)
    spread = F.transform("all", lambda s: F.concat_ws("/", s["owners"].cast("string"), s["repositories"].cast("string")))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    out = rows.select(
        "doc_id",
        *(number(k).alias(f"n_{kind}") for k, (kind, *_) in enumerate(BASE)),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("all")).alias("spans"),
        F.array_join(spread, ",").alias("spread"),
        F.size(F.filter("all", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("all", lambda s: ~s["live"])).cast("long").alias("n_example"),
    )
    return without_id(out)


def masked(text: Column, found: Column) -> Column:
    """The text with MASK in place of each span (sorted by start); a span that overlaps the one before adds no second mask."""

    def step(state: Column, s: Column) -> Column:
        gap = F.when(s["start"] >= state["at"], F.concat(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(MASK))).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), F.concat(state["done"], gap).alias("done"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))
    return F.when(F.size(found) == 0, text).otherwise(F.aggregate(found, start, step, lambda s: F.concat(s["done"], F.substring(text, s["at"] + 1, F.length(text)))))


def mask_live(docs: DataFrame, owner: str = "source", repository: list[str] = ["lang"], many: int = MANY, many_repositories: int = MANY_REPOSITORIES) -> DataFrame:  # noqa: B006
    """docs with live secrets masked in `text` (and `n_chars` set to its new length, if there is such a column); widely copied examples stay.

    Null texts stay null; rows come out one for one with the same columns.
    """
    found = judged(staged(scanned(docs, owner, repository)), many, many_repositories)
    live = found.select("doc_id", "content", F.filter("all", lambda s: s["live"]).alias("_live")).where(F.size("_live") > 0).distinct()
    live = live.select(F.col("doc_id").alias("_id"), F.col("content").alias("_content"), "_live")
    rows = with_id(packed(docs, F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_content")), "_id")
    old, found = F.col("_row.text"), F.col("_live")
    rows = rows.join(live, ["_id", "_content"], "left").withColumn("_text", F.when(found.isNull(), old).otherwise(masked(old, found)))
    instead = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        instead["n_chars"] = F.when(found.isNull(), F.col("_row.n_chars")).otherwise(F.length("_text").cast(docs.schema["n_chars"].dataType))
    return unpacked(rows, docs.columns, **instead)
