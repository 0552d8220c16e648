"""Reply trees: messages that answer messages. Paths from root to leaf are ranked by score, and each chosen one becomes one conversation.

Self-joins of a table of ids alone climb the trees, each round twice as far as the one before, so a tree of depth d takes log2(d) rounds; they give
every leaf the score and length of its path without the path. Only chosen paths are then written out, over the same tables backwards, and only
these meet the texts. A message with many replies, or a tree with a third of all messages, is a key of larger join sides, which Spark splits.

The template marks turns with control strings. One that stands in a text gets a backslash after its first character (and one more if it has some); as that character
stands nowhere else in a control string, none arises where a text meets a mark.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, in_parts, staged, staged_path

# The template: what opens and closes a turn of these roles; other roles' turns carry their name.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[TURN]", "[TEXT]", "[/TURN]")
CONTROL = [c for pair in MARKS.values() for c in pair] + list(OTHER)
_CONTROL = "([<\\[])({})(" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")"
_BARE = re.compile(_CONTROL.format("\\\\*"))
_ESCAPED = re.compile(_CONTROL.format("\\\\+"))
_BY_OPENING = {pair[0]: (role, pair[1]) for role, pair in MARKS.items()}
_OPENING = re.compile("|".join(re.escape(c) for c in [*_BY_OPENING, OTHER[0]]))
TRAINED = "assistant"
TOGETHER = 3
SPANS = "array<struct<start: long, end: long>>"


# -- the template ---------------------------------------------------------------------------------------------------


def escaped(text: str) -> str:
    return _BARE.sub(r"\1\\\2\3", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def written(turns: Iterable[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation, and the code points [start, end) of its assistant texts: the loss mask."""
    out, spans, at = [], [], 0
    for role, text in turns:
        body = escaped(text or "")
        if role in MARKS:
            opening, closing = MARKS[role]
        else:
            opening, closing = OTHER[0] + escaped(role or "") + OTHER[1], OTHER[2]
        if role == TRAINED:
            spans.append((at + len(opening), at + len(opening) + len(body)))
        out += (opening, body, closing)
        at += len(opening) + len(body) + len(closing)
    return "".join(out), spans


def read(formatted: str) -> list[tuple[str, str]]:
    """The turns of a written conversation: role and text. One that `written` did not write raises ValueError."""
    turns, at = [], 0

    def until(mark: str) -> str:
        nonlocal at
        end = formatted.find(mark, at)
        if end < 0:
            raise ValueError(f"no {mark} after code point {at}")
        begin, at = at, end + len(mark)
        return unescaped(formatted[begin:end])

    while at < len(formatted):
        opening = _OPENING.match(formatted, at)
        if not opening:
            raise ValueError(f"no turn begins at code point {at}")
        at = opening.end()
        if opening[0] == OTHER[0]:
            role = until(OTHER[1])
            turns.append((role, until(OTHER[2])))
        else:
            role, closing = _BY_OPENING[opening[0]]
            turns.append((role, until(closing)))
    return turns


# -- trees ----------------------------------------------------------------------------------------------------------


def _climbed(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """nodes (tree, id, parent, score) -> the tables (tree, id, anc) of ancestors 1, 2, 4 ... up, and (tree, id, total, hops) of whole paths up to the root.

    A parent that is not there makes a root of its answer. Of messages that answer each other in a circle, the least is cut from its parent and counts as a root.
    """
    while True:
        there = nodes.select(F.col("tree").alias("_t"), F.col("id").alias("anc"))
        first = nodes.join(there, (nodes["tree"] == F.col("_t")) & (nodes["parent"] == F.col("anc")), "left")
        first = first.select("tree", "id", "anc", F.col("anc").alias("least"), F.col("score").alias("total"), F.lit(1).cast("long").alias("hops"))
        # a table a round, of the messages that still climbed: the rows without anc of all of them have reached a root, and climb no more
        paths, levels, reach = [staged_path(first)], [], 1
        read = lambda *some, schema=first.schema: nodes.sparkSession.read.schema(schema).parquet(*some)
        n = read(*paths).count()
        while (active := read(paths[-1]).where("anc is not null")).limit(1).count() and reach <= 2 * n:
            levels.append(active.select("tree", "id", "anc"))
            met = read(paths[-1]) if len(paths) == 1 else read(*paths[:-1]).where("anc is null").union(read(paths[-1]))
            b = met.select(F.col("tree").alias("_t"), F.col("id").alias("_id"), F.col("anc").alias("_anc"), F.col("least").alias("_least"), F.col("total").alias("_total"), F.col("hops").alias("_hops"))
            joined = active.join(b, (F.col("tree") == F.col("_t")) & (F.col("anc") == F.col("_id")))
            paths.append(staged_path(joined.select("tree", "id", F.col("_anc").alias("anc"), F.least("least", "_least").alias("least"), (F.col("total") + F.col("_total")).alias("total"), (F.col("hops") + F.col("_hops")).alias("hops"))))
            reach *= 2
        if not active.limit(1).count():
            return levels, read(*paths).where("anc is null").select("tree", "id", "total", "hops")
        # who is the least of all that stand above it stands above itself
        cut = active.where("least = id").select(F.col("tree").alias("_t"), F.col("id").alias("_id"), F.lit(True).alias("_cut"))
        nodes = staged(nodes.join(cut, (F.col("tree") == F.col("_t")) & (F.col("id") == F.col("_id")), "left").select("tree", "id", F.when(F.col("_cut").isNull(), F.col("parent")).alias("parent"), "score"))


def _paths(nodes: DataFrame, keep: int | None) -> DataFrame:
    """(tree, leaf, id, up, rank, score) for each message of each chosen path; up counts from the leaf."""
    levels, whole = _climbed(nodes)
    if levels:
        answered = levels[0].select(F.col("tree").alias("_t"), F.col("anc").alias("_a")).distinct()
        whole = whole.join(answered, (F.col("tree") == F.col("_t")) & (F.col("id") == F.col("_a")), "left_anti")
    leaves = whole.select("tree", F.col("id").alias("leaf"), (F.col("total") / F.col("hops")).alias("score"), "hops")
    if keep is None:
        leaves = leaves.withColumn("rank", F.lit(None).cast("int"))
    else:
        order = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("hops"), F.asc("leaf"))
        leaves = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    out = leaves.select("tree", "leaf", F.col("leaf").alias("id"), F.lit(0).cast("long").alias("up"), "rank", "score")
    for k, level in reversed(list(enumerate(levels))):
        above = level.select(F.col("tree").alias("_t"), F.col("id").alias("_id"), "anc")
        both = F.filter(F.array(F.struct("id", "up"), F.struct(F.col("anc").alias("id"), (F.col("up") + (1 << k)).alias("up"))), lambda x: x["id"].isNotNull())
        joined = out.join(above, (F.col("tree") == F.col("_t")) & (F.col("id") == F.col("_id")), "left")
        out = joined.select("tree", "leaf", "rank", "score", F.explode(both).alias("_at")).select("tree", "leaf", "_at.id", "_at.up", "rank", "score")
        if k and k % TOGETHER == 0:  # else the driver holds one plan of all rounds
            out = staged(out)
    return out


def conversations(messages: DataFrame, keep: int | None = 1, links: DataFrame | None = None) -> DataFrame:
    """tree_id, leaf_id, rank, score, n_turns, text and loss of the `keep` best branches of each tree (all, without ranks, if None).

    messages: tree_id, message_id, parent_id, role, text, and score if there is one; parents and scores may stand in `links` (tree_id, message_id, parent_id, score)
    instead, so that texts need no join to get them. A branch is the path from a root to a message that none answers; its score is the
    mean of its messages' scores (null: 0), ties go to the longer branch, then to the lesser leaf. text is the written conversation, loss the
    spans of its assistant texts. Rows of one message (repeated ones too) follow each other in its turn, by role and text; of their parents the
    least counts, of their scores the greatest. A null parent, one that is not there, or the message itself: a root; a circle is cut at its least
    message. Null tree_ids are one tree, a null message_id is a message that none answers, a null role or text is empty. Other columns are left out; an empty
    table gives an empty one. A conversation is one row, so it must fit one; every other step goes by message.
    """
    key = lambda c: F.struct(F.col(c).alias("key"))  # noqa: E731  never null itself
    links = messages if links is None else links
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)) if "score" in links.columns else F.lit(0.0)
    rows = links.select(key("tree_id").alias("tree"), key("message_id").alias("id"), F.when(F.col("parent_id").isNotNull() & ~F.col("parent_id").eqNullSafe(F.col("message_id")), key("parent_id")).alias("parent"), score.alias("score"))
    nodes = staged(rows.groupBy("tree", "id").agg(F.min("parent").alias("parent"), F.max("score").alias("score")))
    paths = _paths(nodes, keep).withColumnsRenamed({"tree": "_t", "id": "_id"})
    texts = messages.select(key("tree_id").alias("tree"), key("message_id").alias("id"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    joined = paths.join(texts, (F.col("tree") == F.col("_t")) & (F.col("id") == F.col("_id")))
    turn = F.struct((-F.col("up")).alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = joined.groupBy("tree", "leaf").agg(F.first("rank").alias("rank"), F.first("score").alias("score"), F.sort_array(F.collect_list(turn)).alias("turns"))
    grouped = grouped.select(F.col("tree.key").alias("tree_id"), F.col("leaf.key").alias("leaf_id"), "rank", "score", F.size("turns").cast("long").alias("n_turns"), F.col("turns.role").alias("_roles"), F.col("turns.text").alias("_texts"))
    kept = grouped.columns[:5]

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            made = [written(zip(r, t, strict=True)) for r, t in zip(batch.column("_roles").to_pylist(), batch.column("_texts").to_pylist(), strict=True)]
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([t for t, _ in made], pa.string()), spans], [*kept, "text", "loss"])

    schema = grouped.select(*kept, F.lit("").cast("string").alias("text"), F.lit(None).cast(SPANS).alias("loss")).schema
    return bounded(grouped).mapInArrow(run, schema)


def as_replies(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages and links of plain conversations (conv_id, turn, role, text), whose turns each answer the one before.

    A message's id is its turn and a hash of its role and text; rows of one conversation and turn follow each other by that hash, null turns come first.
    Only ids are sorted, within a conversation.
    """
    told = F.struct(F.col("turn").alias("turn"), F.xxhash64("role", "text").alias("h"))
    rows = turns.select(F.col("conv_id").alias("tree_id"), told.alias("message_id"), "role", "text")
    ids = rows.select("tree_id", "message_id").distinct()
    return rows, ids.withColumn("parent_id", F.lag("message_id").over(Window.partitionBy("tree_id").orderBy("message_id")))


# -- what training reads --------------------------------------------------------------------------------------------

DIGESTS = {"n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}


def read_back(formatted: DataFrame, key: str = "tree_id") -> DataFrame:
    """The key, and from the columns text and loss alone: turns (role, newline, text, newline each) and loss texts as SHA-256, their sizes in code points."""

    def one(text: str, spans: Sequence[dict]) -> tuple:
        turns = read(text)
        loss = "".join(unescaped(text[s["start"] : s["end"]]) for s in spans)
        sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        return len(turns), sha("".join(f"{role}\n{body}\n" for role, body in turns)), len(loss), sha(loss), len(text)

    def run(batches: Iterable[pa.RecordBatch]):
        for part in in_parts(batches, "text"):
            rows = [one(t, s) for t, s in zip(part.column("text").to_pylist(), part.column("loss").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(DIGESTS.values()))], [key, *DIGESTS])

    asked = formatted.select(key, "text", "loss")
    schema = asked.select(key, *(F.lit(None).cast("long" if kind == pa.int64() else "string").alias(c) for c, kind in DIGESTS.items())).schema
    return asked.mapInArrow(run, schema)


# fixed value: the conversation that the contract adds
ADDED = [(-1, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(["user", "assistant"])]


def digests(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of each conversation and of ADDED, read back from what was written."""
    asked = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    every = asked.union(turns.sparkSession.createDataFrame(ADDED, "conv_id long, turn long, role string, text string"))
    messages, links = as_replies(every)
    return read_back(conversations(messages, links=links)).withColumnRenamed("tree_id", "conv_id")


_SQL_CONTROL = "([<\\[])(\\\\*)(" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")"
_SQL_MARKS = " ".join(f"when '{role}' then '{a}' || body || '{b}'" for role, (a, b) in MARKS.items())
ORACLE = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all values {", ".join(f"({i}, {n}, '{r}', '{x}')" for i, n, r, x in ADDED)}),
e as (select *, regexp_replace(text, '{_SQL_CONTROL}', '\\1\\\\\\2\\3', 'g') as body, regexp_replace(role, '{_SQL_CONTROL}', '\\1\\\\\\2\\3', 'g') as name from t),
w as (select *, case role {_SQL_MARKS} else '[TURN]' || name || '[TEXT]' || body || '[/TURN]' end as said from e)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(said)) as bigint) as formatted_chars from w group by conv_id"""
