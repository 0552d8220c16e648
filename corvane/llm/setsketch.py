"""Near-duplicate documents by SetSketch registers.

A document's set of word shingles is summarised by registers K = floor(1 - log_b(x)), cut to one byte, where
x is the least of exponentially distributed values that a register's hash gives the shingles. Registers of a union are the
greater ones (mergeable); two documents agree in a register about as often as their sets overlap (locality-sensitive).

Bands of ROWS registers are bucket keys. In each bucket every member is a candidate with the bucket's least member only; so a group of k
copies has k - 1 candidates in a bucket, not k squared. Candidates pass an estimate by joint likelihood of the three
register outcomes (greater, less, equal) with a margin of MARGIN deviations, then the full sets are compared. Links give components.

In some buckets members then lie outside the bucket's largest component. The registers of these strays are compared with
those of all members in other components, block by block; of each such component the likeliest member is a
candidate. Strays that its full set does not link are compared with the full sets of all likely members of that component, which are cut into blocks on both sides, too.
So no pair in a bucket goes untried whose estimate passes, and members that are linked by way of others cost nothing.

A pair of similarity 0.8 shares no bucket with a probability of about 1e-6, and its estimate fails the margin with one of about 3e-6.

Equal sets are one node from the start.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SHARD_BYTES, bounded, distinct, in_parts, mix, packed, quoted, staged, text_bytes, to_bytes, unpacked, windows, with_id, without_id, word_hashes_of
from .components import components

BANDS, ROWS = 46, 6
BASE, RATE = 1.08, 20.0
MARGIN, SMALL = 4.5, 8
#: rows of a block: sketches, and full sets by their shingles; nodes, or pairs, for a task
BLOCK, SHINGLES, NODES, PAIRS = 4096, 1 << 19, 40_000, 8_000
SHINGLE, SALT = 0x8A5CD789635D2DFF, 0x121FD2155C472F96
_rng = np.random.default_rng(20)
FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


# -- sets and sketches ------------------------------------------------------------------------------------------


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct n-word shingles, A-Z in lower case; fewer words are one shingle."""
    out = []
    for h in word_hashes_of([to_bytes(t).lower() for t in texts]):
        size = min(n, len(h))
        out.append(distinct(mix(windows(h, size, SHINGLE) + np.uint64(SALT * size % (1 << 64)))) if size else np.empty(0, np.uint64))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        h = shingles[i : i + 2048] * FACTORS[:, None]
        h += OFFSETS[:, None]
        np.minimum(least, h.min(axis=1), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1.0 - np.log(np.maximum(x, 1e-300)) / math.log(BASE)), 0, 255).astype(np.uint8)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of rows of registers, given the sizes of the sets."""
    up, down = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - up - down
    u = (n_a / (n_a + n_b))[:, None]
    v = 1.0 - u
    j = np.linspace(0.0, 1.0, 129)[None, :] * np.minimum(u / v, v / u)
    chance = lambda x: -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)
    tiny = 1e-12
    p, q = np.maximum(chance(u - v * j), tiny), np.maximum(chance(v - u * j), tiny)
    fit = up[:, None] * np.log(p) + down[:, None] * np.log(q) + same[:, None] * np.log(np.maximum(1 - p - q, tiny))
    return np.take_along_axis(j, fit.argmax(axis=1)[:, None], axis=1)[:, 0]


def _sketches(n: int):
    def run(batches):
        for part in in_parts(batches, "text"):
            sets = shingle_sets(part.column("text").to_pylist(), n)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part.column("doc_id"),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "content": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    "registers": pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                }
            )

    return run


def sketch(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the set and its registers (both null without words)."""
    return bounded(with_id(docs.select("doc_id", "text"))).mapInArrow(_sketches(n), "doc_id long, n_shingles long, content binary, registers binary")


# -- candidates and links ---------------------------------------------------------------------------------------


def buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, band, node, hub) for all members of buckets with two nodes at least; the hub is the least."""
    key = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("registers", i * ROWS + 1, F.lit(ROWS))))
    members = nodes.select("node", F.posexplode(key).alias("band", "bucket"))
    hubs = members.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").drop("last")
    return members.join(hubs, "bucket").select("bucket", "band", "node", "hub")


def _likely(floor: float, percent: int):
    def run(batches):
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 512):
                part = batch.slice(at, 512)
                n_a, n_b = part.column("n_a").to_numpy().astype(float), part.column("n_b").to_numpy().astype(float)
                keep = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
                if part.num_rows:
                    keep &= similarity(_grid(part, "r_a"), _grid(part, "r_b"), n_a, n_b) >= floor
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(keep))

    return run


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = overlap(a, b)
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


class Sets:
    """The shingle sets of texts by node, the latest ones kept up to a bounded number of shingles."""

    def __init__(self, n: int):
        self.n, self.kept, self.held = n, {}, 0

    def __call__(self, node: int, text: str | None) -> np.ndarray:
        found = self.kept.get(node)
        if found is None or found[0] != text:
            if self.held > SHINGLES:
                self.kept, self.held = {}, 0
            found = self.kept[node] = text, shingle_sets([text], self.n)[0]
            self.held += len(found[1])
        return found[1]


def _linked(n: int, percent: int):
    def run(batches):
        sets = Sets(n)
        for part in in_parts(batches, "t_a", "t_b"):
            rows = zip(*(part.column(c).to_pylist() for c in ("a", "b", "t_a", "t_b")), strict=True)
            out = [(a, b) for a, b, x, y in rows if _alike(sets(a, x), sets(b, y), percent)]
            yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return run


def links(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) of nodes whose full sets overlap enough; texts: (doc_id, text) of all nodes in pairs."""
    text = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t_{x}"))
    return bounded(pairs.join(text("a"), "a").join(text("b"), "b")).mapInArrow(_linked(n, percent), "a long, b long").distinct()


def likely(pairs: DataFrame, nodes: DataFrame, floor: float, percent: int) -> DataFrame:
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    return bounded(pairs.join(side("a"), "a").join(side("b"), "b")).mapInArrow(_likely(floor, percent), "a long, b long")


def _grid(table: pa.Table | pa.RecordBatch, column: str = "registers") -> np.ndarray:
    return np.frombuffer(b"".join(table[column].to_pylist()), np.uint8).reshape(table.num_rows, -1)


def _promising(own: np.ndarray, n: int, grid: np.ndarray, sizes: np.ndarray, floor: float, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the grid that may link with a set of n shingles, likeliest first, and their estimates."""
    at = np.flatnonzero((100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)) & ((grid == own).mean(axis=1) >= floor))
    parts = [similarity(np.broadcast_to(own, grid[x].shape), grid[x], np.full(len(x), float(n)), sizes[x].astype(float)) for x in np.split(at, range(512, len(at), 512))]
    j = np.concatenate(parts) if len(at) else np.empty(0)
    order = np.argsort(-j, kind="stable")
    order = order[j[order] >= floor]
    return at[order], j[order]


CANDIDATES = "node long, part long, other long, estimate double"


def _outside(floor: float, percent: int):
    """Of each component that a stray may belong to, by a block of a bucket's members: the likeliest member."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            grid, sizes, parts, others = _grid(right, "o_registers"), *(right[c].to_numpy() for c in ("o_n_shingles", "o_part", "o_node"))
            for own, node, part, n in zip(_grid(left), *(left[c].to_pylist() for c in ("node", "part", "n_shingles")), strict=True):
                at, j = _promising(own, n, grid, sizes, floor, percent)
                there = parts[at]
                first = np.unique(there, return_index=True)[1]
                out += [(node, int(there[i]), int(others[at[i]]), float(j[i])) for i in first.tolist() if there[i] != part]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table({c.split()[0]: pa.array([x[i] for x in out], kind) for i, (c, kind) in enumerate(zip(CANDIDATES.split(", "), kinds, strict=True))})

    return run


def strays_of(dealt: DataFrame, nodes: DataFrame, placed: DataFrame, floor: float, percent: int) -> DataFrame:
    """(node, part, other): for members outside the largest component of a bucket, the other components with a likely member there, and the likeliest."""
    here = dealt.select("bucket", "node").join(placed, "node")
    main = here.groupBy("bucket", "part").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "part")).alias("x"), F.sum("n").alias("members")).where("x.n < members")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    main = main.select("bucket", F.col("x.part").alias("main"), blocks(F.col("members") - F.col("x.n")).alias("s"), blocks(F.col("members")).alias("m"))
    mixed = here.join(main, "bucket").join(nodes.select("node", "n_shingles", "registers"), "node")
    block = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    strays = mixed.where("part <> main").select("bucket", block("s").alias("s"), each("m").alias("m"), "node", "part", "n_shingles", "registers")
    # new names, as both sides stem from the same columns
    others = mixed.select(F.col("bucket").alias("o_bucket"), each("s").alias("o_s"), block("m").alias("o_m"), *(F.col(c).alias(f"o_{c}") for c in ("node", "part", "n_shingles", "registers")))
    key = ["bucket", "s", "m"]
    found = strays.groupBy(*key).cogroup(others.groupBy(*(f"o_{c}" for c in key))).applyInArrow(_outside(floor, percent), CANDIDATES)
    return found.groupBy("node", "part").agg(F.max(F.struct("estimate", "other")).alias("x")).select("node", "part", F.col("x.other").alias("other"))


def _joined_blocks(n: int, percent: int, floor: float):
    """Links (a, b) of a block of strays with a block of a component's members, one for each stray at most."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            grid, sizes, ids = _grid(right, "m_registers"), right["m_size"].to_numpy(), right["member"].to_pylist()
            texts, sets = right["t_member"], Sets(n)
            for own, node, size, text in zip(_grid(left), *(left[c].to_pylist() for c in ("node", "size", "t_node")), strict=True):
                (mine,) = shingle_sets([text], n)
                for at in _promising(own, size, grid, sizes, floor, percent)[0].tolist():
                    if _alike(mine, sets(ids[at], texts[at].as_py()), percent):
                        out.append((max(node, ids[at]), min(node, ids[at])))
                        break
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return run


def links_by_blocks(wanted: DataFrame, nodes: DataFrame, placed: DataFrame, texts: DataFrame, n: int, percent: int, floor: float) -> DataFrame:
    """Links between strays and all members of components; wanted: (node, part).

    Both sides are cut into blocks of a bounded number of shingles, and every block of one meets every block of the other.
    """
    sizes = nodes.select("node", "n_shingles")
    blocks = lambda frame, name: frame.groupBy("part").agg(F.ceil(F.sum("n_shingles") / SHINGLES).cast("int").alias(name))
    some = wanted.select("part").distinct()
    members = placed.join(some, "part").join(sizes, "node")
    cuts = blocks(wanted.join(sizes, "node"), "s").join(blocks(members, "m"), "part")
    block = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    full = nodes.select("node", "n_shingles", "registers").join(texts.withColumnRenamed("doc_id", "node"), "node")
    left = wanted.select("node", "part").join(cuts, "part").select("part", block("s").alias("s"), each("m").alias("m"), "node").join(full, "node")
    left = left.select("part", "s", "m", "node", F.col("n_shingles").alias("size"), "registers", F.col("text").alias("t_node"))
    right = members.select("node", "part").join(cuts, "part").select(F.col("part").alias("m_part"), each("s").alias("m_s"), block("m").alias("m_m"), "node").join(full, "node")
    right = right.select("m_part", "m_s", "m_m", F.col("node").alias("member"), F.col("n_shingles").alias("m_size"), F.col("registers").alias("m_registers"), F.col("text").alias("t_member"))
    return left.groupBy("part", "s", "m").cogroup(right.groupBy("m_part", "m_s", "m_m")).applyInArrow(_joined_blocks(n, percent, floor), "a long, b long").distinct()


def _regrouped(parts: DataFrame, more: DataFrame) -> DataFrame:
    """(node, component) after further links, from the components before."""
    return components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def _placed(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    return nodes.select("node").join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("part"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable by links, its own included) and kept (it is that one).

    Documents link if 100 * |both| >= percent * |either| for their sets of n-word shingles. A null or
    wordless text has an empty set and no link. Rows with the same id are one document: a link of any of its texts is its
    own. Rows without an id count as one document after all others. One row comes out for each row; other columns are left out.
    """
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, math.ceil(text_bytes(docs) / SHARD_BYTES))
    sketches = staged(sketch(docs, n).coalesce(tasks))
    count = sketches.count()
    # for few nodes few tasks and files, whatever the session's partitions
    lean = lambda frame, per=PAIRS: staged(frame.coalesce(max(8, math.ceil(count / per))))
    filled = sketches.where("content is not null")
    nodes = filled.groupBy("content").agg(F.min(F.struct("doc_id", "n_shingles", "registers")).alias("x")).select("content", F.col("x.doc_id").alias("node"), "x.n_shingles", "x.registers")
    nodes = staged(nodes.coalesce(max(1, math.ceil(count / NODES))))
    member = filled.select("doc_id", "content").distinct().join(nodes.select("content", "node"), "content").select("doc_id", "node")
    split = member.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b < last").drop("last")
    same_id = member.join(split, "doc_id").select(F.col("node").alias("a"), "b").where("a <> b")

    dealt = lean(buckets(nodes))
    met = dealt.select(F.col("node").alias("doc_id")).distinct()
    texts = lean(with_id(docs.select("doc_id", "text")).join(met, "doc_id", "left_semi").distinct())
    floor = (percent - MARGIN * math.sqrt(percent * (100 - percent) / len(FACTORS))) / 100
    tried = likely(dealt.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct(), nodes, floor, percent)
    parts = components(lean(links(tried, texts, n, percent).union(same_id)))
    placed = staged(_placed(nodes, parts).coalesce(max(1, math.ceil(count / NODES))))
    wanted = lean(strays_of(dealt, nodes, placed, floor, percent))
    if not wanted.isEmpty():
        parts = _regrouped(parts, lean(links(wanted.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct(), texts, n, percent)))
        # what the likeliest member did not link: every likely one of the component as it is now
        placed = staged(_placed(nodes, parts).coalesce(max(1, math.ceil(count / NODES))))
        still = wanted.join(placed.select(F.col("node").alias("other"), F.col("part").alias("there")), "other").join(placed.withColumnRenamed("part", "here"), "node")
        still = lean(still.where("here <> there").select("node", F.col("there").alias("part"), "other").distinct())
        if not still.isEmpty():
            members = placed.groupBy("part").agg(F.count("*").alias("members"))
            still = still.select("node", "part").distinct().join(members, "part")
            few = still.where(F.col("members") <= SMALL).join(placed.withColumnRenamed("node", "other"), "part").select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()
            few = links(likely(few, nodes, floor, percent), texts, n, percent)
            parts = _regrouped(parts, lean(few.union(links_by_blocks(still.where(F.col("members") > SMALL), nodes, placed, texts, n, percent, floor))))

    where = nodes.select("content", "node").join(parts, "node", "left").select("content", F.coalesce("component", "node").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles", "content").join(where, "content", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    return without_id(without_id(out), "component_id")


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, with its columns, that near_duplicates() keeps, one for each id (the first by its columns in order).

    Rows without an id have no group and all stay.
    """
    known = docs.where("doc_id is not null")
    kept = near_duplicates(known, n, percent).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    # maps have no order of their own
    order = [F.to_json(F.struct(F.col(f"_row.{quoted(f.name)}"))) if "map<" in f.dataType.simpleString() else F.col(f"_row.{quoted(f.name)}") for f in docs.schema]
    first = F.row_number().over(Window.partitionBy("_id").orderBy(*order))
    rows = packed(known, F.col("doc_id").cast("long").alias("_id")).join(kept, "_id", "left_semi").withColumn("_first", first).where("_first = 1")
    return unpacked(rows, docs.columns).unionByName(docs.where("doc_id is null"))
