"""Block-max postings: an inverted index in blocks of neighbouring chunks, each with the most that a term can add there, and a top-k that skips blocks.

Chunks are laid out by container and by a signature of their terms, so that alike ones (copies, one language) stand together, and cut into shards and these into blocks. A posting row is a
term's chunks within one shard, beside the greatest impact of each block that it has there; impacts are BM25's share that does not depend on the query. A search shuffles the rows of
asked terms once, to the task that holds their shard. There the blocks that promise most are scored; of the others only the terms and chunks are opened by which the
k-th score found can still be reached. The result is that of scoring everything.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from ..plans.session import staged
from .search import B, BUCKET_PARTS, K1, Best, by_shard, chunks_of, containers_of, flat, over_shards, packed, statistics, terms, top

BLOCK = 64
FIRST = 8
SLACK = 1e-6  # of rounding, when bounds are compared; scores are rounded to 9 places
SIGNATURES = 2


@dataclass(frozen=True)
class BlockIndex:
    """postings: (bucket, shard, term, containers..., n, keys, tfs, lengths, places, tops, avg), keys and lengths with the empty term only; terms: (bucket, term, containers..., idf)."""

    postings: DataFrame
    terms: DataFrame
    containers: tuple[str, ...]
    block: int = BLOCK
    k1: float = K1
    b: float = B


def _laid_out(chunks: DataFrame, containers: list[str], key: str) -> DataFrame:
    """(_key, containers..., _t): chunks sorted by range on their containers and the least hashes of their terms."""
    parted = chunks.select(F.col(key).alias("_key"), *containers, terms(F.col("text")).alias("_t"))
    signs = [F.array_min(F.transform("_t", lambda t, i=i: F.xxhash64(F.lit(i), t))).alias(f"_s{i}") for i in range(SIGNATURES)]
    order = [*containers, *(f"_s{i}" for i in range(SIGNATURES)), "_key"]
    return parted.select("*", *signs).repartitionByRange(*order).sortWithinPartitions(*order).select("_key", *containers, "_t")


def _with_tops(block: int, k1: float, b: float, out: pa.Schema):
    """For mapInArrow over packed lists with `avg`: adds the greatest impact in each of their blocks, rounded up."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            size = pc.list_value_length(batch.column("keys")).to_numpy().astype(np.int64)
            tf, length = (x.flatten().fill_null(0).to_numpy(zero_copy_only=False) for x in (batch.column("tfs"), batch.column("lengths")))
            avg = np.repeat(batch.column("avg").fill_null(1.0).to_numpy(zero_copy_only=False), size)
            with np.errstate(divide="ignore", invalid="ignore"):
                impact = np.nan_to_num(tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg)))
            at = flat(batch.column("places")) // block
            row = np.repeat(np.arange(len(size)), size)
            starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])])
            offsets = pa.array(np.searchsorted(row[starts], np.arange(len(size) + 1)), pa.int32())
            tops = np.nextafter(np.maximum.reduceat(impact, starts).astype(np.float32), np.float32(np.inf))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(tops))], out, strict=True)], schema=out)

    return run


def block_index(chunks: DataFrame, containers: list[str] = ["classification"], key: str = "chunk_id", k1: float = K1, b: float = B, block: int = BLOCK) -> BlockIndex:  # noqa: B006
    """The index of all chunks, to be written once. The packed lists are staged: the greatest impacts need the statistics of all."""
    lists = staged(packed(_laid_out(chunks, containers, key), containers))
    stats = statistics(lists, containers)  # a row for each container
    rows = _joined(lists, F.broadcast(stats.withColumnRenamed("_avg", "avg").drop("_n")), containers)
    schema = StructType([*rows.schema.fields, StructField("tops", ArrayType(FloatType()))])
    postings = rows.mapInArrow(_with_tops(block, k1, b, to_arrow_schema(schema)), schema)
    # a chunk's key and length stand once in its shard, with the empty term
    postings = postings.withColumns({c: F.when(F.col("term") == "", F.col(c)) for c in ("keys", "lengths")})
    found = _joined(lists.where("term <> ''").groupBy("bucket", "term", *containers).agg(F.sum("n").alias("_df")), F.broadcast(stats), containers)
    idf = F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    return BlockIndex(postings, found.select("bucket", "term", *containers, idf.alias("idf")), tuple(containers), block, k1, b)


def write_block_index(chunks: DataFrame, path: str, containers: list[str] = ["classification"], key: str = "chunk_id", block: int = BLOCK) -> None:  # noqa: B006
    """Puts the index of the chunks in place of the one at path, both tables or none; rows of a bucket lie sorted by term in BUCKET_PARTS files."""
    from .store import write_together

    made = block_index(chunks, containers, key, block=block)
    postings = made.postings.repartition("bucket", F.pmod("shard", F.lit(BUCKET_PARTS))).sortWithinPartitions("bucket", "term")
    write_together({f"{path}/postings": postings, f"{path}/terms": made.terms.repartition("bucket").sortWithinPartitions("bucket", "term")}, {f"{path}/postings": ["bucket"], f"{path}/terms": ["bucket"]})


def read_block_index(spark: SparkSession, path: str, containers: list[str] = ["classification"], block: int = BLOCK) -> BlockIndex:  # noqa: B006
    """block: as it was written."""
    from .store import read_snapshot

    return BlockIndex(read_snapshot(spark, f"{path}/postings"), read_snapshot(spark, f"{path}/terms"), tuple(containers), block)


def _joined(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """a with b's other columns where all of `on` are equal, nulls too."""
    names = {c: f"_r{i}" for i, c in enumerate(on)}
    right = b.withColumnsRenamed(names)
    test: Column = F.lit(True)
    for c, r in names.items():
        test = test & a[c].eqNullSafe(right[r])
    return a.join(right, test, how).drop(*names.values())


def _skipping(keys: list[str], n: int, ids: list, of: list[np.ndarray], shown: bool, per_block: int, k1: float, b: float, first: int, out: pa.Schema):
    """For mapInArrow, as search._scored(), with terms in the order of their bounds: a posting is opened only if its chunk's sum and what the terms from it on can add in its block reach the n-th score.

    Beside the best rows there is one without a key for each query and container, whose score is the number of postings opened.
    """
    opened: dict[tuple, np.ndarray] = {}

    def score(best: Best, rows: pa.RecordBatch, may: np.ndarray | None) -> None:
        for kind, at in containers_of(rows, keys).items():
            mine = rows.take(pa.array(at))
            empty = pa.array(mine.column("number").to_numpy() == len(of) - 1)
            every, mine = mine.filter(empty), mine.filter(pc.invert(empty))
            if not mine.num_rows:
                continue
            known, length, seen = chunks_of(every, may)
            numbers, size = mine.column("number").to_numpy(), pc.list_value_length(mine.column("places")).to_numpy()
            doc, tf = flat(mine.column("places")), flat(mine.column("tfs"))
            w, avg = (np.repeat(mine.column(c).to_numpy(), size) for c in ("_w", "_avg"))
            part = w * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / avg))
            names, block = np.unique(doc // per_block, return_inverse=True)
            ends, row = np.r_[0, np.cumsum(size)], np.repeat(np.arange(len(size)), size)
            starts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (row[1:] != row[:-1])])
            place, its = block[starts], np.searchsorted(row[starts], np.arange(len(size) + 1))  # of each list's blocks
            tops = np.repeat(mine.column("_w").to_numpy(), np.diff(its)) * flat(mine.column("tops")).astype(float)
            home = np.zeros(len(known), int)
            home[doc] = block
            count = opened.setdefault(kind, np.zeros(len(ids), np.int64))
            lists: dict[int, list[int]] = {}
            for i, t in enumerate(numbers):
                for q in of[t]:
                    lists.setdefault(int(q), []).append(i)
            for q, its_lists in lists.items():
                its_lists.sort(key=lambda i: (-tops[its[i] : its[i + 1]].max(), i))
                bounds = np.zeros((len(its_lists) + 1, len(names)))
                for r, i in enumerate(its_lists):
                    bounds[r, place[its[i] : its[i + 1]]] = tops[its[i] : its[i + 1]]
                bounds = np.cumsum(bounds[::-1], axis=0)[::-1]  # what the terms from each one on can add, by block
                begun = np.zeros(len(names), bool)
                begun[np.argsort(-bounds[0], kind="stable")[: first + -(-n // per_block)]] = True
                sums, least = np.zeros(len(known)), -np.inf
                held = best.kinds.get(kind)
                if held is not None:
                    least = held["least"][q] - SLACK
                for turn in (begun, ~begun):
                    for r, i in enumerate(its_lists):
                        a, z = ends[i], ends[i + 1]
                        d, x = doc[a:z], block[a:z]
                        go = seen[d] & turn[x] & (sums[d] + bounds[r][x] >= least)
                        d = d[go]
                        sums[d] += part[a:z][go]
                        count[q] += len(d)
                    if turn is begun:
                        have = sums[begun[home] & (sums > 0)]
                        if len(have) >= n:
                            least = max(least, np.partition(have, -n)[-n] - SLACK)
                near = np.flatnonzero((sums > 0) & (sums >= least))
                if len(near):
                    best.scored(kind, sums[None, near], np.array([q]), known[near])

    def counts():
        for kind, count in opened.items():
            q = np.flatnonzero(count)
            tags = [pa.array([t] * len(q), f.type) for t, f in zip(kind, list(out)[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q], out.field(0).type), *tags, pa.nulls(len(q), out.field(len(out) - 2).type), pa.array(count[q].astype(float))], schema=out)

    return by_shard(score, n, ids, shown, out, counts)


def block_top(queries: DataFrame, index: BlockIndex, n: int, visible: DataFrame | None = None, query: str = "qid", key: str = "chunk_id", first: int = FIRST, read: list | None = None) -> DataFrame:
    """(qid, containers, key, score, rank) by BM25 with statistics of each whole container; the rows of search.bm25_top().

    queries: (qid, text). visible: (key), limits what is ranked, not what is counted. In each shard the `first` + n / BLOCK blocks of greatest promise, and the shards that a task has
    seen, give a k-th score for each query and container, by which the rest of the shard is skipped. Only n rows a task, query and container are shuffled; bounds stay in their task.
    read: gets a frame (qid, containers, n) of the numbers of postings that are opened, for those who count them.
    """
    kinds, sizes = list(index.containers), (index.block, index.k1, index.b)

    def weighed(rows: DataFrame, words: list[str], buckets: list[int]) -> DataFrame:
        numbers = rows.sparkSession.createDataFrame(pa.table({"term": words, "number": pa.array(range(len(words)), pa.int32())}))
        rows = rows.join(F.broadcast(numbers), "term")
        weights = index.terms.where(F.col("bucket").isin(buckets)).join(F.broadcast(numbers), "term").select("number", *kinds, F.col("idf").alias("_w"))
        return _joined(rows, F.broadcast(weights), ["number", *kinds], "left").withColumn("_avg", F.col("avg"))

    def scorer(ids: list, of: list, shown: bool, out: pa.Schema):
        return _skipping(kinds, n, ids, of, shown, *sizes, first, out)

    found = over_shards(queries, index.postings, visible, kinds, query, key, weighed, scorer, ["tfs", "lengths", "places", "tops", "_w", "_avg"])
    if read is not None:
        found = staged(found)
        read.append(found.where(F.col(key).isNull()).select(query, *kinds, F.col("score").cast("long").alias("n")))
    return top(found.where(F.col(key).isNotNull()), [query, *kinds], n, F.desc("score"), F.asc(key))
