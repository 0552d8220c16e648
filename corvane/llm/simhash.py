"""SimHash fingerprints: hashes of weighted terms vote on the signs of BITS bits.

Terms are pairs of neighbouring words, A-Z in lower case (the word itself if it is the only one), weighted by a
rounded 1 + ln(count); weights are integers, so equal texts have equal fingerprints whatever the order of the sums.
Without words no bit is set.

All fingerprints within a Hamming radius are found by permuted block tables, each keyed by 32 of the 128 bits. Up to NARROW bits
apart, one of NARROW + 1 blocks agrees, so there is a table for each; up to BLOCKS - 2 bits apart, two of BLOCKS blocks do, and there is one for each pair.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, PART_BYTES, bounded, mix, shard_count, staged, to_bytes, windows, with_id, without_id, word_hashes_of

BITS, BLOCKS, NARROW = 128, 8, 3
WIDE = BLOCKS - 2
MOST_SHARDS = 10_000
VOTERS = 4096  # terms that vote at a time
TERM = 0xC2B2AE3D27D4EB4F


def fingerprints(texts: list[str]) -> np.ndarray:
    """A row of BITS / 8 bytes for each text."""
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    for row, h in enumerate(word_hashes_of([to_bytes(t).lower() for t in texts])):
        if len(h):
            terms, counts = np.unique(windows(h, min(2, len(h)), TERM), return_counts=True)
            weights = np.rint(16.0 * (1.0 + np.log(counts)))
            votes = np.zeros(BITS)
            for at in range(0, len(terms), VOTERS):
                some = terms[at : at + VOTERS]
                bits = np.unpackbits(np.stack([some, mix(some ^ np.uint64(TERM))], axis=1).view(np.uint8), axis=1)
                votes += weights[at : at + VOTERS] @ bits.astype(np.float64)
            out[row] = np.packbits(2.0 * votes > weights.sum())
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal bits, row by row."""
    return 1.0 - np.unpackbits(a ^ b, axis=1).sum(axis=1) / BITS


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _judge(rows: list[tuple[int, str]]) -> pa.RecordBatch:
    """A row for each but the last, of which each is followed by its next document."""
    texts = [t for _, t in rows]
    edited = []
    for text, after in itertools.pairwise(texts):
        half = len(text) // 2
        edited.append(text[: len(text) - half] + after[:half])
    own, new = fingerprints(texts), fingerprints(edited)
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array([i for i, _ in rows[:-1]], pa.int64()),
            "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(to_bytes(t)).hexdigest() for t in edited], pa.string()),
            "fingerprint": pa.array([x.tobytes().hex() for x in own[:-1]], pa.string()),
            "edited_fingerprint": pa.array([x.tobytes().hex() for x in new], pa.string()),
            "near_edited": pa.array(likeness(own[:-1], new)),
            "near_next": pa.array(likeness(own[:-1], own[1:])),
        }
    )


def _in_order(batches):
    """Rows come sorted by shard, with the first document of the next shard last."""
    rows: list[tuple[int, str]] = []
    held = 0
    for batch in batches:
        for doc_id, text, last in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("last").to_pylist(), strict=True):
            rows.append((doc_id, text))
            held += len(text)
            if last or (len(rows) > 1 and held > PART_BYTES) or len(rows) > 512:
                yield _judge(rows)
                rows = [] if last else rows[-1:]
                held = len(text) * (not last)


def fingerprint_documents(docs: DataFrame, n_shards: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half comes from the start of the next document.

    Next: by ascending id, rows of one id by a hash of the text and the text, rows without an id after all others; after the last comes the
    first. A null text is empty. A lone row is its own next. The order is made by ranges, each sorted in one
    partition and read as a stream; each range also gets the first row of the next one. An id with many rows, or many rows
    without one, are cut at hashes into as many ranges as they have shares. Other columns are left out.
    """
    n_shards = min(MOST_SHARDS, n_shards or shard_count(docs))
    docs = with_id(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))).withColumn("turn", F.xxhash64("text"))
    found = docs.approxQuantile("doc_id", [i / n_shards for i in range(1, n_shards)], 0.25 / n_shards) if n_shards > 1 else []
    cuts = np.array([min(int(x), NO_ID) for x in found], np.int64)

    @F.pandas_udf("int")
    def shard(ids: pd.Series, turns: pd.Series) -> pd.Series:
        ids, part = ids.to_numpy(), turns.to_numpy() / 2.0**64 + 0.5
        first, last = (np.searchsorted(cuts, ids, side=side) for side in ("left", "right"))
        own = np.where(last > first, 1 + np.minimum((part * (last - first)).astype(np.int64), last - first - 1), 0)
        return pd.Series((first + own).astype(np.int32))

    own = bounded(docs).withColumn("shard", shard("doc_id", "turn"))
    least = own.select("shard", F.struct("doc_id", "turn").alias("x")).groupBy("shard").agg(F.min("x").alias("x")).select("shard", "x.doc_id", "x.turn")
    order = [row["shard"] for row in least.select("shard").orderBy("shard").collect()]  # MOST_SHARDS at most
    before = dict(zip(order, order[-1:] + order[:-1], strict=True))
    spark = docs.sparkSession
    previous = spark.createDataFrame(list(before.items()), "shard int, before int")
    heads = docs.join(F.broadcast(least), ["doc_id", "turn"]).groupBy("shard", "doc_id", "turn").agg(F.min("text").alias("text"))
    heads = heads.join(F.broadcast(previous), "shard").select("doc_id", "text", "turn", F.col("before").alias("shard"), F.lit(True).alias("last"))
    dealt = own.withColumn("last", F.lit(False)).unionByName(heads)
    dealt = dealt.repartition(n_shards, "shard").sortWithinPartitions("shard", "last", "doc_id", "turn", "text")
    return without_id(dealt.select("doc_id", "text", "last").mapInArrow(_in_order, COLUMNS))


# -- search -----------------------------------------------------------------------------------------------------


def _halves(column: str):
    return [F.conv(F.substring(column, 1 + 16 * i, 16), 16, -10).cast("decimal(20,0)").cast("long") for i in range(2)]


def _tables(frame: DataFrame, column: str, radius: int) -> DataFrame:
    blocks, together = (NARROW + 1, 1) if radius <= NARROW else (BLOCKS, 2)
    size = BITS // 4 // blocks
    keys = [F.xxhash64(*(F.lit(i) for i in chosen), *(F.substring(column, 1 + size * i, size) for i in chosen)) for chosen in itertools.combinations(range(blocks), together)]
    return frame.withColumn("key", F.explode(F.array(*keys)))


def within_radius(queries: DataFrame, fingerprinted: DataFrame, radius: int = BLOCKS - 2) -> DataFrame:
    """(query, fingerprint, distance) for all pairs of distinct hex fingerprints of the two frames within the radius.

    Each frame has a column `fingerprint`; nulls match nothing and repeated ones count once, so that copies, however many, are one
    entry. A radius over BLOCKS - 2 would lose pairs and raises ValueError.
    """
    if not 0 <= radius <= BLOCKS - 2:
        raise ValueError(f"radius must be from 0 to {BLOCKS - 2}")
    one = lambda frame, name: frame.where("fingerprint is not null").select(F.col("fingerprint").alias(name)).distinct()
    left, right = _tables(one(queries, "query"), "query", radius), _tables(one(fingerprinted, "fingerprint"), "fingerprint", radius)
    pairs = left.join(right, "key").drop("key")
    apart = sum(F.bit_count(a.bitwiseXOR(b)) for a, b in zip(_halves("query"), _halves("fingerprint"), strict=True))
    return pairs.withColumn("distance", apart.cast("int")).where(F.col("distance") <= radius).distinct()


def with_neighbours(fingerprinted: DataFrame, asked: Column, radius: int = NARROW) -> DataFrame:
    """fingerprinted with n_within and within: for rows that are asked for, how many other rows lie within the radius, and which; else null.

    within has an entry (doc_id, fingerprint, distance, n) for each distinct fingerprint in the radius, the row's own included: n rows carry it, of which
    doc_id is the least, and all of their ids are those that stand beside this fingerprint. So a group of copies adds one entry to a row.
    """
    rows = staged(fingerprinted)
    wanted = F.coalesce(asked, F.lit(False))
    copies = rows.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    entry = F.struct("distance", "doc_id", "fingerprint", "n")
    near = within_radius(rows.where(wanted), rows, radius).join(copies, "fingerprint").groupBy(F.col("query").alias("fingerprint"))
    near = near.agg((F.sum("n") - 1).alias("n_within"), F.array_sort(F.collect_list(entry)).alias("within"))
    found = rows.where(wanted).join(near, "fingerprint").select(*rows.columns, "n_within", "within")
    return found.unionByName(rows.where(~wanted).select(*rows.columns, F.lit(None).cast("long").alias("n_within"), F.lit(None).cast(near.schema["within"].dataType).alias("within")))
