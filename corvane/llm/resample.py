"""Importance resampling to a target distribution, over hashed n-grams of words (buckets of CRC-32).

A word's CRC is worked out once. The CRC of an n-gram follows from those of its words: appending L bytes to a string multiplies its CRC by the L-th power of a
32 x 32 matrix over GF(2), and the CRC of what is appended is added. No n-gram is ever built as a string. Counts by bucket are the same few numbers whatever the corpus.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, in_parts, staged, to_bytes

BUCKETS = 10_000
MOST_BUCKETS = 1 << 20
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
POLYNOMIAL = 0xEDB88320  # fixed value: CRC-32, bits reversed
# a-z and 0-9 and all bytes of other characters make words; A-Z in lower case
_LOWER = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(256))
SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def words(text: str | None) -> list[bytes]:
    return to_bytes(text).translate(_LOWER).split()


# -- algebra of CRCs ----------------------------------------------------------------------------------------------


def _times(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    """matrix (32 columns as integers) times each value: the sum over GF(2) of the columns of its set bits."""
    out = np.zeros(len(values), np.uint32)
    for i in range(32):
        out ^= np.where(values >> np.uint32(i) & np.uint32(1), matrix[i], np.uint32(0))
    return out


@cache
def _append(k: int) -> np.ndarray:
    """For 2**k appended bytes: what each of the four bytes of a CRC becomes, as a table of 4 x 256."""
    m = _matrix(k)
    return np.stack([_times(m, np.arange(256, dtype=np.uint32) << np.uint32(8 * i)) for i in range(4)])


@cache
def _matrix(k: int) -> np.ndarray:
    if k > 0:  # twice as many bytes: the matrix squared
        return _times(_matrix(k - 1), _matrix(k - 1))
    units = np.uint32(1) << np.arange(32, dtype=np.uint32)
    bit = (units >> np.uint32(1)) ^ np.where(units & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    for _ in range(3):  # one bit, then 2, 4 and 8
        bit = _times(bit, bit)
    return bit


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC times the matrix to the power of its length: what it adds to the CRC of its string with so many bytes appended."""
    out, k = crcs.copy(), 0
    while len(lengths) and int(lengths.max()) >> k:
        at = np.flatnonzero(lengths >> k & 1)
        table, v = _append(k), out[at]
        out[at] = table[0][v & 255] ^ table[1][v >> 8 & 255] ^ table[2][v >> 16 & 255] ^ table[3][v >> 24]
        k += 1
    return out


def combined(left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC of each concatenation, from both parts' and the right part's length in bytes."""
    return shifted(left, lengths) ^ right


def feature_crcs(tokens: list[bytes], n: int) -> np.ndarray:
    """CRC-32 of every run of 1 to n words, joined by one space; shorter runs first."""
    one = np.fromiter(map(zlib.crc32, tokens), np.uint32, len(tokens))
    if n == 1:
        return one
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    spaced = combined(np.full(len(one), zlib.crc32(b" "), np.uint32), one, sizes)  # of a space and the word
    out, last = [one], one
    for i in range(1, min(n, len(one))):
        last = combined(last[:-1], spaced[i:], sizes[i:] + 1)
        out.append(last)
    return np.concatenate(out)


# -- counts, gains and weights --------------------------------------------------------------------------------------


def bucket_counts(docs: DataFrame, n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, count) of the features of all texts; each task adds up its own, so it sends a row for each bucket at most."""

    def run(batches: Iterable[pa.RecordBatch]):
        total = np.zeros(buckets, np.int64)
        for part in in_parts(batches, "text"):
            for text in part.column(0).to_pylist():
                total += np.bincount(feature_crcs(words(text), n) % np.uint32(buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "count"])

    made = bounded(docs.selectExpr("cast(text as string) as text")).mapInArrow(run, "bucket long, count long")
    return made.groupBy("bucket").agg(F.sum("count").alias("count"))


def gains(source: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """For each bucket, floor(1000 ln) of its smoothed share among the target's features over that among the source's.

    The driver gets the counts, a row for each bucket: MOST_BUCKETS at most, whatever the tables hold.
    """
    if not 0 < buckets <= MOST_BUCKETS or n < 1:
        raise ValueError(f"buckets must be 1 to {MOST_BUCKETS}, n 1 or more")
    both = bucket_counts(source, n, buckets).withColumn("side", F.lit(0)).union(bucket_counts(target, n, buckets).withColumn("side", F.lit(1)))
    counts = [[0] * buckets, [0] * buckets]
    for bucket, count, side in both.collect():
        counts[side][bucket] = count
    of_source, of_target = map(sum, counts)
    gain = lambda s, t: math.floor(1000 * math.log(float((t + 1) * (of_source + buckets)) / float((s + 1) * (of_target + buckets))))
    return np.array([gain(s, t) for s, t in zip(*counts, strict=True)], np.int64)


def noise(doc_id, seed: str) -> int:
    """A draw from a Gumbel distribution in thousandths, which depends on the seed and the id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, n: int = 1, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight (floored mean gain of the features) and score (weight and noise) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)  # an integer for each bucket

    def run(batches: Iterable[pa.RecordBatch]):
        gain = sent.value
        for part in in_parts(batches, "text"):
            ids, rows = part.column(0).to_pylist(), []
            for doc_id, text in zip(ids, part.column(1).to_pylist(), strict=True):
                tokens = words(text)
                crcs = feature_crcs(tokens, n)
                weight = int(gain[crcs % np.uint32(len(gain))].sum()) // len(crcs) if len(crcs) else 0
                rows.append((doc_id, len(tokens), len(crcs), weight, weight + noise(doc_id, seed)))
            names = ["doc_id", "n_words", "n_features", "weight", "score"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names)

    return bounded(docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text")).mapInArrow(run, SCORED)


# -- drawing --------------------------------------------------------------------------------------------------------


def drawn(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """rows (doc_id, n_words, score and others, read twice: stage them) with `rank` among the drawn.

    Of the N rows with least_words or more, floor(percent * N / 100) of the highest scores are drawn, ties to the smaller id (null before all); rank counts
    them from 1 and is null for others. Rows of one id and score are interchangeable.
    A score's count gives the score at which the draw ends, so only what is at least that high is sorted, by ranges; ranks are places in a range
    after the ranges before it. So neither a score nor an id that has a third of all rows meets in one task. Driver: one row.
    """
    may = F.col("n_words") >= least_words
    # scores are thousandths of a logarithm: their number grows as the logarithm of the corpus
    counts = rows.where(may).groupBy("score").agg(F.count("*").alias("c"))
    running = counts.select("score", F.sum("c").over(Window.orderBy(F.desc("score"))).alias("upto"), F.sum("c").over(Window.partitionBy()).alias("n"))
    asked = running.withColumn("k", F.expr(f"n * {int(percent)} div 100"))
    k, last = asked.agg(F.max("k"), F.max(F.expr("if(upto >= k, score, null)"))).first()
    none = rows.withColumn("rank", F.lit(None).cast("long"))
    if not k:
        return none
    in_reach = may & (F.col("score") >= last)
    ranges = rows.where(in_reach).withColumn("_spread", F.rand(7))  # parts rows that are alike in all else
    ranges = staged(ranges.repartitionByRange(F.desc("score"), F.asc("doc_id"), F.asc("_spread")).withColumn("_part", F.spark_partition_id()))
    sizes = ranges.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc("score"), F.asc("doc_id"), F.asc("_spread")))
    ranked = ranges.withColumn("_place", place).join(F.broadcast(before), "_part").withColumn("rank", (F.col("_before") + F.col("_place")).cast("long"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank"))).drop("_spread", "_part", "_place", "_before")
    return ranked.select(*none.columns).union(none.where(~F.coalesce(in_reach, F.lit(False))))


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs; those with a rank are the sample, without replacement.

    docs: doc_id, text; target: text. Features are the runs of 1 to n words, each repeat counted. A null text has no features and weight 0;
    a null id counts as an empty name. Repeated rows count as often as they stand and score alike. Other columns are left out. An empty table gives an empty one; an empty target is even over all buckets.
    """
    rows = staged(scored(docs, gains(docs, target, n, buckets), n, seed))
    return drawn(rows, percent, least_words).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
with tab as (select list(v order by i) as tab from (select i, list_reduce(list_prepend(cast(i as bigint), list_transform(range(8), lambda x: cast(x as bigint))),
    lambda a, x: case when a % 2 = 1 then xor(a >> 1, cast(3988292384 as bigint)) else a >> 1 end) as v from range(256) r(i))),
texts as (select 0 as side, doc_id as id, text from documents union all select 1, item_id, text from benchmark),
w as (select side, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from texts),
bytes as (select w, list_transform(range(octet_length(encode(w))), lambda i: cast('0x' || hex(encode(w))[2 * i + 1 : 2 * i + 2] as bigint)) as b from (select distinct w from w)),
hashed as (select w, cast(xor(list_reduce(list_prepend(cast(4294967295 as bigint), b), lambda a, x: xor(a >> 8, tab[1 + xor(a, x) % 256])), cast(4294967295 as bigint)) % 10000 as bigint) as k from bytes, tab),
f as (select side, id, k from w join hashed using (w)),
counts as (select k, count(*) filter (where side = 0) as s, count(*) filter (where side = 1) as t from f group by k),
sums as (select coalesce(sum(s), 0) as ss, coalesce(sum(t), 0) as tt from counts),
gains as (select k, floor(1000 * ln(((t + 1) * (ss + 10000))::double / ((s + 1) * (tt + 10000))::double)) as g from counts, sums),
weights as (select id, count(*) as n, sum(g) as g from f join gains using (k) where side = 0 group by id),
scores as (select doc_id, coalesce(n, 0) as n_features, cast(coalesce(floor(g / n), 0) as bigint) as weight,
  cast(floor(-1000 * ln(-ln((cast(('0x' || sha256('2024:' || doc_id)[1:8]) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as noise from documents left join weights on id = doc_id),
ranked as (select doc_id, row_number() over (order by weight + noise desc, doc_id) as r, count(*) over () as c from scores where n_features >= 20)
select s.doc_id, n_features, weight, weight + noise as score, case when r <= 10 * c // 100 then r end as rank from scores s left join ranked using (doc_id)"""
