"""What several corpus operators share: words, hashes, shards, packed columns and staged tables.

A *shard* is a set of whole documents of a bounded text size, dealt by a hash of the id, so that no
source, key or group of copies decides how much a task gets. Operators that need a fact about a word or a
window from all other shards send a packed column of hashes to *buckets* (dealt by a second hash) and get a
packed column back; the texts themselves travel once.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import inspect
import math
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARD_BYTES = 8 << 20
LEAST_BYTES = 256 << 10
PART_BYTES = 4 << 20
BATCH_ROWS = 2048
SLICE = 1 << 20
SPACE = re.compile(rb"[ \t\n\v\f\r]")
NO_ID = (1 << 63) - 2


class Ids(dict):
    """Numbers new keys in the order of their first use."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


def to_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words_of(data: bytes) -> list[bytes]:
    """Maximal runs of bytes other than space, tab, LF, VT, FF and CR: what bytes.split() parts at."""
    return data.split()


def hash_words(words, seed: int = 0) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, seed) for w in words), np.uint64, len(words))


# -- hashes of a text's words, without an object for each word ----------------------------------------------------

_ODD = 0x9E3779B97F4A7C15
_VALUE = np.random.default_rng(64).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_tables: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """The first n powers of an odd number, modulo 2**64."""
    found = _tables.get(base)
    if found is None or len(found) < n:
        found = _tables[base] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, SLICE), base, np.uint64)], dtype=np.uint64)
    return found[:n]


def _long_word(word: bytes) -> int:
    """A word's hash, some bytes at a time."""
    total = 0
    for at in range(0, len(word), SLICE):
        a = np.frombuffer(word[at : at + SLICE], np.uint8)
        total += int((_VALUE[a] * _powers(len(a), _ODD)).sum(dtype=np.uint64)) * pow(_ODD, at, 1 << 64)
    return total % (1 << 64)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text of any length, in order; a slice of the text at a time.

    A word's hash is a polynomial of random values of its bytes; all words of a slice come from one running sum.
    """
    out, at = [], 0
    while at < len(data):
        end = at + SLICE
        if end < len(data):
            space = SPACE.search(data, end)
            end = space.start() if space else len(data)
        if end - at > 2 * SLICE:  # a huge word
            out.append(np.array([_long_word(w) for w in words_of(data[at:end])], np.uint64))
        else:
            a = np.frombuffer(data, np.uint8, min(end, len(data)) - at, at)
            edge = np.flatnonzero(np.diff(np.r_[True, _IS_SPACE[a], True]))
            first, last = edge[::2], edge[1::2]
            sums = np.r_[np.uint64(0), np.cumsum(_VALUE[a] * _powers(len(a), _ODD), dtype=np.uint64)]
            out.append((sums[last] - sums[first]) * _powers(len(a), pow(_ODD, -1, 1 << 64))[first])
        at = end
    return mix(out[0] if len(out) == 1 else np.concatenate([np.empty(0, np.uint64), *out]))


def word_hashes_of(texts: list[bytes]) -> list[np.ndarray]:
    """word_hashes() of each text, worked out for many short ones at once."""
    out: list[np.ndarray] = []
    for some in slices([len(t) + 1 for t in texts], SLICE):
        group = [texts[i] for i in some]
        h = word_hashes(b" ".join(group))
        if len(group) == 1:
            out.append(h)
            continue
        # a text's words end where its bytes do
        data = np.frombuffer(b" ".join(group), np.uint8)
        starts = np.flatnonzero(np.diff(np.r_[True, _IS_SPACE[data], True]))[::2]
        cuts = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in group])[:-1])
        out += np.split(h, cuts)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection whose output bits each depend on all input bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def windows(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of each n consecutive entries of h."""
    out, factor = np.zeros(max(0, len(h) - n + 1), np.uint64), 1
    for i in range(n):
        factor = factor * (base | 1) % (1 << 64)
        out += h[i : i + len(out)] * np.uint64(factor)
    return mix(out)


def pack(column: np.ndarray, ordered: bool = False) -> bytes:
    """Bytes of an integer column: differences if it is ascending, then the byte planes that are in use, then zstd."""
    a = column.astype(np.uint64)
    if ordered and len(a):
        a = np.concatenate([a[:1], np.diff(a)])
    planes = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
    rows = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T[:planes]) if planes else np.empty(0, np.uint8)
    return bytes([planes]) + len(a).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(rows)


def unpack(data: bytes, ordered: bool = False) -> np.ndarray:
    planes, length = data[0], int.from_bytes(data[1:5], "little")
    a = np.zeros((length, 8), np.uint8)
    if planes and length:
        a[:, :planes] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[5:]), np.uint8).reshape(planes, length).T
    a = a.view(np.uint64).ravel()
    return np.cumsum(a, dtype=np.uint64) if ordered else a


def distinct(column: np.ndarray) -> np.ndarray:
    """The sorted distinct values; by sorting, which takes a fraction of the time of np.unique's table."""
    a = np.sort(column, kind="stable")
    return a[np.flatnonzero(np.r_[True, a[1:] != a[:-1]])] if len(a) else a


def slices(sizes: list[int], most: int) -> Iterator[range]:
    """Ranges of places in turn: as many as have `most` together, one at least."""
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > most:
            yield range(begin, i)
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield range(begin, len(sizes))


def in_parts(batches: Iterable[pa.RecordBatch], *columns: str, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of Arrow batches of at most 512 rows and, unless a row alone has more, `most` bytes in the columns: what a worker holds as objects at once."""
    for batch in batches:
        if not batch.num_rows:
            yield batch
            continue
        width = sum(pc.fill_null(pc.cast(size_of(batch.column(c)), pa.int64()), 0).to_numpy(zero_copy_only=False) for c in columns)
        for some in slices(np.maximum(width, most // 512).tolist(), most):
            yield batch.slice(some.start, len(some))


def bounded(df: DataFrame) -> DataFrame:
    """df; its session now sends Arrow batches of bounded rows and bytes to Python, so that neither side holds thousands of long texts at once."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", PART_BYTES)):
        now = int("".join(filter(str.isdigit, conf.get(key))) or 0)
        if not 0 < now <= most:
            conf.set(key, str(most))
    return df


def release() -> None:
    """Hands memory that is free in this process back to the machine; a worker that is kept for later tasks else holds what its largest one took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def released(function):
    """The function of one group, or of a pair of groups, followed by release()."""

    def run(*tables):
        try:
            return function(*tables)
        finally:
            release()

    # Spark counts the parameters
    return (lambda table: run(table)) if len(inspect.signature(function).parameters) == 1 else (lambda left, right: run(left, right))


def size_of(column: pa.Array) -> pa.Array:
    return pc.list_value_length(column) if pa.types.is_list(column.type) or pa.types.is_large_list(column.type) else pc.binary_length(column)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """The size of all texts, for the number of shards."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def shard_count(docs: DataFrame, column: str = "text", shard_bytes: int = SHARD_BYTES) -> int:
    return shards_for(docs.sparkSession, text_bytes(docs, column), shard_bytes)


def shards_for(spark: SparkSession, n_bytes: int, shard_bytes: int = SHARD_BYTES) -> int:
    """As many shards as shard_bytes asks for, or the session's shuffle partitions if those get LEAST_BYTES each."""
    least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes // LEAST_BYTES)
    return max(1, least, math.ceil(n_bytes / shard_bytes))


def with_id(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The key as a long; NO_ID stands in for null, so that such rows count as one document after all others."""
    return docs.withColumn(key, F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)))


def without_id(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.withColumn(key, F.nullif(F.col(key), F.lit(NO_ID)))


def sharded(docs: DataFrame, n: int, *columns: str, key: str = "doc_id") -> DataFrame:
    """The columns with an int `shard`; each shard is whole in one partition. A null key counts as NO_ID."""
    shard = F.pmod(F.xxhash64(F.lit(7), key), F.lit(n)).cast("int")
    return bounded(with_id(docs.select(key, *(c for c in columns if c != key)), key).withColumn("shard", shard).repartition(n, "shard"))


def packed(docs: DataFrame, *more) -> DataFrame:
    """All columns as one struct `_row`, with further columns, so that no name of a row's own can clash with theirs."""
    return docs.select(F.struct(*(quoted(c) for c in docs.columns)).alias("_row"), *more)


def unpacked(rows: DataFrame, columns: list[str], **instead) -> DataFrame:
    """The columns of `_row` again, with others in place of some of them."""
    return rows.select(*(instead[c].alias(c) if c in instead else F.col(f"_row.{quoted(c)}") for c in columns))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of this machine where that is unset and the session is local, as in tests. A cluster without one is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found or _own_dir()


def _own_dir(made: list[str] = []) -> str:  # noqa: B006
    if not made:
        made.append(tempfile.mkdtemp(prefix="corvane-"))
    return made[0]


def staged(df: DataFrame) -> DataFrame:
    """df, written as a table in the shared folder and read again: cuts the lineage and survives executors.

    The tables are removed when the session's Python ends.
    """
    return df.sparkSession.read.schema(df.schema).parquet(staged_path(df))


def staged_path(df: DataFrame) -> str:
    """The folder of df, written as staged() does."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        pass
