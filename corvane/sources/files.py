"""Objects by key: distributed reads, upload checks as columns, bounded sizes, batch submission."""

from __future__ import annotations

import hashlib
import re
from pathlib import PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES, MOST_FILES, SNIFF = 50 << 20, 25, 8
TASKS_A_CORE = 4
BACKENDS = {"filesystem": "file://", "s3": "s3a://"}
# fixed values: accepted extensions and what their contents begin with (none for text)
_ZIP = [b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08"]
_TIFF = [b"II*\x00", b"MM\x00*"]
ACCEPTED: dict[str, list[bytes]] = {
    ".txt": [],
    ".md": [],
    ".markdown": [],
    ".html": [],
    ".htm": [],
    ".pdf": [b"%PDF-"],
    ".docx": _ZIP,
    ".pptx": _ZIP,
    ".xlsx": _ZIP,
    ".png": [b"\x89PNG"],
    ".jpg": [b"\xff\xd8\xff"],
    ".jpeg": [b"\xff\xd8\xff"],
    ".tif": _TIFF,
    ".tiff": _TIFF,
}
# fixed values: signatures of formats that are not accepted
FOREIGN = [b"\xd0\xcf\x11\xe0", b"\x7fELF", b"MZ", b"\x1f\x8b", b"Rar!", b"7z\xbc\xaf"]


def object_path(root: str, key: str) -> str:
    """root/key; a key that would leave the root raises ValueError."""
    parts = PurePosixPath(key).parts
    if not parts or key.startswith("/") or ".." in parts or "\x00" in key:
        raise ValueError(f"bad object key: {key!r}")
    return f"{root.rstrip('/')}/{PurePosixPath(*parts)}"


def object_root(backend: str, place: str) -> str:
    """The URI of a store's root; an unknown backend raises ValueError."""
    if backend not in BACKENDS:
        raise ValueError(f"unknown object store: {backend!r}; known: {', '.join(sorted(BACKENDS))}")
    return place if "://" in place else BACKENDS[backend] + place


def read_objects(spark: SparkSession, root: str, pattern: str = "*", most_bytes: int = MOST_BYTES) -> DataFrame:
    """(original_object_key, content, length, modified): every object below the root that is not empty; a larger one has null content.

    Length is tested on file metadata, so that oversized contents are not read. Spark's listing passes over empty files: look those up by key, with object_digests().
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    whole = files.where(F.col("length") <= most_bytes).select("path", "content", "length", F.col("modificationTime").alias("modified"))
    large = files.where(F.col("length") > most_bytes).select("path", F.lit(None).cast("binary").alias("content"), "length", F.col("modificationTime").alias("modified"))
    key = object_key(F.col("path"), spark, root)
    return whole.unionByName(large).select(key.alias("original_object_key"), "content", "length", "modified")


def object_keys(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(original_object_key): the keys of all objects below the root that are not empty, by one scan of paths that opens none. Small files share tasks, whose number does not grow with theirs.

    Spark's listing passes over empty files: look those up by key, with object_digests().
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")
    return found.coalesce(TASKS_A_CORE * spark.sparkContext.defaultParallelism).select(object_key(F.col("path"), spark, root).alias("original_object_key"))


def object_key(path: Column, spark: SparkSession, root: str) -> Column:
    """What follows the root in a path; both may name the scheme and authority, or leave them to the default file system."""
    where, system = _hadoop(spark, root)
    full = where.makeQualified(system.getUri(), system.getWorkingDirectory()).toUri()
    plain = lambda p: F.regexp_replace(F.regexp_replace(p, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "^/+", "")
    start = full.getPath().strip("/")
    return F.substring(plain(path), len(start) + 2 if start else 1, 1 << 30)


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_object(spark: SparkSession, root: str, key: str, content: bytes) -> None:
    where, system = _hadoop(spark, object_path(root, key))
    out = system.create(where, True)
    try:
        out.write(content)
    finally:
        out.close()


def delete_object(spark: SparkSession, root: str, key: str) -> bool:
    where, system = _hadoop(spark, object_path(root, key))
    return system.delete(where, False)


PIECE = 1 << 20


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    """A store as a worker reaches it, and its path there: folders of the machine or mounted, s3, gs and hdfs."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", root)) if re.match(r"[A-Za-z][\w+.-]*:", root) else (fs.LocalFileSystem(), root)


def _dealt(keys: DataFrame, n: int | None = None) -> DataFrame:
    """The distinct keys (original_object_key), some to each of n tasks (TASKS_A_CORE a core if None): keys are short, so Spark by itself would give all to very few."""
    n = n or TASKS_A_CORE * keys.sparkSession.sparkContext.defaultParallelism
    return keys.select(F.col("original_object_key").cast("string").alias("original_object_key")).repartition(n, "original_object_key").distinct()


def put_objects(contents: DataFrame, root: str) -> int:
    """Writes each row of contents (original_object_key, content) as an object, by the tasks that hold them; how many. A task that is tried again writes its objects again.

    A key that leaves the root raises ValueError; null content makes an empty object.
    """

    def run(batches):
        system, base = _opened(root)
        made = set()
        for batch in batches:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                where = object_path(base, key or "")
                if (folder := where.rpartition("/")[0]) not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(where) as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return contents.select(F.col("original_object_key").cast("string"), F.col("content").cast("binary")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _found(system: fs.FileSystem, base: str, key: str | None) -> str | None:
    """The path of a key's object, if there is one."""
    try:
        where = object_path(base, key or "")
    except ValueError:
        return None
    return where if system.get_file_info(where).type == fs.FileType.File else None


def object_digests(keys: DataFrame, root: str, tasks: int | None = None) -> DataFrame:
    """(original_object_key, length, sha256) of the objects that keys name; both null for one that is not there. Other objects are neither listed nor read.

    Each is read as a stream, PIECE bytes at a time, so its size is bounded by nothing. A null key, and one that leaves the root, names nothing.
    """

    def run(batches):
        system, base = _opened(root)
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                if not (where := _found(system, base, key)):
                    rows.append((key, None, None))
                    continue
                digest, length = hashlib.sha256(), 0
                with system.open_input_stream(where) as source:
                    while piece := source.read(PIECE):
                        digest.update(piece)
                        length += len(piece)
                rows.append((key, length, digest.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate([pa.string(), pa.int64(), pa.string()])], ["original_object_key", "length", "sha256"])

    return _dealt(keys, tasks).mapInArrow(run, "original_object_key string, length long, sha256 string")


def delete_objects(spark: SparkSession, root: str, keys: DataFrame) -> int:
    """Deletes the originals of purged documents, each task those of its keys; how many there were. A missing one counts as gone; a task that is tried again finds its first try's gone."""

    def run(batches):
        system, base = _opened(root)
        for batch in batches:
            gone = 0
            for key in batch.column(0).to_pylist():
                if where := _found(system, base, key):
                    system.delete_file(where)
                    gone += 1
            yield pa.RecordBatch.from_arrays([pa.array([gone], pa.int64())], ["n"])

    return _dealt(keys).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def suffix(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"[^/](\.[^./]+)$", 1))


def _begins(head: Column, signatures: list[bytes]) -> Column:
    out = F.lit(False)
    for s in signatures:
        out = out | (F.substring(head, 1, len(s)) == F.lit(bytearray(s)))
    return out


def upload_error(filename: Column, content: Column) -> Column:
    """Why an upload is refused, else null: an extension without a parser, or first bytes that disagree with it."""
    ext, head = suffix(filename), F.substring(content, 1, SNIFF)
    foreign = FOREIGN + [s for signatures in ACCEPTED.values() for s in signatures]
    out = F.when(~ext.isin(*ACCEPTED), "unsupported_type")
    for e, signatures in ACCEPTED.items():
        if signatures:
            out = out.when((ext == e) & ~_begins(head, signatures), "contents_differ")
    text = ext.isin(*(e for e, s in ACCEPTED.items() if not s))
    return out.when(text & _begins(head, foreign), "contents_differ").when(text & F.contains(head, F.lit(bytearray(b"\x00"))), "binary_contents")


def submit_batch(files: DataFrame, most: int = MOST_FILES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """files (position, filename, content) with `detail`, null where accepted: too many files, empty, too large, or upload_error()."""
    size = F.length("content")
    detail = F.when(F.col("position") >= most, "too_many_files").when(F.coalesce(size, F.lit(0)) == 0, "empty").when(size > most_bytes, "too_large").otherwise(upload_error(F.col("filename"), F.col("content")))
    return files.withColumn("detail", detail).withColumn("content_sha256", F.when(F.col("detail").isNull(), F.sha2("content", 256)))
