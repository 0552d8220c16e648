"""Chunk tables: partitioned by level, written by key, moved and purged as copy-on-write snapshots.

A container is a partition directory classification=...; filters on the level prune it. Every function returns the
new snapshot; write_snapshot() puts one in place of another. Each is a folder of its own; numbered files beside it say which tables stand in
which folders, the highest number holds. A number is taken by a rename that fails where the name exists, so of two writers who read the same
state one is told; a reader keeps its files until they are swept by age. The file system must rename atomically.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COMMIT = "_commit-"
KEEP_SECONDS = 24 * 3600
TRIES = 5


class Conflict(RuntimeError):
    """Another writer replaced a table that this one had read."""


def _levelled(chunks: DataFrame) -> DataFrame:
    """Fails the job on a chunk without a level, rather than store it where no filter finds it."""
    missing = F.coalesce(F.col("classification"), F.lit("")) == ""
    return chunks.withColumn("classification", F.when(missing, F.raise_error(F.lit("chunk without classification")).cast("string")).otherwise(F.col("classification")))


def upsert(chunks: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The new rows, and the old ones whose key is not among them; the last row in order of all columns wins among equal new keys."""
    new = _levelled(new)
    once = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in new.columns if c != key and not new.schema[c].dataType.typeName() == "map")))
    new = new.withColumn("_n", once).where("_n = 1").drop("_n")
    return chunks.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def update_payload(chunks: DataFrame, document_id: str, fields: dict[str, Column]) -> DataFrame:
    """The fields of one document's chunks set; a change of level moves them to another partition when written."""
    mine = F.col("document_id") == document_id
    return chunks.withColumns({c: F.when(mine, value).otherwise(F.col(c)) for c, value in fields.items()})


def delete_document(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Without the chunks of the documents (document_id), in whatever partition."""
    return chunks.join(documents.select("document_id").distinct(), "document_id", "left_anti").select(*chunks.columns)


def replace_document(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """Upserts all chunks of the new rows' documents, and sweeps old ones with an index past the new end."""
    counts = new.groupBy("document_id").agg((F.max("chunk_index") + 1).alias("_n"))
    kept = chunks.join(counts, "document_id", "left").where(F.col("_n").isNull() | (F.col("chunk_index") < F.col("_n"))).drop("_n")
    return upsert(kept, new)


def document_chunks(chunks: DataFrame, document_id: str) -> DataFrame:
    return chunks.where(F.col("document_id") == document_id).orderBy("chunk_index")


def model_provenance(chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, embedding_model): the one model of a container, null for none, or mixed:a,b."""
    models = F.array_sort(F.collect_set("embedding_model"))  # models, not chunks
    found = chunks.groupBy(*(by or [])).agg(models.alias("_m"))
    name = F.when(F.size("_m") == 0, F.lit(None).cast("string")).when(F.size("_m") == 1, F.get("_m", F.lit(0))).otherwise(F.concat(F.lit("mixed:"), F.array_join("_m", ",")))
    return found.select(*(by or []), name.alias("embedding_model"))


def model_mismatch(chunks: DataFrame, identity: str) -> str | None:
    """Why a query embedded as `identity` must be refused, else None."""
    found = model_provenance(chunks).first()["embedding_model"]
    return None if found in (None, identity) else f"chunks were embedded with {found}, the query with {identity}"


def needs_reembedding(documents: DataFrame, chunks: DataFrame, identity: str, force: bool = False, levels: list[str] | None = None) -> DataFrame:
    """Approved or pending documents whose first chunk bears another model than `identity`, or none."""
    first = chunks.where("chunk_index = 0").select("document_id", "embedding_model")
    rows = documents.where(F.col("classification").isin(levels)) if levels else documents
    rows = rows.join(first, "document_id", "left")
    return rows if force else rows.where(F.coalesce(F.col("embedding_model") != identity, F.lit(True)))


def migrate_default(chunks: DataFrame, legacy: DataFrame) -> DataFrame:
    """Chunks of a container without levels, merged into theirs; newer rows of the same key win."""
    return upsert(legacy, chunks)


# -- snapshots on disk ------------------------------------------------------------------------------------------


def _files(spark: SparkSession, path: str):
    """(file system, a maker of paths) of a store."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _commits(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, path) of the store's commits in order."""
    system, make = _files(spark, root)
    if not system.exists(make(root)):
        return []
    names = [f.getPath().getName() for f in system.listStatus(make(root)) if f.isFile()]
    return sorted((int(n[len(COMMIT) :]), f"{root}/{n}") for n in names if n.startswith(COMMIT))


def _said(spark: SparkSession, path: str) -> dict[str, dict]:
    """The tables (name: folder, schema) that a commit holds."""
    system, make = _files(spark, path)
    source = system.open(make(path))
    try:
        return json.loads(bytes(source.readAllBytes()))
    finally:
        source.close()


def _state(spark: SparkSession, root: str) -> tuple[int, dict[str, dict]]:
    """The number of the last commit, and its tables; 0 and none before the first."""
    found = _commits(spark, root)
    return (found[-1][0], _said(spark, found[-1][1])) if found else (0, {})


def _commit(spark: SparkSession, root: str, number: int, tables: dict[str, dict]) -> bool:
    """Whether the number was free, and is this state's now."""
    system, make = _files(spark, root)
    whole = lambda p: make(p).makeQualified(system.getUri(), system.getWorkingDirectory())
    new, where = whole(f"{root}/.{COMMIT}{uuid.uuid4().hex}"), whole(f"{root}/{COMMIT}{number:012d}")
    out = system.create(new, True)
    try:
        out.write(bytearray(json.dumps(tables).encode()))
    finally:
        out.close()
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(new, where, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        system.delete(new, False)
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        return False
    return True


def sweep(spark: SparkSession, path: str, seconds: float = KEEP_SECONDS) -> None:
    """Removes folders that no current table stands in and commits before the last, once they are older than `seconds`.

    An age under that of running readers and writers takes their files away; after a purge, when none runs, it may be 0.
    """
    system, make = _files(spark, path)
    commits = _commits(spark, path)
    kept = {t["folder"] for t in _said(spark, commits[-1][1]).values()} if commits else set()
    last = commits[-1][1].rsplit("/", 1)[1] if commits else None
    for found in system.listStatus(make(path)):
        name = found.getPath().getName()
        ours = name.startswith("snapshot-") if found.isDirectory() else name.startswith((COMMIT, f".{COMMIT}"))
        if ours and name not in kept and name != last and time.time() - found.getModificationTime() / 1000 >= seconds:
            system.delete(found.getPath(), True)


def _place(path: str) -> tuple[str, str]:
    root, _, name = path.rstrip("/").rpartition("/")
    return root, name


def write_together(tables: dict[str, DataFrame], partitions: dict[str, list[str]] | None = None, seen: int | None = None, keep_seconds: float = KEEP_SECONDS) -> None:
    """Puts several tables (path: snapshot) of one folder, their store, in place, all or none; other tables of the store stay.

    All are written first; one new file then names all of them. If another writer has replaced one of the tables since commit `seen` (read_version();
    the state as this call begins, if None), nothing changes and Conflict is raised; a change of other tables is taken in. A writer that dies leaves folders that nobody
    reads, which later writes sweep once they are older than keep_seconds. Frames read before stay readable as long.
    """
    if not tables:
        return
    spark = next(iter(tables.values())).sparkSession
    roots = {_place(p)[0] for p in tables}
    if len(roots) > 1:
        raise ValueError("tables that are written together stand in one folder")
    root = roots.pop()
    number, state = _state(spark, root)
    if seen is not None and seen != number:
        before = dict(_commits(spark, root)).get(seen)
        state = _said(spark, before) if before else {}
    mine, system, make = {}, *_files(spark, root)
    try:
        for path, frame in tables.items():
            folder = f"snapshot-{uuid.uuid4().hex}"
            mine[_place(path)[1]] = {"folder": folder, "schema": frame.schema.jsonValue()}
            by = (partitions or {}).get(path, ["classification"] if "classification" in frame.columns else [])
            frame.write.partitionBy(*by).parquet(f"{root}/{folder}")
        while True:
            number, now = _state(spark, root)
            for name in mine:
                if (now.get(name) or {}).get("folder") != (state.get(name) or {}).get("folder"):
                    raise Conflict(f"{root}/{name} was replaced by another writer")
            if _commit(spark, root, number + 1, now | mine):
                break
    except BaseException:
        for table in mine.values():
            system.delete(make(f"{root}/{table['folder']}"), True)
        raise
    sweep(spark, root, keep_seconds)


def write_snapshot(chunks: DataFrame, path: str, seen: int | None = None, keep_seconds: float = KEEP_SECONDS) -> None:
    """Makes the chunks, partitioned by level, the whole content of the table; they may stem from the snapshot before."""
    write_together({path: _levelled(chunks)}, {path: ["classification"]}, seen, keep_seconds)


def read_version(spark: SparkSession, path: str) -> int:
    """The number of the state that a table's store is in."""
    return _state(spark, _place(path)[0])[0]


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The current snapshot, with its columns as they were written; FileNotFoundError without one."""
    root, name = _place(path)
    current = _state(spark, root)[1].get(name)
    if current is None:
        raise FileNotFoundError(path)
    schema = StructType.fromJson(current["schema"])
    return spark.read.schema(schema).parquet(f"{root}/{current['folder']}").select(*schema.fieldNames())


def replace_snapshot(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], keep_seconds: float = KEEP_SECONDS) -> None:
    """Makes change(the current snapshot) the current one; where another writer comes between, on that writer's state, TRIES times at most."""
    for left in reversed(range(TRIES)):
        seen = read_version(spark, path)
        try:
            return write_snapshot(change(read_snapshot(spark, path)), path, seen, keep_seconds)
        except Conflict:
            if not left:
                raise


def ensure_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The current snapshot, or an empty one of the schema, which is made where there is none."""
    try:
        return read_snapshot(spark, path)
    except FileNotFoundError:
        write_snapshot(spark.createDataFrame([], schema), path)
        return read_snapshot(spark, path)
