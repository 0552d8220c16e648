"""An inverted-file index of vectors: lists around centroids, a probe that reads only the lists asked for, exact scores, and exact answers by bounds.

Centroids come from a bounded sample, drawn by a hash of the key; every row is stored in the list of its nearest centroid, a partition directory each, so a probe
prunes files. Each list keeps, for each container, its size and its widest angle from the centroid. As angles obey the triangle inequality, no row of a
list can be nearer to a query than the centroid's angle less that width; with exact=True a second probe reads the lists that this bound cannot rule out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..plans.session import staged
from .search import MOST_QUERY_ROWS, Best, containers_of, top, unit

SAMPLE_ROWS = 1 << 14
MOST_LISTS = 4096
ROUNDS = 12
PROBES = 8
CALIBRATION = 64
MOST_PAIRS = 1 << 24  # of a query and a list, a bit each, that are sent together
SLACK = 1e-9  # of rounding, when bounds are compared


@dataclass(frozen=True)
class VectorIndex:
    """rows: the indexed columns with `dense` (unit length, doubles) and `list`; lists: (list, centroid, containers..., n, width), a row for each list and container."""

    rows: DataFrame
    lists: DataFrame
    containers: tuple[str, ...]


def unit_rows(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors as a matrix of unit rows; a zero vector stays."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    grid = flat.reshape(len(vectors), -1) if len(vectors) else np.empty((0, 0))
    length = np.sqrt((grid * grid).sum(axis=1, keepdims=True))
    return np.divide(grid, length, out=np.zeros_like(grid), where=length > 0)


def fit_centroids(chunks: DataFrame, lists: int, key: str = "chunk_id", sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Centroids (unit rows) of at most `lists` groups, by spherical k-means over a sample of at most sample_rows vectors.

    The sample is the rows whose keys have the least hashes, so it depends on the rows alone; it and the centroids are all that the driver gets. Starting points are spread: each is
    the sampled vector farthest from those before it. A group that loses all its vectors keeps its centroid. Without vectors there are no centroids.
    """
    if not 0 < lists <= MOST_LISTS:
        raise ValueError(f"lists must be 1 to {MOST_LISTS}")
    asked = chunks.where("dense is not null").select(unit("dense").alias("_v"), F.xxhash64(F.lit(3), key).alias("_h"), F.xxhash64("dense").alias("_t"))
    sample = np.array([r[0] for r in asked.orderBy("_h", "_t").limit(sample_rows).collect()])
    if not len(sample):
        return np.empty((0, 0))
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < lists and nearest.min() < 1 - 1e-6:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    centroids = sample[chosen]
    for _ in range(ROUNDS):
        group = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, group, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 0, np.divide(sums, length, out=np.zeros_like(sums), where=length > 0), centroids)
    return centroids


def vector_index(chunks: DataFrame, centroids: np.ndarray, containers: list[str] = ["classification"]) -> VectorIndex:  # noqa: B006
    """Every row that has a vector, in the list of its nearest centroid (the first of equals), with each list's figures. One pass of matrix products; only figures are shuffled."""
    kept = [c for c in chunks.columns if c not in ("dense", "list", "_angle")]
    rows = chunks.where("dense is not null").select(*kept, F.col("dense").cast("array<double>").alias("dense"))
    schema = StructType([*rows.schema.fields, *chunks.sparkSession.createDataFrame([], "list int, _angle double").schema.fields])
    sent = chunks.sparkSession.sparkContext.broadcast(centroids)  # MOST_LISTS rows at most

    def run(batches):
        for batch in batches:
            vectors = unit_rows(batch.column("dense"))
            cosines = vectors @ sent.value.T if len(vectors) else np.empty((0, 1))
            at = cosines.argmax(axis=1) if len(vectors) else np.empty(0, int)
            angle = np.arccos(np.clip(cosines[np.arange(len(at)), at], -1, 1)) if len(at) else np.empty(0)
            edges = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * (vectors.shape[1] if len(vectors) else 0))
            dense = pa.ListArray.from_arrays(edges, pa.array(vectors.ravel()))
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, dense, pa.array(at, pa.int32()), pa.array(angle)], [*kept, "dense", "list", "_angle"])

    placed = rows.mapInArrow(run, schema)
    figures = placed.groupBy("list", *containers).agg(F.count("*").alias("n"), F.max("_angle").alias("width"))
    named = chunks.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "list int, centroid array<double>")
    return VectorIndex(placed.drop("_angle"), figures.join(F.broadcast(named), "list"), tuple(containers))


def write_vector_index(chunks: DataFrame, path: str, lists: int, containers: list[str] = ["classification"], key: str = "chunk_id", sample_rows: int = SAMPLE_ROWS) -> None:  # noqa: B006
    """Fits the centroids and puts the index of the chunks in place of the one at path: vectors partitioned by list, and the lists.

    A list with very many rows (one common vector) is written by several tasks: Spark rebalances by list, and splits what is too large.
    """
    from .store import write_together

    made = vector_index(chunks, fit_centroids(chunks, lists, key, sample_rows), containers)
    write_together({f"{path}/vectors": made.rows.hint("rebalance", "list"), f"{path}/lists": made.lists}, {f"{path}/vectors": ["list"], f"{path}/lists": []})


def read_vector_index(spark: SparkSession, path: str, containers: list[str] = ["classification"]) -> VectorIndex:  # noqa: B006
    from .store import read_snapshot

    return VectorIndex(read_snapshot(spark, f"{path}/vectors"), read_snapshot(spark, f"{path}/lists"), tuple(containers))


# -- search ---------------------------------------------------------------------------------------------------------


def _scored(wanted: np.ndarray, ids: list, asking: dict[int, bytes], keys: list[str], n: int, out: pa.Schema):
    """For mapInArrow over (list, keys..., _key, _not, dense): the n best rows of a partition for each query that asks for the row's list, in each container.

    asking: for each list a bit for each query.
    """
    places: dict[str, list[int]] = {}
    for i, q in enumerate(ids):
        places.setdefault(str(q), []).append(i)

    def run(batches):
        best = Best(n, len(ids))
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, found = unit_rows(batch.column("dense")), batch.column("_key").to_pandas().to_numpy()
            hidden = [places.get(x, []) for x in batch.column("_not").to_pylist()]
            for (number, *kind), at in containers_of(batch, ["list", *keys]).items():
                if number not in asking:
                    continue
                numbers = np.flatnonzero(np.unpackbits(np.frombuffer(asking[number], np.uint8), count=len(ids)))
                own = {int(q): i for i, q in enumerate(numbers)} if any(hidden[i] for i in at) else {}
                pairs = np.array([(own[q], i) for i, row in enumerate(at) for q in hidden[row] if q in own], int).reshape(-1, 2)
                best.add(tuple(kind), wanted[numbers], numbers, vectors[at], found[at], (pairs[:, 0], pairs[:, 1]))
        yield from best.batches(ids, out)

    return run


def _probe(index: VectorIndex, masked: DataFrame, numbers: list[int], n: int, query: str, key: str, without: str | None, where) -> DataFrame:
    """(query, containers, key, score) of the best rows among the lists that masked (query, _v, _mask) names by a bit for each of `numbers`.

    Queries go in slices of MOST_QUERY_ROWS (fewer if there are over MOST_PAIRS / MOST_QUERY_ROWS lists), each vector once, with a bit for each list: what a slice sends is bounded, whatever the number of lists. No list that nobody in a slice asks for is read.
    """
    spark, keys = index.rows.sparkSession, list(index.containers)
    kinds = index.rows.schema
    schema = StructType([StructField(query, masked.schema[query].dataType), *(StructField(c, kinds[c].dataType) for c in [*keys, key]), StructField("score", DoubleType())])
    rows = where(index.rows).select("list", *keys, F.col(key).alias("_key"), (F.col(without).cast("string") if without else F.lit(None).cast("string")).alias("_not"), "dense")

    def against(part: DataFrame, rows: DataFrame) -> DataFrame:
        asked = part.collect()  # a slice
        bits = np.array([np.unpackbits(np.frombuffer(r["_mask"], np.uint8), count=len(numbers)) for r in asked], np.uint8).reshape(len(asked), len(numbers))
        asking = {number: np.packbits(bits[:, i]).tobytes() for i, number in enumerate(numbers) if bits[:, i].any()}
        if not asking:
            return spark.createDataFrame([], schema)
        wanted, ids = np.array([r["_v"] for r in asked]), [r[query] for r in asked]
        read = rows if len(asking) == len(numbers) else rows.where(F.col("list").isin(sorted(asking)))
        return read.mapInArrow(_scored(wanted, ids, asking, keys, n, to_arrow_schema(schema)), schema)

    most = max(1, min(MOST_QUERY_ROWS, MOST_PAIRS // max(1, len(numbers))))
    slices, out = max(1, -(-masked.count() // most)), None
    for i in range(slices):
        part = against(masked if slices == 1 else masked.where(F.pmod(F.xxhash64(query), F.lit(slices)) == i), rows)
        out = part if out is None else out.union(part)
    return out


def ivf_top(queries: DataFrame, index: VectorIndex, n: int, probes: int = PROBES, exact: bool = False, query: str = "qid", key: str = "chunk_id", without: str | None = None, where=lambda rows: rows) -> DataFrame:
    """(query, containers, key, score, rank): the n nearest rows of each query in each container among its `probes` nearest lists; of all lists if exact.

    queries: (query, dense); those without a vector are left out. where: rows -> rows, the caller's filter, e.g. access.secured(); it is applied as lists are read, so hidden rows take no place.
    without: a column that bears the ids of queries that must not find the row. Equal scores go by key. exact: lists that may hold a row as
    near as a query's n-th (of the container where it is farthest; any list, while a container has fewer) are read in a second probe.
    """
    spark = index.rows.sparkSession
    spread = index.lists.groupBy("list").agg(F.first("centroid").alias("centroid"), F.max("width").alias("width")).orderBy("list").collect()  # MOST_LISTS at most
    asked = queries.where("dense is not null").select(query, unit("dense").alias("_v"))
    numbers, centroids, widths = [r[0] for r in spread], np.array([r[1] for r in spread]), np.array([r[2] for r in spread])
    schema = StructType([*asked.schema.fields, *spark.createDataFrame([], "_mask binary").schema.fields])

    def lists_of(second: bool):
        """Each query with a bit for each list that it reads: the `probes` nearest, or the others by their bounds, where _least (if any) can be reached."""

        def run(batches):
            for batch in batches:
                if not batch.num_rows or not numbers:
                    continue
                vectors = unit_rows(batch.column("_v"))
                cosines = vectors @ centroids.T
                chosen = np.zeros(cosines.shape, bool)
                np.put_along_axis(chosen, np.argsort(-cosines, axis=1, kind="stable")[:, :probes], True, axis=1)
                if second:
                    most = np.cos(np.maximum(0, np.arccos(np.clip(cosines, -1, 1)) - widths))
                    most[np.abs(vectors).sum(axis=1) == 0] = 1
                    least = batch.column("_least").to_numpy(zero_copy_only=False).astype(float)[:, None]
                    chosen = ~chosen & (np.isnan(least) | (most >= least - SLACK))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m.tobytes() for m in np.packbits(chosen, axis=1)], pa.binary())], [f.name for f in schema])

        return run

    order, by = (F.desc("score"), F.asc(key)), [query, *index.containers]
    found = top(_probe(index, staged(asked.mapInArrow(lists_of(False), schema)), numbers, n, query, key, without, where), by, n, *order)
    if not exact:
        return found
    found = staged(found)
    kinds = where(index.rows).select(*index.containers).distinct().count() if index.containers else 1
    reached = found.where(F.col("rank") == n).groupBy(query).agg(F.min("score").alias("_least"), F.count("*").alias("_kinds")).where(F.col("_kinds") >= kinds)
    rest = asked.join(reached.select(query, "_least"), query, "left").select(query, "_v", "_least")
    more = _probe(index, staged(rest.mapInArrow(lists_of(True), schema)), numbers, n, query, key, without, where)
    return top(found.drop("rank").union(more), by, n, *order)


def probes_for(index: VectorIndex, n: int, target: float = 0.95, key: str = "chunk_id", asked: int = CALIBRATION) -> int:
    """The fewest probes by which `asked` rows of the index (those whose keys have the least hashes), as queries, find at least `target` of their n nearest other rows in each container.

    Vectors in clusters need few; vectors without any order need most lists, as no index can help there. The driver gets the places of these rows.
    """
    sample = index.rows.orderBy(F.xxhash64(F.lit(5), key), key).limit(asked).select(F.col(key).cast("string").alias("qid"), "dense")
    rows = index.rows.withColumn("_own", F.col(key).cast("string"))
    every = VectorIndex(rows, index.lists, index.containers)
    hits = ivf_top(sample, every, n, probes=MOST_LISTS, key=key, without="_own")
    spread = index.lists.groupBy("list").agg(F.first("centroid").alias("centroid")).orderBy("list").collect()
    vectors = {r["qid"]: r["dense"] for r in sample.collect()}
    found = hits.join(rows.select(key, "list"), key).select("qid", "list").collect()
    if not found:
        return 1
    order = {q: np.argsort(-(np.array([r[1] for r in spread]) @ np.array(v)), kind="stable") for q, v in vectors.items()}
    place = {q: {spread[j][0]: i + 1 for i, j in enumerate(o)} for q, o in order.items()}
    needed = np.sort([place[q][number] for q, number in found])
    return int(needed[max(0, int(np.ceil(target * len(needed))) - 1)])


def recall(found: DataFrame, exact: DataFrame, by: list[str], key: str = "chunk_id") -> DataFrame:
    """(n, hit, recall) of the exact neighbours that were found."""
    both = exact.select(*by, key).join(found.select(*by, key, F.lit(1).alias("_hit")), [*by, key], "left")
    return both.agg(F.count("*").alias("n"), F.count("_hit").alias("hit")).withColumn("recall", F.col("hit") / F.nullif(F.col("n"), F.lit(0)))
