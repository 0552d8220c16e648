"""The inverted-file index: every row stored, exact scores, bounds that lose nothing, lists that are pruned, recall."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corvane.operators import search, vectors


def clustered(spark, n=600, dims=8, groups=6, seed=1):
    rnd = np.random.default_rng(seed)
    middle = rnd.normal(size=(groups, dims))
    rows = [(i, "ABC"[i % 3], (middle[i % groups] + rnd.normal(size=dims) * 0.3).tolist(), str(i)) for i in range(n)]
    rows += [(n + i, "A", rows[0][2], "0") for i in range(200)] + [(n + 900, "B", [0.0] * dims, "z"), (n + 901, "C", None, "z")]
    return spark.createDataFrame(rows, "chunk_id long, classification string, dense array<double>, own string")


@pytest.fixture(scope="module")
def chunks(spark):
    return clustered(spark)


@pytest.fixture(scope="module")
def index(spark, chunks, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ivf"))
    vectors.write_vector_index(chunks, path, 12)
    return vectors.read_vector_index(spark, path)


@pytest.fixture(scope="module")
def asked(spark, chunks):
    return chunks.where("chunk_id % 37 = 0 or chunk_id >= 1500").select(F.col("chunk_id").cast("string").alias("qid"), "dense")


def rows_of(found):
    return sorted((r.qid, r.classification, r.chunk_id, round(r.score, 9), r["rank"]) for r in found.collect())


def test_every_row_with_a_vector_is_stored_once(chunks, index):
    assert sorted(r.chunk_id for r in index.rows.select("chunk_id").collect()) == sorted(r.chunk_id for r in chunks.where("dense is not null").select("chunk_id").collect())
    assert index.lists.agg(F.sum("n")).first()[0] == index.rows.count()


@pytest.mark.parametrize("n", [1, 7])
def test_exact_answers_equal_a_scan_of_all_vectors(chunks, index, asked, n):
    assert rows_of(vectors.ivf_top(asked, index, n, probes=2, exact=True)) == rows_of(search.dense_top(asked, chunks, n))


def test_own_rows_and_hidden_rows_take_no_place(chunks, index, asked):
    seen = lambda rows: rows.where("chunk_id % 2 = 1")
    want = search.dense_top(asked, seen(chunks), 5, without="own")
    assert rows_of(vectors.ivf_top(asked, index, 5, probes=2, exact=True, without="own", where=seen)) == rows_of(want)


def test_a_probe_reads_its_lists_only(index, asked):
    found = vectors.ivf_top(asked.limit(1), index, 3, probes=1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(list" in plan.replace("PartitionFilters: [list", "PartitionFilters: [isnotnull(list")
    assert found.count() > 0


def test_many_pairs_go_in_slices(chunks, index, asked, monkeypatch):
    want = rows_of(vectors.ivf_top(asked, index, 3, probes=3))
    monkeypatch.setattr(vectors, "MOST_PAIRS", 7)
    assert rows_of(vectors.ivf_top(asked, index, 3, probes=3)) == want


def test_few_or_no_vectors(spark, chunks, asked):
    few = chunks.where("chunk_id < 2")
    made = vectors.vector_index(few, vectors.fit_centroids(few, 5))
    assert rows_of(vectors.ivf_top(asked, made, 3, exact=True)) == rows_of(search.dense_top(asked, few, 3))
    none = chunks.limit(0)
    assert vectors.ivf_top(asked, vectors.vector_index(none, vectors.fit_centroids(none, 5)), 3, exact=True).count() == 0
    assert vectors.ivf_top(asked.limit(0), made, 3, exact=True).count() == 0
    with pytest.raises(ValueError, match="lists"):
        vectors.fit_centroids(few, 0)


@pytest.mark.parametrize("target", [0.5, 0.95])
def test_probes_are_fitted_to_a_recall(spark, target):
    """Recall at 10 over all embeddings of sf0.1, which have no clusters, with as many of 32 lists as other rows needed; without the bounds."""
    chunks = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.lit("all").alias("classification"), F.col("embedding").alias("dense"))
    made = vectors.vector_index(chunks, vectors.fit_centroids(chunks, 32))
    asked = chunks.where("chunk_id % 20 = 7").select(F.col("chunk_id").alias("qid"), "dense")
    probes = vectors.probes_for(made, 10, target)
    got = vectors.recall(vectors.ivf_top(asked, made, 10, probes), search.dense_top(asked, chunks, 10), ["qid"]).first()
    print("probes", probes, "of 32, recall at 10:", got)
    assert got["n"] == 1000 and got["recall"] >= target - 0.02


def test_clusters_need_few_probes(index, chunks, asked):
    probes = vectors.probes_for(index, 10)
    found, want = vectors.ivf_top(asked, index, 10, probes), search.dense_top(asked, chunks, 10)
    got = vectors.recall(found, want, ["qid", "classification"]).first()
    print("probes", probes, "of 12, recall at 10:", got)
    assert probes <= 5 and got["recall"] >= 0.9


def test_what_a_probe_sends_does_not_grow_with_the_lists(spark, monkeypatch):
    """Each vector is sent once, whatever the number of lists that ask for it; rows, ties and hidden rows of whole numbers stay."""
    sent, scored = [], vectors._scored

    def noted(wanted, *more):
        sent.append(len(cloudpickle.dumps(wanted)))
        return scored(wanted, *more)

    monkeypatch.setattr(vectors, "_scored", noted)
    rnd = np.random.default_rng(3)
    rows = [(i, "AB"[i % 2], v.tolist()) for i, v in enumerate(rnd.normal(size=(600, 8)))]
    rows += [(i + 1000, c, v) for i, c, v in rows[:80]]
    chunks = spark.createDataFrame(rows, "chunk_id long, classification string, dense array<double>").withColumn("own", F.col("chunk_id"))
    asked = chunks.where("chunk_id % 10 = 0").select(F.col("chunk_id").alias("qid"), "dense")
    index = vectors.vector_index(chunks, vectors.fit_centroids(chunks, 40))
    got = rows_of(vectors.ivf_top(asked, index, 4, probes=2, exact=True, without="own"))
    assert got == rows_of(search.dense_top(asked, chunks, 4, without="own"))
    assert len(sent) == 2 and max(sent) < 68 * 8 * 8 + 1000


def test_a_task_holds_a_bounded_number_of_scores(monkeypatch):
    """Of many rows, in products of MOST_SCORES at most, the best of each query with equal scores by key."""
    monkeypatch.setattr(search, "MOST_SCORES", 1 << 10)
    rnd = np.random.default_rng(5)
    matrix, rows, sizes = rnd.integers(-2, 3, (64, 4)).astype(float), rnd.integers(-2, 3, (5000, 4)).astype(float), []
    best, keys, none = search.Best(3, 64), rnd.permutation(5000), np.empty(0, int)
    cut = best._cut
    monkeypatch.setattr(best, "_cut", lambda held: (sizes.append(held["n"]), cut(held)))
    for at in np.array_split(np.arange(5000), 10):
        best.add(("A",), matrix, np.arange(64), rows[at], keys[at], (none, none))
    out = pa.schema([("q", pa.int64()), ("c", pa.string()), ("key", pa.int64()), ("score", pa.float64())])
    got = [tuple(r.values()) for batch in best.batches(list(range(64)), out) for r in batch.to_pylist()]
    want = [(q, "A", k, -s) for q in range(64) for s, k in sorted(zip((-matrix[q] @ rows.T).tolist(), keys.tolist(), strict=True))[:3]]
    assert got == want and max(sizes) <= (1 << 16) + (1 << 10)
