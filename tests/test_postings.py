"""Block-max postings give the rows of scoring everything, and open fewer postings."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import postings, search


def rows_of(found):
    return sorted((r.qid, str(r.classification), r.chunk_id, round(r.score, 7), r["rank"]) for r in found.collect())


@pytest.fixture(scope="module")
def chunks(spark):
    rnd = random.Random(2)
    topics = [[f"{t}{i}" for i in range(80)] for t in "abcdef"]
    rows = []
    for i in range(900):
        mine = topics[i % 6]
        rows.append((i, "AB"[i % 2] if i % 50 else None, " ".join(rnd.choice(mine if rnd.random() < 0.9 else ["the", "of", "and"]) for _ in range(rnd.randint(0, 60)))))
    rows += [(1000 + i, "A", "a1 a2 a3 the copy") for i in range(150)] + [(2000, "B", None), (2001, "B", "")]
    return spark.createDataFrame(rows, "chunk_id long, classification string, text string")


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "a1 a2 the"), (2, "b1 b2 b3 b4 b5"), (3, "The OF and"), (4, "nothing known"), (5, None), (6, "c7"), (7, "a3 b3 c3 d3 e3 f3 copy")], "qid long, text string")


@pytest.mark.parametrize(("n", "block", "first"), [(3, 8, 1), (20, 64, 4), (500, 16, 2)])
def test_same_rows_as_scoring_everything(chunks, asked, n, block, first):
    index = postings.block_index(chunks, block=block)
    for visible in (None, chunks.where("chunk_id % 3 = 1")):
        want = search.bm25_top(asked, chunks.where("classification is not null"), n, visible)
        got = postings.block_top(asked, index, n, visible, first=first)
        assert rows_of(got.where("classification is not null")) == rows_of(want)
        assert visible is not None or got.where("classification is null").count() > 0  # chunks of no container are one


def test_fewer_postings_are_opened(spark, tmp_path):
    """Ten best of each container for the benchmark's texts, over an index that was written once; the count of postings is of all lists that are opened."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text", F.lit("all").alias("classification"))
    bench = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").where("item_id % 10 = 0").select(F.col("item_id").alias("qid"), "text")
    postings.write_block_index(docs, str(tmp_path / "index"))
    index, read = postings.read_block_index(spark, str(tmp_path / "index")), []
    got = rows_of(postings.block_top(bench, index, 10, read=read))
    assert got == rows_of(search.bm25_top(bench, docs, 10))
    opened = sum(r.agg(F.sum("n")).first()[0] or 0 for r in read)
    words = bench.select("qid", F.explode(F.array_distinct(search.terms(F.col("text")))).alias("term"))
    every = index.postings.join(words, "term").agg(F.sum("n")).first()[0]
    print("postings opened:", opened, "of", every)
    assert opened < every / 2


def test_empty_tables(chunks, asked):
    index = postings.block_index(chunks.limit(0))
    assert postings.block_top(asked, index, 3).count() == 0
    assert postings.block_top(asked.limit(0), postings.block_index(chunks), 3).count() == 0
