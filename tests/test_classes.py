"""Visibility by classes of callers and documents; sums of whole vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import access, search
from corvane.plans import overlay

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return overlay.governed(spark.read.parquet(f"{SF}/documents.parquet")).drop("text")


def test_classes_give_the_pairs_of_the_filter(spark, docs):
    callers, levels = access.resolve(overlay.personas(spark)), overlay.levels(spark)
    own = docs.limit(1).withColumn("doc_id", F.lit(-1).cast("long")).withColumn("access_scope", F.array(F.lit("sub-bob"))).withColumn("releasability", F.array(F.lit("NONE"))).withColumn("classification", F.lit("CUI")).withColumn("status", F.lit("approved"))
    odd = own.withColumn("doc_id", F.lit(-2).cast("long")).withColumn("access_scope", F.lit(None).cast("array<string>"))
    every = docs.unionByName(own).unionByName(odd)
    seen = access.visibility(callers, every, levels)
    want = {(r.persona, r.doc_id) for r in access.visible_pairs(callers, every, levels).collect()}
    got = [(r.persona, r.doc_id) for r in access.pairs_of(seen).collect()]
    assert len(got) == len(set(got)) and set(got) == want and ("bob", -1) in want
    counts = {p: sum(x == p for x, _ in want) for p, _ in want}
    assert {r.persona: r.n for r in access.visible_counts(seen).collect()} == counts
    asked = spark.createDataFrame([(p, d) for p in ["alice", "bob", "nobody"] for d in [*range(0, 1000, 7), -1, -2, 10**9]], "persona string, doc_id long")
    assert {(r.persona, r.doc_id) for r in access.may_read(seen, asked).where("visible").collect()} == {(r.persona, r.doc_id) for r in asked.collect()} & want


def test_very_many_callers_are_few_classes(spark, docs):
    """10**5 callers and 1000 documents: classes and bitmaps in place of their pairs."""
    i = F.col("id")
    callers = spark.range(100_000).select(
        F.concat(F.lit("p"), i).alias("persona"), F.concat(F.lit("sub-"), i).alias("sub"), F.when(i % 3 > 0, F.concat(F.lit("ORG_"), F.when(i % 3 == 1, "A").otherwise("B"))).alias("org"), F.array(F.concat(F.lit("group"), i % 1000)).alias("groups"),
        F.array(F.concat(F.lit("rag-clearance:"), F.element_at(F.array(*map(F.lit, ["UNCLASSIFIED", "CUI", "SECRET", "NONE"])), (i % 4 + 1).cast("int"))), F.concat(F.lit("rag-releasability:"), F.element_at(F.array(*map(F.lit, overlay.CAVEATS)), (i % 5 + 1).cast("int")))).alias("roles"),
    )
    seen = access.visibility(access.resolve(callers), docs, overlay.levels(spark))
    assert seen.callers.count() == 75_000 and seen.bitmaps.count() <= 200 and seen.documents.select("document_class").distinct().count() <= 100
    counts = {r.persona: r.n for r in access.visible_counts(seen).collect()}
    few = access.resolve(callers.where("id % 9973 = 1"))
    for r in access.visible_pairs(few, docs, overlay.levels(spark)).groupBy("persona").count().collect():
        assert counts[r.persona] == r["count"]


def test_no_product_of_levels(spark, docs):
    plan = access.allowed_by_caller(access.resolve(overlay.personas(spark)), overlay.levels(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_centroids_by_sums_of_whole_vectors(spark):
    rnd = np.random.default_rng(3)
    rows = [(None if i % 11 == 0 else f"d{i % 37}", rnd.normal(size=5).tolist()) for i in range(900)] + [("d1", None), ("none", None), ("empty", [])]
    frame = spark.createDataFrame(rows, "document_id string, dense array<double>").repartition(6)
    got = {r.document_id: r.dense for r in search.centroid(frame, most_sums=5).collect()}
    want = {k: np.mean([v for d, v in rows if d == k and v], axis=0) for k in {d for d, v in rows if v}}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    with pytest.raises(Exception, match="differ in length|broadcast"):
        search.centroid(spark.createDataFrame([("a", [1.0]), ("a", [1.0, 2.0])], "document_id string, dense array<double>")).collect()
