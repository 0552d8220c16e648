import datetime as dt

from pyspark.sql import functions as F

from corvane.operators import analytics
from corvane.plans import overlay
from corvane.streaming import jobs

EVENTS = "/root/testdata/sf0.001/events.parquet"


def drain(spark, stream, tmp_path, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_stream_pairs_equal_batch_pairs(spark, tmp_path):
    source = tmp_path / "events"
    spark.read.parquet(EVENTS).repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(str(source))
    stream = overlay.audit(jobs.read_table_stream(spark, str(source), 64))
    got = drain(spark, jobs.boundary_stream(stream, 21600), tmp_path, "pairs").groupBy("actor_sub").count()
    want = analytics.boundary_pairs(overlay.audit(spark.read.parquet(EVENTS)), 21600).where("is_pair").groupBy("actor_sub").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_leases_and_redelivery(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    second = lambda s: at + dt.timedelta(seconds=s)
    rows = [("a", 1, second(0), None), ("a", 1, second(10), None), ("a", 2, second(20), None), ("a", 1, second(330), None), ("a", 1, second(331), "succeeded"), ("a", 1, second(332), None), ("b", 6, second(0), None), ("b", 1, second(9), None)]
    spark.createDataFrame(rows, "document_id string, attempt int, at timestamp, result string").coalesce(1).write.parquet(str(tmp_path / "jobs"))
    got = drain(spark, jobs.claimed(jobs.read_table_stream(spark, str(tmp_path / "jobs"))), tmp_path, "claims").orderBy("document_id", "at")
    assert [r.outcome for r in got.collect()] == ["claimed", "duplicate_in_flight", "claimed", "claimed", "succeeded", "duplicate_terminal", "exhausted", "duplicate_terminal"]


def test_publication_is_deduplicated_and_malformed_bodies_are_parted(spark, tmp_path):
    good = "12345678-1234-1234-1234-123456789012"
    at = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(good, at), (good, at), ("junk", at), (None, at)], "document_id string, published_at timestamp").write.parquet(str(tmp_path / "p"))
    fine, dead = jobs.split_malformed(jobs.read_table_stream(spark, str(tmp_path / "p")))
    assert drain(spark, jobs.published(fine), tmp_path, "fine").count() == 1
    assert drain(spark, dead, tmp_path, "dead").count() == 2


def test_hourly_counts(spark, tmp_path):
    spark.read.parquet(EVENTS).write.parquet(str(tmp_path / "e"))
    got = drain(spark, jobs.hourly_counts(jobs.read_table_stream(spark, str(tmp_path / "e")), "event_type", "ts"), tmp_path, "hours", "complete")
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(EVENTS).count()


def test_foreach_batch_resumes(spark, tmp_path):
    spark.read.parquet(EVENTS).write.parquet(str(tmp_path / "e"))
    seen = []
    for _ in range(2):
        jobs.run_available(jobs.read_table_stream(spark, str(tmp_path / "e")), lambda batch, i: seen.append(batch.count()), str(tmp_path / "c"))
    assert sum(seen) == spark.read.parquet(EVENTS).count()
    jobs.fail_open(lambda b: 1 / 0)(spark.range(1), 0)
