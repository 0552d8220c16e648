"""The job log survives a stream that dies between writing and its own commit; ordered pairs on map state, with bounded state."""

import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import analytics
from corvane.plans import overlay
from corvane.streaming import jobs, joblog, ordered

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def push(spark, source, log, checkpoint):
    stream = spark.readStream.schema(joblog.SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    stream.writeStream.format("joblog").option("path", str(log)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()


def pull(spark, log, place):
    stream = spark.readStream.format("joblog").option("path", str(log)).load()
    stream.writeStream.format("parquet").option("checkpointLocation", f"{place}/checkpoint").option("path", f"{place}/out").trigger(availableNow=True).start().awaitTermination()
    return sorted(r.document_id for r in spark.read.schema(joblog.SCHEMA).parquet(f"{place}/out").collect())


def test_a_stream_that_dies_neither_loses_nor_repeats_a_job(spark, tmp_path):
    spark.dataSource.register(joblog.JobLog)
    source, log, checkpoint, place = (tmp_path / x for x in ("source", "log", "checkpoint", "out"))
    made = spark.range(60).select(F.col("id").cast("string").alias("document_id"), F.timestamp_seconds(F.col("id")).alias("published_at"), F.lit(1).alias("attempt"))
    for i in range(3):
        made.where(F.col("document_id").cast("int") % 3 == i).coalesce(2).write.mode("append").parquet(str(source))
    push(spark, source, log, checkpoint)
    want = sorted(str(i) for i in range(60))
    assert pull(spark, log, place) == want
    published = sorted(p.name for p in log.glob("batch-*.json"))
    # dies after the batch was published, before the stream wrote that it was: the last batch runs again
    last = max((p for p in (checkpoint / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    (checkpoint / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    push(spark, source, log, checkpoint)
    assert sorted(p.name for p in log.glob("batch-*.json")) == published and pull(spark, log, place) == want
    # dies after its tasks wrote, before the batch was published: parts that no list names
    number = int(published[-1][6:-5])
    for name in json.loads((log / published[-1]).read_text()):
        (log / name).rename(log / f"orphan-{name}")
    (log / published[-1]).unlink()
    last.unlink()
    (checkpoint / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    push(spark, source, log, checkpoint)
    assert number in joblog._batches(str(log)) and pull(spark, log, place) == want
    assert sorted(pull(spark, log, tmp_path / "another reader")) == want
    # more jobs come, and are read from where each reader was
    made.limit(2).withColumn("document_id", F.concat(F.lit("new"), "document_id")).coalesce(1).write.mode("append").parquet(str(source))
    push(spark, source, log, checkpoint)
    assert pull(spark, log, place) == sorted([*want, "new0", "new1"])


def test_an_aborted_batch_leaves_no_part(tmp_path):
    writer = joblog.JobWriter(str(tmp_path), None)
    (tmp_path / "part-x.parquet").write_bytes(b"x")
    writer.abort([joblog.Written("part-x.parquet"), None, joblog.Written(None), joblog.Written("gone")], 3)
    assert not list(tmp_path.iterdir()) and joblog.JobReader(str(tmp_path / "none"), None).latestOffset() == {"batches": 0}


def test_ordered_pairs_equal_batch_pairs(spark, tmp_path, store):
    events = overlay.audit(spark.read.parquet(EVENTS))
    source = tmp_path / "events"
    events.repartition(4, "event_id").write.parquet(str(source))  # files in no order of time
    stream = jobs.read_table_stream(spark, str(source), 64)
    got = jobs.drained(ordered.boundary_stream(stream, 21600, "0 seconds"))
    want = analytics.boundary_pairs(events, 21600).where("is_pair").select("actor_sub", F.col("created_at").cast("timestamp").alias("created_at"))
    assert sorted(map(repr, got.select("actor_sub", "created_at").collect())) == sorted(map(repr, want.collect()))


def test_state_is_bounded_by_the_watermark(spark, tmp_path, store):
    """Six files of 300 seconds each: an actor holds the events of the delay and a batch at most, and nothing once time has passed it by."""
    source = tmp_path / "events"
    at = lambda i: F.timestamp_seconds(F.lit(1_700_000_000 + 300 * i) + F.col("id"))
    for i in range(6):
        spark.range(300).select(F.col("id").alias("event_id"), at(i).alias("created_at"), F.concat(F.lit(f"u{i}-"), F.col("id") % 5).alias("actor_sub"), F.when(F.col("id") % 10 < 5, "query.denied").otherwise("query").alias("action")).coalesce(1).write.mode("append").parquet(str(source))
    stream = jobs.read_table_stream(spark, str(source), 1)
    query = ordered.boundary_stream(stream, 60, "10 seconds").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    print("rows in state by batch:", rows)
    assert len(rows) >= 6 and max(rows) == rows[1] <= 4 * 5  # those of a batch and of the one before, while thirty actors have come
