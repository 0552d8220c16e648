"""Ingestion and audit as streams: dedupe at publication, leases and bounded redelivery, signals over sliding windows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lifecycle import LEASE_SECONDS, MOST_ATTEMPTS
from ..plans.session import shared_dir

ID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
LATE, RETRY_SECONDS, RECONCILE, RECONCILE_BATCH, KEPT_HOURS = "10 minutes", 30, "15 seconds", 100, 24


def read_table_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of the files of a Parquet table (a folder, or one file), in bounded batches."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    return reader.parquet(path)


def timed(stream: DataFrame, column: str, late: str = LATE) -> DataFrame:
    """With a watermark; a timestamp without time zone is taken as UTC."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def published(jobs: DataFrame, key: str = "document_id", at: str = "published_at") -> DataFrame:
    """Each job once, however often it was published within the watermark."""
    return timed(jobs, at).dropDuplicatesWithinWatermark([key])


def split_malformed(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(well formed, dead letters): a body that is no document id is final."""
    good = F.coalesce(F.lower("document_id").rlike(ID), F.lit(False))
    return jobs.where(good), jobs.where(~good)


CLAIMS = "document_id string, attempt int, at timestamp, outcome string"
_STATE = "status string, since double"


def _claim(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, lease: float, most: int) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    status, since = state.get if state.exists else ("queued", 0.0)
    rows = pd.concat(list(batches)).sort_values(["at", "attempt"], kind="stable")  # one document's jobs of one batch
    outcomes = []
    for job in rows.itertuples(index=False):
        now = job.at.timestamp()
        if job.result in ("succeeded", "rejected") and status == "processing":
            status, outcome = "done", job.result
        elif status in ("done", "failed"):
            outcome = "duplicate_terminal"
        elif job.attempt > most:
            status, outcome = "failed", "exhausted"
        elif status == "processing" and job.attempt <= 1 and now - since < lease:
            outcome = "duplicate_in_flight"
        else:
            status, since, outcome = "processing", now, "claimed"
        outcomes.append((key[0], job.attempt, job.at, outcome))
    state.update((status, since))
    state.setTimeoutTimestamp(max(int(rows["at"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + KEPT_HOURS * 3_600_000)
    yield pd.DataFrame(outcomes, columns=["document_id", "attempt", "at", "outcome"])


def claimed(jobs: DataFrame, lease_seconds: int = LEASE_SECONDS, most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """(document_id, attempt, at, outcome) of a stream of (document_id, attempt, at, result): the lease rule with state by document.

    result is null for a delivery, else what the work ended in. A first delivery within the lease of another is in flight;
    a redelivery takes the lease over; one past the last attempt fails the document. A document's state goes KEPT_HOURS after its last job, so that states do not pile up;
    a job that comes later counts as a new document's.
    """

    def run(key, batches, state):
        return _claim(key, batches, state, float(lease_seconds), most_attempts)

    return timed(jobs, "at").groupBy("document_id").applyInPandasWithState(run, CLAIMS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def settled(claims: DataFrame, jobs: DataFrame) -> DataFrame:
    """(document_id, attempt, acknowledge, redeliver_at) for a batch of claims and the jobs' ends (document_id, attempt, result, at).

    A job is acknowledged when its outcome is final: succeeded, rejected, a duplicate of a document that is through, or used up; a failed one comes again RETRY_SECONDS later
    up to the last attempt, and one that is still running, or in flight elsewhere, is left to its lease.
    """
    ends = jobs.select("document_id", "attempt", F.col("result").alias("_result"), F.col("at").alias("_end"))
    rows = claims.join(ends, ["document_id", "attempt"], "left")
    final = F.col("outcome").isin("succeeded", "rejected", "duplicate_terminal", "exhausted") | F.coalesce(F.col("_result").isin("succeeded", "rejected"), F.lit(False))
    failed = F.coalesce(F.col("_result") == "failed", F.lit(False)) & ~final
    last = failed & (F.col("attempt") >= MOST_ATTEMPTS)
    again = F.when(failed, next_delivery(F.col("_end"), F.col("attempt")))
    return rows.select("document_id", "attempt", (final | last).alias("acknowledge"), again.alias("redeliver_at"))


def next_delivery(at: Column, attempt: Column) -> Column:
    """When a failed delivery comes again; null after the last."""
    return F.when(attempt < MOST_ATTEMPTS, at + F.make_dt_interval(secs=F.lit(float(RETRY_SECONDS)).cast("decimal(18,6)")))


PAIRS = "actor_sub string, created_at timestamp, seconds double"


_HELD = "action string, at long, held string"  # held: JSON of (time, id, action) of events that wait


def _pairs(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, most: float) -> Iterator[pd.DataFrame]:
    action, when, held = state.get if state.exists else ("", 0, "[]")
    waiting, out = [tuple(x) for x in json.loads(held)], []
    for rows in () if state.hasTimedOut else batches:
        waiting += zip((t.value // 1000 for t in rows["created_at"]), rows["event_id"].tolist(), rows["action"], strict=True)
    now, most = state.getCurrentWatermarkMs() * 1000, int(most * 1e6)  # times are microseconds
    waiting.sort()
    through = sum(at <= now for at, *_ in waiting)
    for at, _, what in waiting[:through]:
        if what == "query" and action == "query.denied" and at - when <= most:
            out.append((key[0], pd.Timestamp(at, unit="us"), (at - when) / 1e6))
        action, when = what, at
    waiting = waiting[through:]
    if waiting or now - when <= most:
        state.update((action, when, json.dumps(waiting)))
        state.setTimeoutTimestamp(max(now // 1000 + 1, int(waiting[0][0] if waiting else when + most) // 1000 + 1))
    else:
        state.remove()
    if out:
        yield pd.DataFrame(out, columns=["actor_sub", "created_at", "seconds"])


def boundary_stream(events: DataFrame, seconds: int, late: str = LATE) -> DataFrame:
    """Denial-success pairs of each actor, in time order across batches.

    An event waits in its actor's state until the watermark (`late` behind the latest event) has passed it, so that events
    may come in any order up to then; what comes later than that is dropped. An actor's state goes once no event can pair with its last one.
    """
    asked = events.where(F.col("action").isin("query", "query.denied")).select("actor_sub", "action", "created_at", "event_id")

    def run(key, batches, state):
        return _pairs(key, batches, state, float(seconds))

    return timed(asked, "created_at", late).groupBy("actor_sub").applyInPandasWithState(run, PAIRS, _HELD, "append", GroupStateTimeout.EventTimeTimeout)


def windowed_stats(events: DataFrame, length: str = "60 minutes", slide: str = "5 minutes", late: str = LATE) -> DataFrame:
    """(start, actor_sub, attempts, denied, denial_ratio) over sliding windows."""
    rows = timed(events.where(F.col("action").isin("query", "query.denied")), "created_at", late)
    stats = rows.groupBy(F.window("created_at", length, slide), "actor_sub").agg(F.count("*").alias("attempts"), F.count_if(F.col("action") == "query.denied").alias("denied"))
    return stats.select(F.col("window.start").alias("start"), "actor_sub", "attempts", "denied", (F.col("denied") / F.col("attempts")).alias("denial_ratio"))


def hourly_counts(events: DataFrame, by: str, ts: str, late: str = LATE) -> DataFrame:
    rows = timed(events, ts, late)
    return rows.groupBy(F.window(ts, "1 hour"), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), by, "n")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None] | str, checkpoint: str, mode: str = "append"):
    """Works off what there is and stops: a scheduled job. sink: a Parquet path, or a function of (batch, id) whose writes are idempotent."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.format("parquet").option("path", sink).start() if isinstance(sink, str) else writer.foreachBatch(sink).start()
    query.awaitTermination()
    return query


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream of the data there is now comes to, as a table in the shared folder."""
    spark = stream.sparkSession
    place = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        run_available(stream, f"{place}/out", f"{place}/checkpoint")
    else:
        run_available(stream, lambda batch, i: batch.write.mode("overwrite").parquet(f"{place}/out"), f"{place}/checkpoint", mode)
    return spark.read.schema(stream.schema).parquet(f"{place}/out")


def run_every(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, interval: str = RECONCILE):
    """A standing job, such as the reconciler of unpublished documents."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=interval).foreachBatch(sink).start()


def fail_open(forward: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A sink whose failures do not stop the stream: for copies of what is stored elsewhere."""

    def sink(batch: DataFrame, _: int) -> None:
        try:
            forward(batch)
        except Exception as e:  # noqa: BLE001
            print(f"forwarding failed: {type(e).__name__}")

    return sink
