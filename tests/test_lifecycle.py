import datetime as dt

from pyspark.sql import functions as F

from corvane.operators import analytics, evaluation, lifecycle, metrics, store

AT = dt.datetime(2024, 6, 1)
DDL = "document_id string, status string, classification string, releasability array<string>, access_scope array<string>, owner_org string, uploader_sub string, filename string, uploader_username string, source_originator string, doc_type string, supersedes_document_id string, reviewed_at timestamp, first_approved_at timestamp, updated_at timestamp, rejection_reason string, chunk_count int, content_sha256 string"


def doc(i, status, old=None, first=None):
    return (i, status, "CUI", ["NONE"], ["ALL_AUTHENTICATED"], "A", "u", "f.txt", "n", "s", "t", old, None, first, None, None, 4, "ab")


def say(spark, *rows):
    return spark.createDataFrame([(i, "c", AT, why) for i, why in rows], "document_id string, actor_sub string, at timestamp, reason string")


def status(frame):
    return {r.document_id: r.status for r in frame.collect()}


def test_approve_supersedes_once_and_only_an_approved_one(spark):
    docs = spark.createDataFrame([doc("1", "approved"), doc("2", "pending_review", "1"), doc("3", "pending_review", "4"), doc("4", "rejected"), doc("5", "rejected")], DDL)
    after, audit, notes = lifecycle.approve(docs, say(spark, ("2", ""), ("3", ""), ("5", "")).drop("reason"))
    assert status(after) == {"1": "superseded", "2": "approved", "3": "pending_review", "4": "rejected", "5": "rejected"}
    assert {(r.target_id, r.action) for r in audit.collect()} == {("2", "document.approve"), ("3", "document.approve.refused"), ("5", "document.approve.refused")}
    assert [r.document_id for r in notes.collect()] == ["2"]
    assert after.where("document_id = '2'").first().first_approved_at == AT


def test_reject_needs_a_reason_and_suspend_an_approved_document(spark):
    docs = spark.createDataFrame([doc("1", "pending_review"), doc("2", "pending_review"), doc("3", "approved")], DDL)
    assert status(lifecycle.reject(docs, say(spark, ("1", "no"), ("2", " "), ("3", "no")))[0]) == {"1": "rejected", "2": "pending_review", "3": "approved"}
    assert status(lifecycle.suspend(docs, say(spark, ("1", "x"), ("3", "x")))[0]) == {"1": "pending_review", "2": "pending_review", "3": "pending_review"}


def test_edit_beyond_authority_demotes(spark):
    docs = spark.createDataFrame([doc("1", "approved"), doc("2", "approved"), doc("3", "superseded")], DDL)
    edits = spark.createDataFrame([("1", "c", AT, "SECRET", None), ("2", "c", AT, "UNCLASSIFIED", None), ("3", "c", AT, "SECRET", None)], "document_id string, actor_sub string, at timestamp, classification string, releasability array<string>")
    after, _ = lifecycle.edit(docs, edits, ["UNCLASSIFIED", "CUI"], [])
    assert {r.document_id: (r.status, r.classification) for r in after.collect()} == {"1": ("pending_review", "SECRET"), "2": ("approved", "UNCLASSIFIED"), "3": ("superseded", "CUI")}


def test_purge_scrubs_and_is_idempotent(spark):
    docs = spark.createDataFrame([doc("1", "approved", first=AT), doc("2", "purged")], DDL)
    after, audit = lifecycle.purge(docs, say(spark, ("1", "spill"), ("2", "spill")))
    row = after.where("document_id = '1'").first()
    assert (row.status, row.filename, row.releasability, row.content_sha256, row.chunk_count) == ("purged", lifecycle.PURGED_TEXT, [], None, 0)
    details = {r.target_id: (r.action, r.detail) for r in audit.collect()}
    assert details["1"][0] == "document.purge" and '"chat_plane_action_required":true' in details["1"][1] and "f.txt" not in details["1"][1]
    assert details["2"][0] == "document.purge.refused"


def test_two_persons_confirm_in_time(spark):
    later = AT + dt.timedelta(hours=1)
    requests = spark.createDataFrame([("1", "a", AT, later, "pending"), ("2", "a", AT, later, "pending"), ("3", "a", AT, AT, "pending"), ("4", "a", AT, later, "confirmed")], "document_id string, requested_by_sub string, requested_at timestamp, expires_at timestamp, status string")
    said = spark.createDataFrame([("1", "b", AT), ("2", "a", AT), ("3", "b", AT), ("4", "b", AT)], "document_id string, actor_sub string, at timestamp")
    assert {r.document_id: r.verdict for r in lifecycle.confirm_purge(requests, said).collect()} == {"1": "confirmed", "2": "same_person", "3": "expired", "4": "not_pending"}
    wanted = spark.createDataFrame([("1", "c", "r", AT), ("3", "c", "r", AT)], "document_id string, requested_by_sub string, reason string, at timestamp")
    assert [r.document_id for r in lifecycle.request_purge(requests, wanted).collect()] == ["3"]


def test_claims(spark):
    docs = spark.createDataFrame([("1", "queued", None), ("2", "processing", AT), ("3", "approved", None)], "document_id string, status string, processing_started_at timestamp")
    soon, late = AT + dt.timedelta(seconds=299), AT + dt.timedelta(seconds=300)
    jobs = spark.createDataFrame([("1", 1, soon), ("2", 1, soon), ("2", 2, soon), ("2", 1, late), ("3", 1, soon), ("9", 1, soon)], "document_id string, attempt int, at timestamp")
    got = [r.outcome for r in lifecycle.claim(docs, jobs).orderBy("document_id", "at", "attempt").collect()]
    assert got == ["claimed", "duplicate_in_flight", "claimed", "claimed", "duplicate_terminal", "unknown"]


def test_store(spark):
    schema = "chunk_id string, document_id string, chunk_index int, classification string, text string"
    old = spark.createDataFrame([(f"d{i}", "d", i, "CUI", "o") for i in range(4)] + [("e0", "e", 0, "CUI", "o")], schema)
    new = spark.createDataFrame([(f"d{i}", "d", i, "SECRET", "n") for i in range(2)], schema)
    got = {r.chunk_id: r.text for r in store.replace_document(old, new).collect()}
    assert got == {"d0": "n", "d1": "n", "e0": "o"}
    assert store.delete_document(old, new).count() == 1
    bad = spark.createDataFrame([("x", "x", 0, None, "n")], schema)
    try:
        store.upsert(old, bad).collect()
        raise AssertionError("a chunk without a level must fail")
    except Exception as e:
        assert "without classification" in str(e)


def test_integrity(spark):
    docs = spark.createDataFrame([("1", "k1", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad", None), ("2", "k2", "00", AT), ("3", "k3", "00", AT), ("4", "k4", None, None)], "document_id string, original_object_key string, content_sha256 string, last_verified_at timestamp")
    objects = spark.createDataFrame([("k1", bytearray(b"abc")), ("k2", bytearray(b"abc"))], "original_object_key string, content binary")
    assert {r.document_id: r.outcome for r in lifecycle.integrity(docs, objects).collect()} == {"1": "verified", "2": "mismatched", "3": "missing"}
    assert [r.document_id for r in lifecycle.integrity(docs, objects, 1).collect()] == ["1"]


def events(spark, *rows):
    return spark.createDataFrame([(i, "a", action, AT + dt.timedelta(seconds=s), n) for i, (action, s, n) in enumerate(rows)], "event_id long, actor_sub string, action string, created_at timestamp, result_count long")


def test_anomalies(spark):
    pairs = [x for k in range(5) for x in (("query.denied", 100 * k, None), ("query", 100 * k + 10, 5))]
    flagged = analytics.with_signals(analytics.identity_stats(events(spark, *pairs))).first()
    assert flagged.boundary_pairs == 5 and set(flagged.signals) == {"denial_ratio", "boundary_mapping"}
    late = analytics.identity_stats(events(spark, ("query.denied", 0, None), ("query", 301, 5), ("query", 302, 5))).first()
    assert late.boundary_pairs == 0
    none = analytics.identity_stats(events(spark, ("query", 0, None))).first()
    assert (none.singleton_or_empty, none.denial_ratio) == (0, 0.0)


def test_histogram(spark):
    rows = [(0, "s", 0.01, 0.0, 0.0, 0.0)] + [(1, "s", le, c, 0.55, 10.0) for le, c in ((0.01, 0.0), (0.05, 6.0), (0.1, 10.0), (float("inf"), 10.0))] + [(1, "t", float("inf"), 0.0, 0.0, 0.0)]
    snapshots = spark.createDataFrame(rows, "snapshot int, stage string, le double, cum double, total_sum double, total_count double")
    delta = evaluation.histogram_delta(snapshots)
    got = {r.stage: r.value for r in evaluation.histogram_quantile(delta, 0.5).collect()}
    assert abs(got["s"] - (0.01 + 0.04 * 5 / 6)) < 1e-9 and got["t"] is None


def test_counter_resets(spark):
    rows = spark.createDataFrame([("m", AT + dt.timedelta(seconds=60 * i), v) for i, v in enumerate([5.0, 8.0, 2.0, 4.0])], "metric string, ts timestamp, value double")
    assert [r.step for r in metrics.increases(rows, ["metric"]).orderBy("ts").collect()] == [0.0, 3.0, 2.0, 2.0]
    assert [r.increase for r in metrics.increase(rows, ["metric"], 60).orderBy("ts").collect()] == [0.0, 3.0, 5.0, 4.0]
    runs = metrics.sustained(rows, ["metric"], F.col("value") < 6, 60).collect()
    assert [(r.since, r.until) for r in runs] == [(AT + dt.timedelta(seconds=120), AT + dt.timedelta(seconds=180))]


def test_average_precision(spark):
    rows = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True), (2, 1, False)], "qid int, rank int, relevant boolean")
    assert {r.qid: round(r.ap, 6) for r in evaluation.average_precision(rows).collect()} == {1: round((1 + 2 / 3) / 2, 6), 2: 0.0}
