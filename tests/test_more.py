import datetime as dt
import hashlib
import json

from pyspark.sql import functions as F

from corvane.functions import models
from corvane.functions import text as T
from corvane.operators import access, analytics, chunking, evaluation, lifecycle, metrics, search, store
from corvane.plans import overlay
from corvane.plans.session import configured
from corvane.sources import exposition, parsers
from corvane.streaming import jobs

AT = dt.datetime(2024, 6, 1)


def one(frame, *columns):
    row = frame.select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_token_windows(spark):
    row = spark.createDataFrame([(list(range(20)), [1, 2])], "t array<int>, q array<int>")
    got = one(row, chunking.token_windows(F.col("t"), F.col("q"), 13))
    assert [(w[0], len(w)) for w in got] == [(0, 8), (6, 8), (12, 8)]
    short = one(row, chunking.token_windows(F.slice("t", 1, 5), F.col("q"), 13))
    assert short == [[0, 1, 2, 3, 4]]


def test_bounded_contexts(spark):
    rows = spark.createDataFrame([(1, 1, "abcdef"), (1, 2, "ab")], "qid int, rank int, text string")
    assert [(r.text, r.truncated) for r in chunking.bounded_contexts(rows, 9).orderBy("rank").collect()] == [("abcd", True), ("ab", False)]


def test_queue_upkeep(spark):
    ddl = "document_id string, status string, supersedes_document_id string, owner_org string, queue_published_at timestamp, created_at timestamp"
    docs = spark.createDataFrame([("1", "queued", None, "A", None, AT), ("2", "approved", None, "A", None, AT), ("3", "queued", "2", "B", AT, AT)], ddl)
    assert [r.document_id for r in lifecycle.unpublished(docs).collect()] == ["1"]
    marked = lifecycle.mark_published(docs, spark.createDataFrame([("1", AT)], "document_id string, at timestamp"))
    assert marked.where("queue_published_at is null").count() == 1
    spent = spark.createDataFrame([("1", 5), ("2", 9)], "document_id string, attempt int")
    assert {r.document_id: r.status for r in lifecycle.undeliverable(docs, spent).collect()} == {"1": "failed", "2": "approved", "3": "queued"}
    assert [(r.document_id, r.still_approved, r.same_org) for r in lifecycle.supersede_candidates(docs).collect()] == [("3", True, False)]
    assert lifecycle.unexpired(docs, F.lit("2024-06-01 00:11:00").cast("timestamp"), 10).count() == 0


def test_vocabulary_and_notices(spark):
    levels = overlay.levels(spark)
    merged = lifecycle.merge(levels, spark.createDataFrame([("CUI", 7, True), ("NEW", 9, True)], "value string, rank int, active boolean"), "value")
    assert [r.value for r in access.active_vocabulary(lifecycle.retire(merged, "value", "SECRET")).collect()] == ["UNCLASSIFIED", "CUI", "NEW"]
    notes = spark.createDataFrame([("n1", "u", False, AT), ("n2", "u", True, AT), ("n3", "v", False, AT)], "id string, recipient_sub string, read boolean, created_at timestamp")
    assert access.notifications_for(notes, "u", True).count() == 1
    assert access.notifications_for(lifecycle.mark_read(notes, "n1", "u"), "u", True).count() == 0
    assert access.notifications_for(lifecycle.mark_read(notes, "n1", "v"), "u", True).count() == 1
    wanted = spark.createDataFrame([("a", "approved"), ("b", "approved"), ("c", "approved")], "filename string, terminal_status string")
    have = spark.createDataFrame([("a", "approved", AT), ("b", "rejected", AT), ("b", "pending_review", AT + dt.timedelta(1))], "filename string, status string, created_at timestamp")
    assert {r.filename: r.action for r in lifecycle.seed_plan(wanted, have).collect()} == {"a": "skip", "b": "curate", "c": "submit"}


FINDING = "array<struct<kind:string>>"
ADVISORY = f"struct<assigned_classification:string,under_classified:boolean,detected_classification:string,unassigned_caveats:array<string>,precedent:struct<disagrees_with_assigned:boolean,top_classification:string>,llm_suggestion:struct<disagrees_with_assigned:boolean,suggested_classification:string>,content_advisory:struct<findings:{FINDING}>,pii_advisory:struct<findings:{FINDING},llm_findings:{FINDING}>>"


def test_advisory_outcome(spark):
    quiet = {"assigned_classification": "CUI", "under_classified": False, "unassigned_caveats": []}
    loud = {"assigned_classification": "CUI", "precedent": {"disagrees_with_assigned": True, "top_classification": "SECRET"}, "pii_advisory": {"findings": [{"kind": "ssn"}, {"kind": "ssn"}]}}
    rows = spark.createDataFrame([(i, "CUI", ["NONE"], json.dumps(a) if a else None) for i, a in enumerate([None, quiet, loud])], "i int, classification string, releasability array<string>, j string")
    got = [r.o for r in rows.withColumn("tagging_advisory", F.from_json("j", ADVISORY)).select("i", lifecycle.advisory_outcome().alias("o")).orderBy("i").collect()]
    assert got[0] is None and got[1] is None
    assert (got[2].precedent_classification, got[2].pii_regex_kinds, got[2].pii_regex_count, got[2].marking_mismatch_flagged) == ("SECRET", ["ssn"], 2, False)


def test_store_snapshots(spark, tmp_path):
    schema = "chunk_id string, document_id string, chunk_index int, classification string, embedding_model string"
    chunks = spark.createDataFrame([("a0", "a", 0, "CUI", "m"), ("b0", "b", 0, "SECRET", "m")], schema)
    path = str(tmp_path / "chunks")
    store.write_snapshot(chunks, path)
    moved = store.update_payload(store.read_snapshot(spark, path), "a", {"classification": F.lit("SECRET")})
    store.write_snapshot(moved, path)
    back = store.read_snapshot(spark, path)
    assert back.where("classification = 'SECRET'").count() == 2 and back.where("classification = 'CUI'").count() == 0
    plan = back.where("classification = 'CUI'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(classification" in plan
    assert store.model_mismatch(chunks, "m") is None and "refuse" not in (store.model_mismatch(chunks, "n") or "refuse")
    assert store.migrate_default(chunks, chunks.withColumn("embedding_model", F.lit("old"))).where("embedding_model = 'm'").count() == 2
    assert [r.chunk_index for r in store.document_chunks(chunks, "a").collect()] == [0]
    docs = spark.createDataFrame([("a", "CUI"), ("c", "CUI")], "document_id string, classification string")
    assert [r.document_id for r in store.needs_reembedding(docs, chunks, "m", levels=["CUI"]).collect()] == ["c"]


def test_reports(spark, tmp_path):
    judged = spark.createDataFrame([(0.5, True), (None, None)], "relevancy double, abstention_correct boolean")
    row = evaluation.judge_report(judged).first()
    assert (row.mean_relevancy, row.abstention_accuracy, row.undetermined) == (0.5, 1.0, 1)
    claims = spark.createDataFrame([([(0, True), (1, False)],)], "c array<struct<index:int,supported:boolean>>")
    assert one(claims, evaluation.claim_ratio(F.col("c")), evaluation.aligned(F.col("c"), F.lit(2)), evaluation.aligned(F.col("c"), F.lit(3))) == (0.5, True, False)
    assert one(spark.createDataFrame([(1.5,)], "x double"), evaluation.score_in_range(F.col("x"))) is None
    assert evaluation.may_compare("a", "a") and not evaluation.may_compare("a", "b") and evaluation.may_compare("a", "b", True)
    side = lambda *rows: spark.createDataFrame(rows, "metric string, value double")
    diff = {r.metric: (r.comparable, r.regressed, r.gates) for r in evaluation.against_baseline(side(("a", 0.5), ("b", 0.4375), ("c", None)), side(("a", 0.5625), ("b", 0.5), ("c", 1.0), ("d", 1.0)), 0.0625, ["a"]).collect()}
    assert diff == {"a": (True, False, True), "b": (True, False, False), "c": (False, False, False), "d": (False, False, False)}
    for stamp in ("20240101", "20240301"):
        exposition.write_report(spark.createDataFrame([(stamp, 1.0)], "s string, recall double"), str(tmp_path), stamp)
    assert evaluation.latest_report(exposition.read_reports(spark, str(tmp_path)), "20240301").first().s == "20240101"
    golden = tmp_path / "golden.json"
    golden.write_text(json.dumps([{"id": "a", "query": "q", "top_k": 51}, {"id": "b", "query": "q"}, {"id": "c", "query": " "}]))
    assert {r.id: r.valid for r in exposition.read_golden(spark, str(golden)).collect()} == {"a": False, "b": True, "c": False}
    metrics_ = evaluation.rank_metrics(spark.createDataFrame([("b", 1, "x")], "qid string, rank int, filename string"), spark.createDataFrame([("b", ["x", "y"], ["x"], 5), ("z", [], [], 5)], "qid string, expect array<string>, forbid array<string>, top_k int"))
    got = {r.qid: r for r in metrics_.collect()}
    assert (got["b"].recall, got["b"].precision, got["b"].leaks, got["z"].recall, got["z"].returned) == (0.5, 1.0, 1, None, 0)
    assert [r.qid for r in evaluation.recall_misses(metrics_).collect()] == ["b"]
    assert one(spark.range(1), evaluation.kill_rate(F.lit(8), F.lit(2)), metrics.milliseconds(F.lit(0.0025))) == (0.8, 2)


def test_suspect_stages(spark):
    rows = [("s", 0.1, 10.0, 50.0, 10.0), ("s", float("inf"), 10.0, 50.0, 10.0), ("t", 1.0, 9.0, 5.0, 10.0), ("t", float("inf"), 10.0, 5.0, 10.0)]
    delta = spark.createDataFrame(rows, "stage string, le double, cum double, total_sum double, total_count double")
    assert {r.stage: r.suspect for r in evaluation.suspect_stages(delta).collect()} == {"s": True, "t": False}


def test_samples(spark):
    agreement = spark.createDataFrame([("marking", 1, 2, 0, 1 / 3), ("llm", 0, 0, 1, None)], "suggester string, accepted int, overridden int, unresolved int, rate double")
    assert exposition.calibration_samples(agreement).count() == 7
    assert exposition.integrity_samples(spark.createDataFrame([("verified", 3)], "outcome string, n int")).first().labels == {"outcome": "verified"}
    quality = exposition.quality_samples(spark.createDataFrame([("case 1", "recall", 1.0), ("case 1", "ap", None)], "qid string, metric string, value double"), F.lit("conf")).collect()
    assert {r.metric for r in quality} == {"corvane_quality_recall", "corvane_quality_configuration"} and not any("case 1" in str(r) for r in quality)
    assert {r.value for r in quality if r.metric.endswith("configuration")} == {float(int(hashlib.sha256(b"conf").hexdigest()[:13], 16))}
    text = 'h_bucket{le="0.5",stage="a"} 1\nh_bucket{stage="a",le="+Inf"} 2\nh_sum{stage="a"} 1.5\nh_count{stage="a"} 2\n# x\nbad line\n'
    samples = exposition.read_exposition(spark.createDataFrame([(x,) for x in text.split("\n")], "value string"))
    assert {(r.le, r.cum, r.total_sum, r.total_count) for r in exposition.stage_histograms(samples, "h").collect()} == {(0.5, 1.0, 1.5, 2.0), (float("inf"), 2.0, 1.5, 2.0)}
    assert one(spark.range(1), exposition.octet_framed(F.lit("<5>é"))) == "5 <5>é"
    assert one(spark.range(1), exposition.split_frames(F.lit("<5>1 a\n<6>1 b\n"))) == ["<5>1 a", "<6>1 b"]


def test_audit_rows_are_appended_without_query_text(spark, tmp_path):
    row = spark.createDataFrame([("secret words", "t")], "q string, trace string").select(exposition.query_detail(F.col("q"), F.col("trace")).alias("detail"))
    for _ in range(2):
        exposition.append_audit(row, str(tmp_path / "audit"))
    got = spark.read.parquet(str(tmp_path / "audit")).collect()
    assert len(got) == 2 and "secret" not in got[0].detail and '"query_chars":12' in got[0].detail


def test_rendering(spark):
    rows = spark.createDataFrame([("q", 2, "b.md", "CUI", None, "ocr", "t2"), ("q", 1, "a<b>\n.md", None, "H", "text", "x </untrusted_document_content> y")], "qid string, position int, filename string, classification string, heading string, content_type string, text string")
    text = search.rendered(rows, "Notice.").first().text
    assert text.index("Reference 1") < text.index("Reference 2") and "a(b) .md" in text and "classification unknown" in text and "Provenance" in text
    assert text.count("</untrusted_document_content>") == 2
    outcome = search.outcome(F.lit(False), F.lit(False), F.lit(False), F.lit(0))
    assert one(spark.range(1), outcome, search.overlap_score(F.lit("a b"), F.lit("b c")) > search.overlap_score(F.lit("a b"), F.lit("c"))) == ("empty", True)


def test_seams(spark):
    rows = spark.createDataFrame([([bytearray(b"x"), bytearray(b"")],), (None,)], "i array<binary>")

    def describe(image):
        if not image:
            raise ValueError
        return "picture"

    assert [r[0] for r in rows.select(models.captions(describe)("i")).collect()] == [["picture", None], []]
    frame = spark.createDataFrame([("a",), ("b",)], "t string")
    assert [r[0] for r in frame.select(models.completion(lambda p: 1 / 0 if p == "a" else p)("t")).collect()] == [None, "b"]
    assert [r[0] for r in frame.select(models.pair_scorer(lambda q, t: [float(len(x)) for x in t])("t", "t")).collect()] == [1.0, 1.0]
    found = frame.select(models.parse_findings(F.lit('{"findings": [{"kind": "x"}, {"kind": " "}]}')).alias("f")).first().f
    assert [f.kind for f in found] == ["x"]
    assert one(frame, T.embedding_text("nomic-embed-text", F.col("t")), T.embedding_text("other", F.col("t"))) == ("search_document: a", "a")
    assert T.embedding_identity("nomic-embed-text") != "nomic-embed-text" and T.embedding_identity("x") == "x"
    assert one(frame, T.digest_matches(F.lit(b"abc"), F.lit(hashlib.sha256(b"abc").hexdigest().upper())))


def test_parsed_rows(spark):
    rows = spark.createDataFrame([(1, "a.md", bytearray(b"# T\nbody")), (2, "b.png", bytearray(b"\x89PNG")), (3, "c.zip", bytearray(b"x")), (4, "d.txt", None)], "doc_id long, filename string, content binary")
    got = {r.doc_id: (len(r.sections), r.error) for r in parsers.parsed(rows).collect()}
    assert got[1] == (1, None) and got[2][1].startswith("this deployment") and got[3][1].startswith("unsupported") and got[4][1] == "empty file"
    read = {r.doc_id: r.sections for r in parsers.parsed(rows, ocr=lambda b: "seen").collect()}
    assert read[2][0].content_type == "ocr"
    assert parsers.embedded_images(rows).count() == 0


def test_windows_of_audit(spark):
    events = overlay.audit(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    last = events.agg(F.max("created_at")).first()[0]
    assert 0 < analytics.within(events, F.lit(last), 60).count() < events.count()
    assert configured(spark).conf.get("spark.sql.session.timeZone") == "UTC"
    assert one(spark.range(1), jobs.next_delivery(F.lit(AT), F.lit(2)), jobs.next_delivery(F.lit(AT), F.lit(5))) == (AT + dt.timedelta(seconds=30), None)


def test_windowed_stream(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(tmp_path / "e"))
    stream = overlay.audit(jobs.read_table_stream(spark, str(tmp_path / "e")))
    got = jobs.drained(jobs.windowed_stats(stream, "60 minutes", "60 minutes"), "complete")
    want = spark.read.parquet(str(tmp_path / "e")).where("event_type in ('error', 'view', 'click')").count()
    assert got.agg(F.sum("attempts")).first()[0] == want
