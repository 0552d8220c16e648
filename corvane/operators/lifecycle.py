"""Document lifecycle as pure transitions: a snapshot and a set of decisions give the next snapshot, audit rows and notifications.

Decisions arrive as a relation; each guard is a column, so a batch of any size is one join. The caller writes the results together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


EDITABLE = ["pending_review", "approved", "rejected"]
RETRIEVABLE = ["approved", "superseded", "purging"]
PURGED_TEXT = "[PURGED]"
LEASE_SECONDS, MOST_ATTEMPTS, PURGE_HOURS = 300, 5, 24


def _decided(documents: DataFrame, decisions: DataFrame) -> DataFrame:
    """documents with the decision on each, if any; a document's first decision in (at, actor_sub) order counts."""
    first = F.row_number().over(Window.partitionBy("document_id").orderBy("at", "actor_sub"))
    one = decisions.withColumn("_n", first).where("_n = 1").drop("_n")
    renamed = one.select("document_id", *(F.col(c).alias(f"_{c}") for c in one.columns if c != "document_id"))
    return documents.join(renamed, "document_id", "left")


def _rest(documents: DataFrame, made: DataFrame, changes: dict[str, Column]) -> DataFrame:
    return made.select(*(F.when(F.col("_done"), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in documents.columns))


def _audit(made: DataFrame, action: str, *detail: Column) -> DataFrame:
    rows = made.where("_actor_sub is not null")
    name = F.when(F.col("_done"), action).otherwise(f"{action}.refused")
    return rows.select(F.col("_actor_sub").alias("actor_sub"), name.alias("action"), F.col("document_id").alias("target_id"), F.to_json(F.struct(F.col("status").alias("from_status"), *detail)).alias("detail"), F.col("_at").alias("created_at"))


def _notices(made: DataFrame, decision: str, message: Column) -> DataFrame:
    return made.where("_done").select(F.col("uploader_sub").alias("recipient_sub"), "document_id", F.lit(decision).alias("decision"), message.alias("message"), F.lit(False).alias("read"), F.col("_at").alias("created_at"))


def approve(documents: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, audit, notifications) after approvals (document_id, actor_sub, at, classification?, releasability?).

    Only a pending document is approved; corrections replace its tags; first_approved_at is set once. The document that an approved one
    supersedes becomes superseded if it is still approved; if it is not, the approval is refused.
    """
    for name, kind in (("classification", "string"), ("releasability", "array<string>")):
        if name not in decisions.columns:
            decisions = decisions.withColumn(name, F.lit(None).cast(kind))
    made = _decided(documents, decisions)
    old = documents.select(F.col("document_id").alias("supersedes_document_id"), (F.col("status") == "approved").alias("_old"))
    made = made.join(old, "supersedes_document_id", "left")
    fits = F.col("supersedes_document_id").isNull() | F.coalesce("_old", F.lit(False))
    made = made.withColumn("_done", F.col("_actor_sub").isNotNull() & (F.col("status") == "pending_review") & fits)
    changes = {
        "status": F.lit("approved"),
        "classification": F.coalesce("_classification", "classification"),
        "releasability": F.coalesce("_releasability", "releasability"),
        "reviewed_at": F.col("_at"),
        "first_approved_at": F.coalesce("first_approved_at", "_at"),
        "updated_at": F.col("_at"),
    }
    after = _rest(documents, made, changes)
    gone = made.where("_done and supersedes_document_id is not null").groupBy(F.col("supersedes_document_id").alias("document_id")).agg(F.min("_at").alias("_gone"))
    after = after.join(gone, "document_id", "left")
    after = after.withColumn("status", F.when(F.col("_gone").isNotNull(), "superseded").otherwise(F.col("status"))).withColumn("updated_at", F.coalesce("_gone", "updated_at")).select(*documents.columns)
    corrected = F.col("_classification").isNotNull() | F.col("_releasability").isNotNull()
    return after, _audit(made, "document.approve", F.coalesce("_classification", "classification").alias("classification"), corrected.alias("corrected")), _notices(made, "approved", F.lit("approved"))


def reject(documents: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """After rejections (document_id, actor_sub, at, reason) of pending documents; a blank reason is refused."""
    made = _decided(documents, decisions)
    reason = F.trim("_reason")
    made = made.withColumn("_done", F.coalesce((F.col("status") == "pending_review") & (F.length(reason) > 0), F.lit(False)))
    after = _rest(documents, made, {"status": F.lit("rejected"), "rejection_reason": F.col("_reason"), "reviewed_at": F.col("_at"), "updated_at": F.col("_at")})
    return after, _audit(made, "document.reject", F.col("_reason").alias("reason")), _notices(made, "rejected", F.col("_reason"))


def suspend(documents: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """After suspensions (document_id, actor_sub, at, reason): an approved document goes back to review."""
    made = _decided(documents, decisions)
    made = made.withColumn("_done", F.coalesce(F.col("_actor_sub").isNotNull() & (F.col("status") == "approved"), F.lit(False)))
    after = _rest(documents, made, {"status": F.lit("pending_review"), "updated_at": F.col("_at")})
    return after, _audit(made, "document.suspend", F.col("_reason").alias("reason")), _notices(made, "suspended", F.col("_reason"))


def edit(documents: DataFrame, decisions: DataFrame, allowed: list[str], held: list[str]) -> tuple[DataFrame, DataFrame]:
    """After edits (document_id, actor_sub, at, classification?, releasability?) of editable documents.

    Tags beyond the editor's authority are not refused: they send the document back to review.
    """
    made = _decided(documents, decisions)
    made = made.withColumn("_done", F.coalesce(F.col("_actor_sub").isNotNull() & F.col("status").isin(EDITABLE), F.lit(False)))
    level, caveats = F.coalesce("_classification", "classification"), F.coalesce("_releasability", "releasability")
    within = (level.isin(allowed) if allowed else F.lit(False)) & (F.size(F.array_except(caveats, F.array(F.lit("NONE"), *map(F.lit, held)))) == 0)
    status = F.when(within, F.col("status")).otherwise("pending_review")
    after = _rest(documents, made, {"classification": level, "releasability": caveats, "status": status, "updated_at": F.col("_at")})
    return after, _audit(made, "document.edit", (~within).alias("demoted"))


def supersede_candidates(documents: DataFrame) -> DataFrame:
    """(document_id, supersedes_document_id, still_approved, same_org) for each document that names a predecessor."""
    old = documents.select(F.col("document_id").alias("supersedes_document_id"), F.col("status").alias("_s"), F.col("owner_org").alias("_o"))
    rows = documents.where("supersedes_document_id is not null").join(old, "supersedes_document_id", "left")
    return rows.select("document_id", "supersedes_document_id", F.coalesce(F.col("_s") == "approved", F.lit(False)).alias("still_approved"), F.coalesce(F.col("_o") == F.col("owner_org"), F.lit(False)).alias("same_org"))


# -- purge ------------------------------------------------------------------------------------------------------

SCRUBBED = ["filename", "uploader_sub", "uploader_username", "source_originator", "doc_type"]
EMPTIED = ["releasability", "access_scope"]
NULLED = ["program_community", "effective_date", "original_object_key", "content_sha256", "rejection_reason", "processing_error", "tagging_advisory"]


def purge_signal() -> tuple[Column, Column]:
    """Whether a purged document may live on in chats, and since when it could be retrieved."""
    needed = F.col("status").isin(RETRIEVABLE) | F.col("first_approved_at").isNotNull()
    return needed, F.when(needed, F.coalesce("first_approved_at", "reviewed_at"))


def purge(documents: DataFrame, confirmed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, audit) after purging the confirmed ones (document_id, actor_sub, reason, at).

    Strings become a mark, lists empty, the rest null, the advisory included, which may quote the text. A purged document stays as it is.
    """
    made = _decided(documents, confirmed).withColumn("_done", F.coalesce(F.col("_actor_sub").isNotNull() & (F.col("status") != "purged"), F.lit(False)))
    kind = {f.name: f.dataType for f in documents.schema}
    changes: dict[str, Column] = {"status": F.lit("purged"), "updated_at": F.col("_at"), "chunk_count": F.lit(0)}
    changes |= {c: F.lit(PURGED_TEXT) for c in SCRUBBED} | {c: F.array().cast("array<string>") for c in EMPTIED}
    changes |= {c: F.lit(None).cast(kind[c]) for c in NULLED if c in kind}
    needed, since = purge_signal()
    audit = _audit(made, "document.purge", F.col("_reason").alias("reason"), F.col("chunk_count").alias("chunks"), needed.alias("chat_plane_action_required"), since.alias("retrievable_since"))
    return _rest(documents, made, changes), audit


def purge_stored(documents: DataFrame, confirmed: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, audit, chunks, objects) after purging the confirmed documents.

    chunks: without those of purged documents, in whatever container; objects: the keys (original_object_key) whose originals are to be deleted.
    Write the three tables with store.write_together() and hand the keys to files.delete_objects().
    """
    from .store import delete_document

    after, audit = purge(documents, confirmed)
    gone = documents.join(confirmed.select("document_id").distinct(), "document_id", "left_semi").where("status <> 'purged'")
    objects = gone.where("original_object_key is not null").select("original_object_key").distinct() if "original_object_key" in documents.columns else gone.select(F.lit(None).cast("string").alias("original_object_key")).limit(0)
    return after, audit, delete_document(chunks, gone), objects


def open_requests(requests: DataFrame, now: Column) -> DataFrame:
    return requests.where((F.col("status") == "pending") & (F.col("expires_at") > now))


def request_purge(requests: DataFrame, wanted: DataFrame, hours: int = PURGE_HOURS) -> DataFrame:
    """New pending requests for wanted (document_id, requested_by_sub, reason, at): none where one is still open."""
    open_ = requests.where("status = 'pending'").select("document_id", "expires_at")
    new = wanted.join(open_, (wanted["document_id"] == open_["document_id"]) & (open_["expires_at"] > wanted["at"]), "left_anti")
    return new.select("document_id", "reason", "requested_by_sub", F.col("at").alias("requested_at"), (F.col("at") + F.make_dt_interval(hours=F.lit(hours))).alias("expires_at"), F.lit("pending").alias("status"))


def confirm_purge(requests: DataFrame, confirmations: DataFrame) -> DataFrame:
    """requests with `verdict` for confirmations (document_id, actor_sub, at): confirmed only by a second person in time."""
    said = confirmations.select("document_id", F.col("actor_sub").alias("_by"), F.col("at").alias("_when"))
    rows = requests.join(said, "document_id", "left")
    verdict = (
        F.when(F.col("_by").isNull(), "unanswered")
        .when(F.col("status") != "pending", "not_pending")
        .when(F.col("expires_at") <= F.col("_when"), "expired")
        .when(F.col("_by") == F.col("requested_by_sub"), "same_person")
        .otherwise("confirmed")
    )
    return rows.withColumn("verdict", verdict).drop("_by", "_when")


# -- queue and upkeep -------------------------------------------------------------------------------------------


def claim(documents: DataFrame, jobs: DataFrame, lease_seconds: int = LEASE_SECONDS) -> DataFrame:
    """jobs (document_id, attempt, at) with the outcome of claiming: claimed, unknown, duplicate_terminal or duplicate_in_flight."""
    rows = jobs.join(documents.select("document_id", "status", "processing_started_at"), "document_id", "left")
    age = F.col("at").cast("timestamp").cast("double") - F.col("processing_started_at").cast("timestamp").cast("double")
    busy = F.col("status").isin("processing", "embedded") & (F.col("attempt") <= 1) & F.coalesce(age < lease_seconds, F.lit(False))
    outcome = F.when(F.col("status").isNull(), "unknown").when(~F.col("status").isin("queued", "processing", "embedded"), "duplicate_terminal").when(busy, "duplicate_in_flight").otherwise("claimed")
    return rows.select("document_id", "attempt", "at", outcome.alias("outcome"))


def undeliverable(documents: DataFrame, jobs: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """documents whose job has used up its attempts, marked failed; those already decided stay."""
    spent = jobs.groupBy("document_id").agg(F.max("attempt").alias("_n")).where(F.col("_n") >= most)
    rows = documents.join(spent, "document_id", "left")
    status = F.when(F.col("_n").isNotNull() & F.col("status").isin("queued", "processing", "embedded"), "failed").otherwise(F.col("status"))
    return rows.withColumn("status", status).select(*documents.columns)


def unpublished(documents: DataFrame, limit: int = 100) -> DataFrame:
    """The oldest queued documents whose job was never published."""
    return documents.where("status = 'queued' and queue_published_at is null").orderBy("created_at", "document_id").limit(limit)


def backlog(documents: DataFrame, now: Column) -> DataFrame:
    """(unpublished, oldest_seconds): how many queued documents no job was published for, and the age of the oldest; 0 without any."""
    rows = documents.where("status = 'queued' and queue_published_at is null")
    age = now.cast("timestamp").cast("double") - F.min(F.col("created_at").cast("timestamp")).cast("double")
    return rows.agg(F.count("*").alias("unpublished"), F.coalesce(age, F.lit(0.0)).alias("oldest_seconds"))


def mark_published(documents: DataFrame, published: DataFrame) -> DataFrame:
    rows = documents.join(published.select("document_id", F.col("at").alias("_at")), "document_id", "left")
    return rows.withColumn("queue_published_at", F.coalesce("queue_published_at", "_at")).select(*documents.columns)


def merge(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert of a vocabulary: new rows replace those with their key."""
    return table.join(new.select(key), key, "left_anti").unionByName(new)


def retire(table: DataFrame, key: str, value: str) -> DataFrame:
    return table.withColumn("active", F.when(F.col(key) == value, F.lit(False)).otherwise(F.col("active")))


def mark_read(notifications: DataFrame, notification_id: str, sub: str) -> DataFrame:
    mine = (F.col("id") == notification_id) & (F.col("recipient_sub") == sub)
    return notifications.withColumn("read", F.col("read") | mine)


def seed_plan(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """wanted (filename, terminal_status) with the action for each: skip, curate or submit, by the latest document of that name."""
    latest = existing.groupBy("filename").agg(F.max_by("status", "created_at").alias("_s"))
    rows = wanted.join(latest, "filename", "left")
    action = F.when(F.col("_s") == F.col("terminal_status"), "skip").when(F.col("_s") == "pending_review", "curate").otherwise("submit")
    return rows.select(*wanted.columns, action.alias("action"))


def unexpired(table: DataFrame, now: Column, minutes: int) -> DataFrame:
    """Rows created within the last minutes: states of ten, sessions of 480."""
    return table.where(F.col("created_at") >= now - F.make_dt_interval(mins=F.lit(minutes)))


def integrity_candidates(documents: DataFrame, limit: int = 500) -> DataFrame:
    """Documents with a digest and an original, those checked longest ago, or never, first."""
    return documents.where("content_sha256 is not null and original_object_key is not null").orderBy(F.asc_nulls_first("last_verified_at"), "document_id").limit(limit)


def integrity(documents: DataFrame, objects: DataFrame | str, limit: int = 500, tasks: int | None = None) -> DataFrame:
    """(document_id, outcome) for the documents checked longest ago: verified, mismatched, missing, or unread where a table holds the object without its content.

    objects: the root of their store, of which the batch's objects are read, as streams and by `tasks` tasks (some to each core if None), and no others; or a table
    (original_object_key, content). Documents without a digest are not candidates.
    """
    from ..sources.files import object_digests

    batch = integrity_candidates(documents, limit)
    if isinstance(objects, str):
        digests = object_digests(batch, objects, tasks).where("length is not null")
    else:
        digests = objects.join(batch.select("original_object_key"), "original_object_key", "left_semi").withColumn("sha256", F.sha2("content", 256))
    rows = batch.join(digests.select("original_object_key", F.col("sha256").alias("_d"), F.lit(True).alias("_there")), "original_object_key", "left")
    outcome = F.when(F.col("_there").isNull(), "missing").when(F.col("_d").isNull(), "unread").when(F.col("_d") == F.lower("content_sha256"), "verified").otherwise("mismatched")
    return rows.select("document_id", outcome.alias("outcome"))


def outcome_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("outcome").agg(F.count("*").alias("n"))


def advisory_outcome() -> Column:
    """What a decision keeps of a document's advisory (struct `tagging_advisory`): flags, kinds and counts, no text; null if nothing was flagged."""
    a = F.col("tagging_advisory")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    kinds = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda f: f["kind"])))
    marking = F.coalesce(a["under_classified"], F.lit(False)) | (size(a["unassigned_caveats"]) > 0)
    precedent, llm = (F.coalesce(a[k]["disagrees_with_assigned"], F.lit(False)) for k in ("precedent", "llm_suggestion"))
    risks, pii, pii_llm = a["content_advisory"]["findings"], a["pii_advisory"]["findings"], a["pii_advisory"]["llm_findings"]
    any_ = marking | precedent | llm | (size(risks) > 0) | (size(pii) > 0) | (size(pii_llm) > 0)
    made = F.struct(
        a["assigned_classification"].alias("assigned_classification"),
        marking.alias("marking_mismatch_flagged"),
        a["detected_classification"].alias("flagged_classification"),
        a["unassigned_caveats"].alias("flagged_caveats"),
        F.col("classification").alias("final_classification"),
        F.col("releasability").alias("final_releasability"),
        F.when(precedent, a["precedent"]["top_classification"]).alias("precedent_classification"),
        F.when(llm, a["llm_suggestion"]["suggested_classification"]).alias("llm_suggested_classification"),
        F.when(size(risks) > 0, kinds(risks)).alias("content_advisory_kinds"),
        F.when(size(pii) > 0, kinds(pii)).alias("pii_regex_kinds"),
        F.when(size(pii) > 0, F.size(pii)).alias("pii_regex_count"),
        F.when(size(pii_llm) > 0, kinds(pii_llm)).alias("pii_llm_kinds"),
    )
    return F.when(any_, made)


