"""Who may see, tag, curate and query what: every predicate is a Column or a join, so Catalyst pushes and prunes.

Two rules for caveats must not be mixed: reading needs ANY overlap with what the caller holds (or NONE),
authority over a document needs ALL of its caveats held.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.session import staged

# fixed values: role names and sentinels
CLEARANCE, RELEASABILITY, CURATE = "rag-clearance:", "rag-releasability:", "rag-curate:"
INGEST, QUERY, ADMIN, PURGE = "rag-ingest", "rag-query", "rag-admin", "rag-purge"
EVERYONE, UNRESTRICTED = "ALL_AUTHENTICATED", "NONE"
MOST_QUERY_CHARS, MOST_TOP_K = 4000, 50


class ConflictingClearance(ValueError):
    """A caller's roles name two different clearances."""


@dataclass(frozen=True)
class Claims:
    """One caller; for many callers use resolve() on a DataFrame of them."""

    sub: str
    org: str | None = None
    groups: tuple[str, ...] = ()
    roles: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if len(set(self._stripped(CLEARANCE))) > 1:
            raise ConflictingClearance(f"{self.sub}: {sorted(set(self._stripped(CLEARANCE)))}")

    def _stripped(self, prefix: str) -> list[str]:
        return [r[len(prefix) :] for r in self.roles if r.startswith(prefix)]

    @property
    def clearance(self) -> str:
        return next(iter(self._stripped(CLEARANCE)), "")

    @property
    def releasability(self) -> list[str]:
        return self._stripped(RELEASABILITY)

    @property
    def curatable_orgs(self) -> list[str]:
        return self._stripped(CURATE)

    @property
    def scopes(self) -> list[str]:
        return [EVERYONE, self.sub, *self.groups, *([self.org] if self.org else [])]

    def has(self, role: str) -> bool:
        return role in self.roles


# -- roles ------------------------------------------------------------------------------------------------------


def with_prefix(roles: Column, prefix: str) -> Column:
    """What follows the prefix in the roles that have it."""
    return F.transform(F.filter(roles, lambda r: r.startswith(prefix)), lambda r: F.substring(r, len(prefix) + 1, F.length(r)))


def has_role(roles: Column, role: str) -> Column:
    return F.array_contains(roles, role)


def resolve(callers: DataFrame) -> DataFrame:
    """callers (sub, org, groups, roles) with clearance, held, curatable, scopes, the role flags and conflicting.

    A caller whose roles name two clearances is conflicting, and its clearance is null: it sees nothing.
    """
    roles = F.col("roles")
    named = F.array_distinct(with_prefix(roles, CLEARANCE))
    org = F.when(F.coalesce(F.col("org"), F.lit("")) != "", F.array("org")).otherwise(F.array().cast("array<string>"))
    flags = {"can_ingest": INGEST, "can_query": QUERY, "is_admin": ADMIN, "can_purge": PURGE}
    return callers.select(
        "*",
        (F.size(named) > 1).alias("conflicting"),
        F.when(F.size(named) == 1, F.get(named, F.lit(0))).alias("clearance"),
        with_prefix(roles, RELEASABILITY).alias("held"),
        with_prefix(roles, CURATE).alias("curatable"),
        F.concat(F.array(F.lit(EVERYONE), "sub"), "groups", org).alias("scopes"),
        *(has_role(roles, role).alias(name) for name, role in flags.items()),
    )


# -- clearance --------------------------------------------------------------------------------------------------


def allowed_levels(levels: DataFrame, clearance: str) -> list[str]:
    """Active levels up to the caller's own, which need not be active; none for an unknown one. By rank."""
    own = levels.where(F.col("value") == clearance).select(F.col("rank").alias("own"))
    rows = levels.join(F.broadcast(own.limit(1)), F.col("rank") <= F.col("own")).where("active").orderBy("rank", "value")
    return [r["value"] for r in rows.select("value").collect()]  # an administrator's list of levels


def allowed_by_caller(callers: DataFrame, levels: DataFrame) -> DataFrame:
    """callers (with clearance) with `allowed`, the array of levels each may read; empty for an unknown clearance.

    A level's set is the active levels up to its rank: a running collection over the list of levels, which administrators keep.
    """
    upto = F.collect_list(F.when(F.col("active"), F.struct("rank", "value"))).over(Window.orderBy("rank").rangeBetween(Window.unboundedPreceding, 0))
    every = levels.select(F.col("value").alias("clearance"), "rank", upto.alias("_upto"))
    sets = every.groupBy("clearance").agg(F.transform(F.array_sort(F.array_distinct(F.max_by("_upto", "rank"))), lambda x: x["value"]).alias("allowed"))
    empty = F.array().cast("array<string>")
    return callers.join(sets, "clearance", "left").withColumn("allowed", F.coalesce("allowed", empty))


# -- predicates over documents or chunks ------------------------------------------------------------------------


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def readable_releasability(held: Column) -> Column:
    """ANY rule."""
    return F.arrays_overlap("releasability", F.concat(F.array(F.lit(UNRESTRICTED)), held))


def held_releasability(held: Column) -> Column:
    """ALL rule."""
    return F.size(F.array_except("releasability", F.concat(F.array(F.lit(UNRESTRICTED)), held))) == 0


def in_scope(scopes: Column) -> Column:
    return F.arrays_overlap("access_scope", scopes)


def access_filter(claims: Claims, allowed: list[str]) -> Column:
    """The mandatory filter, cheapest tests first; with no allowed level it is false."""
    level = F.col("classification").isin(allowed) if allowed else F.lit(False)
    return level & (F.col("status") == "approved") & readable_releasability(_strings(claims.releasability)) & in_scope(_strings(claims.scopes))


def secured(frame: DataFrame, claims: Claims, levels: DataFrame) -> DataFrame:
    """The only way to a searchable frame: what this caller may read."""
    return frame.where(access_filter(claims, allowed_levels(levels, claims.clearance)))


def visible_pairs(callers: DataFrame, documents: DataFrame, levels: DataFrame) -> DataFrame:
    """(persona, doc_id) for many callers: an equi-join on level, scope and caveat over exploded sets, not a cross join.

    callers is resolve()d. A pair that overlaps in several scopes or caveats comes once.
    """
    who = allowed_by_caller(callers, levels).select("persona", F.explode("allowed").alias("classification"), "scopes", "held")
    who = who.select("persona", "classification", F.explode(F.array_distinct("scopes")).alias("scope"), "held")
    who = who.select("persona", "classification", "scope", F.explode(F.array_distinct(F.concat(F.array(F.lit(UNRESTRICTED)), "held"))).alias("caveat"))
    what = documents.where("status = 'approved'").select("doc_id", "classification", F.explode(F.array_distinct("access_scope")).alias("scope"), "releasability")
    what = what.select("doc_id", "classification", "scope", F.explode(F.array_distinct("releasability")).alias("caveat"))
    return what.join(who, ["classification", "scope", "caveat"]).select("persona", "doc_id").distinct()


@dataclass(frozen=True)
class Visibility:
    """Who may read what, by classes of callers and documents that no filter tells apart.

    callers: (persona, caller_class); documents: (doc_id, document_class), approved ones; bitmaps: (caller_class, bucket, bits), the
    document classes that a caller class reads, 32,768 to a bitmap.
    """

    callers: DataFrame
    documents: DataFrame
    bitmaps: DataFrame


def visibility(callers: DataFrame, documents: DataFrame, levels: DataFrame) -> Visibility:
    """The classes of resolve()d callers and of documents, and which of them meet; what is shared with nobody or asks for nothing that is in use is left out.

    A caller's signature is its levels, and those of its scopes and caveats that some document bears, so its own name counts only where documents are shared with it. Documents
    and callers are reduced to signatures first; only signatures are exploded and joined. No pair of a caller and a document is made.
    """
    approved = documents.where("status = 'approved'").select("doc_id", "classification", F.array_sort(F.array_distinct("access_scope")).alias("scopes"), F.array_sort(F.array_distinct("releasability")).alias("caveats"))
    signature = ["classification", "scopes", "caveats"]
    # ids follow the layout of the staged table: dense within each of its parts, so that a bitmap holds many
    kinds = staged(staged(approved.select(*signature).distinct()).withColumn("document_class", F.monotonically_increasing_id()))
    same = [approved[c].eqNullSafe(kinds[c]) for c in signature]
    belong = approved.join(kinds, same).select("doc_id", "document_class")

    def used(column: str, held: Column, name: str) -> DataFrame:
        """Of what each caller holds, what documents bear."""
        bears = kinds.select(F.explode(column).alias("_x")).distinct()
        return callers.select("persona", F.explode(F.array_distinct(held)).alias("_x")).join(bears, "_x", "left_semi").groupBy("persona").agg(F.array_sort(F.collect_set("_x")).alias(name))

    theirs = used("scopes", F.col("scopes"), "_scopes").join(used("caveats", F.concat(F.array(F.lit(UNRESTRICTED)), "held"), "_caveats"), "persona")
    theirs = allowed_by_caller(callers, levels).where(F.size("allowed") > 0).select("persona", "allowed").join(theirs, "persona")
    groups = theirs.select("persona", F.xxhash64("allowed", "_scopes", "_caveats").alias("caller_class"), "allowed", "_scopes", "_caveats")
    each = groups.groupBy("caller_class").agg(F.first("allowed").alias("allowed"), F.first("_scopes").alias("_scopes"), F.first("_caveats").alias("_caveats"))
    who = each.select("caller_class", F.explode("allowed").alias("classification"), "_scopes", "_caveats")
    who = who.select("caller_class", "classification", F.explode("_scopes").alias("scope"), "_caveats").select("caller_class", "classification", "scope", F.explode("_caveats").alias("caveat"))
    what = kinds.select("document_class", "classification", F.explode("scopes").alias("scope"), "caveats").select("document_class", "classification", "scope", F.explode("caveats").alias("caveat"))
    met = what.join(who, ["classification", "scope", "caveat"]).select("caller_class", "document_class").distinct()
    bits = met.groupBy("caller_class", F.bitmap_bucket_number("document_class").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("document_class")).alias("bits"))
    return Visibility(staged(groups.select("persona", "caller_class")), staged(belong), staged(bits))


def _placed(documents: DataFrame) -> DataFrame:
    return documents.withColumn("bucket", F.bitmap_bucket_number("document_class")).withColumn("_bit", F.bitmap_bit_position("document_class"))


def _set(bits: Column, bit: Column) -> Column:
    """Whether a bitmap has the bit."""
    byte = F.conv(F.hex(F.substring(bits, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2.0), bit % 8)) % 2 == 1


def may_read(seen: Visibility, pairs: DataFrame) -> DataFrame:
    """pairs (persona, doc_id) with `visible`; a caller or document that is in no class sees, or is seen by, none."""
    rows = pairs.join(seen.callers, "persona", "left").join(_placed(seen.documents), "doc_id", "left").join(seen.bitmaps, ["caller_class", "bucket"], "left")
    return rows.select(*pairs.columns, F.coalesce(_set(F.col("bits"), F.col("_bit")), F.lit(False)).alias("visible"))


def visible_counts(seen: Visibility) -> DataFrame:
    """(persona, n): how many documents each caller may read, from the sizes of classes; callers who read none are left out."""
    sizes = _placed(seen.documents.groupBy("document_class").agg(F.count("*").alias("_n")))
    by_class = seen.bitmaps.join(sizes, "bucket").where(_set(F.col("bits"), F.col("_bit"))).groupBy("caller_class").agg(F.sum("_n").alias("n"))
    return seen.callers.join(by_class, "caller_class").select("persona", "n")


def pairs_of(seen: Visibility) -> DataFrame:
    """(persona, doc_id): all pairs written out, for those who need them; as many as there are."""
    kinds = _placed(seen.documents.select("document_class").distinct())
    met = seen.bitmaps.join(kinds, "bucket").where(_set(F.col("bits"), F.col("_bit"))).select("caller_class", "document_class")
    return seen.callers.join(met, "caller_class").join(seen.documents, "document_class").select("persona", "doc_id")


def tags_authorised(claims: Claims, allowed: list[str]) -> Column:
    return (F.col("classification").isin(allowed) if allowed else F.lit(False)) & held_releasability(_strings(claims.releasability))


def visible_to_curator(scopes: list[str]) -> Column:
    """A pending document needs a matching scope, a decided one does not."""
    return (F.col("status") != "pending_review") | in_scope(_strings(scopes))


def curation_queue(documents: DataFrame, claims: Claims, allowed: list[str]) -> DataFrame:
    orgs = F.col("owner_org").isin(claims.curatable_orgs) if claims.curatable_orgs else F.lit(False)
    return documents.where((F.col("status") == "pending_review") & orgs & tags_authorised(claims, allowed) & visible_to_curator(claims.scopes))


def master_list(documents: DataFrame, claims: Claims, allowed: list[str], status: str | None = None, classification: str | None = None, q: str | None = None) -> DataFrame:
    """What the caller may list, latest change first: a curator's organisations and tags, or all for a purger who curates none."""
    scoped = documents
    if claims.curatable_orgs or not claims.has(PURGE):
        orgs = F.col("owner_org").isin(claims.curatable_orgs) if claims.curatable_orgs else F.lit(False)
        scoped = documents.where(orgs & tags_authorised(claims, allowed) & visible_to_curator(claims.scopes))
    if status:
        scoped = scoped.where(F.col("status") == status)
    if classification:
        scoped = scoped.where(F.col("classification") == classification)
    if q:
        like = "%" + q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
        scoped = scoped.where(F.col("filename").ilike(like) | F.col("uploader_sub").ilike(like) | F.col("owner_org").ilike(like) | F.col("doc_type").ilike(like))
    return scoped.orderBy(F.desc("updated_at"), "doc_id")


def upload_errors(allowed: list[str], held: list[str]) -> Column:
    """Both errors of an upload's tags, in order; empty if there is none."""
    level = F.when(~F.col("classification").isin(allowed) if allowed else F.lit(True), "classification_not_permitted")
    caveats = F.when(~held_releasability(_strings(held)), "releasability_not_permitted")
    return F.array_compact(F.array(level, caveats))


def supersede_errors(new_org: Column, allowed: list[str], held: list[str]) -> Column:
    """Errors of the document to be superseded: a foreign organisation alone, else all others."""
    rest = F.array_compact(
        F.array(
            F.when(F.col("status") != "approved", "not_approved"),
            F.when(~F.col("classification").isin(allowed) if allowed else F.lit(True), "classification_not_permitted"),
            F.when(~held_releasability(_strings(held)), "releasability_not_permitted"),
        )
    )
    return F.when(F.col("owner_org") != new_org, F.array(F.lit("different_org"))).otherwise(rest)


def authority_code(claims: Claims, allowed: list[str]) -> Column:
    """The first failing check: 404 foreign organisation, 403 for level, caveats or scope, else 200."""
    orgs = F.col("owner_org").isin(claims.curatable_orgs) if claims.curatable_orgs else F.lit(False)
    level = F.col("classification").isin(allowed) if allowed else F.lit(False)
    return (
        F.when(~orgs, "404_org").when(~level, "403_classification").when(~held_releasability(_strings(claims.releasability)), "403_releasability").when(~visible_to_curator(claims.scopes), "403_scope").otherwise("200")
    )


def bounded_query(query: Column, top_k: Column) -> tuple[Column, Column]:
    """Whether the query is neither blank nor too long, and top_k held within its bounds."""
    fits = (F.length(F.trim(query)) > 0) & (F.length(query) <= MOST_QUERY_CHARS)
    return fits, F.greatest(F.lit(1), F.least(F.lit(MOST_TOP_K), top_k))


def my_documents(documents: DataFrame, sub: str) -> DataFrame:
    return documents.where(F.col("uploader_sub") == sub).orderBy(F.desc("created_at"), "doc_id")


def notifications_for(notifications: DataFrame, sub: str, unread_only: bool = False) -> DataFrame:
    rows = notifications.where(F.col("recipient_sub") == sub)
    return (rows.where(~F.col("read")) if unread_only else rows).orderBy(F.desc("created_at"))


def active_vocabulary(levels: DataFrame) -> DataFrame:
    return levels.where("active").orderBy("rank")


def filter_summary(containers: DataFrame, allowed: list[str]) -> DataFrame:
    """(classification, queried): each allowed level and whether a container for it exists."""
    spark = containers.sparkSession
    wanted = spark.createDataFrame([(v,) for v in allowed], "classification string")
    return wanted.join(containers.select("classification", F.lit(True).alias("queried")).distinct(), "classification", "left").withColumn("queried", F.coalesce("queried", F.lit(False)))


def access_matrix_report(expected: DataFrame, seen: DataFrame) -> DataFrame:
    """(persona, doc_id, outcome): seen, missing or leaked, of expected and observed pairs."""
    both = expected.withColumn("_e", F.lit(True)).join(seen.withColumn("_s", F.lit(True)), ["persona", "doc_id"], "full")
    outcome = F.when(F.col("_e").isNull(), "leaked").when(F.col("_s").isNull(), "missing").otherwise("seen")
    return both.select("persona", "doc_id", outcome.alias("outcome"))


def latest_first(frame: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row for each key: the first in the given order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return frame.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


# fixed values: what a curator sees of a chunk, and what stands for a missing value
CONTENT = {"chunk_index": None, "heading": None, "page_or_slide": None, "content_type": "text", "text": None}


def chunk_content(chunks: DataFrame) -> DataFrame:
    """The declared fields of chunks and no other, whatever columns the table has gained."""
    value = lambda c, other: F.col(c) if c in chunks.columns else F.lit(None).cast("string")
    return chunks.select(*(F.coalesce(value(c, d), F.lit(d)).alias(c) if d else value(c, d).alias(c) for c, d in CONTENT.items()))


def page_after(rows: DataFrame, key: str, after=None, size: int = 1000) -> DataFrame:
    """The next `size` rows by key after a key; the last row's key asks for the page after it. A scan over all needs no pages."""
    return (rows if after is None else rows.where(F.col(key) > F.lit(after))).orderBy(key).limit(size)
