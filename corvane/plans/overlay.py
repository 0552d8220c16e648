"""Governance columns over the driver's tables, in both dialects.

`documents` carries no tags, status or audit trail; these deterministic rules stand in for them. Each rule is stated once
in Spark and once in DuckDB SQL (the *_SQL strings), so that oracles see the same relation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = [("UNCLASSIFIED", 0, True), ("CUI", 1, True), ("SECRET", 2, True)]
CAVEATS = ["NONE", "NOFORN", "USA", "NATO", "FVEY"]
PERSONAS = [
    # persona, sub, org, groups, roles
    ("alice", "sub-alice", "ORG_A", ["analysts"], ["rag-query", "rag-clearance:CUI", "rag-releasability:FVEY"]),
    ("bob", "sub-bob", "ORG_B", [], ["rag-query", "rag-clearance:SECRET", "rag-releasability:NATO", "rag-releasability:USA"]),
    ("carol", "sub-carol", None, ["ORG_A"], ["rag-query", "rag-curate:ORG_A", "rag-clearance:SECRET", "rag-releasability:NOFORN"]),
    ("dave", "sub-dave", "ORG_A", [], ["rag-ingest", "rag-clearance:UNCLASSIFIED"]),
    ("erin", "sub-erin", "ORG_B", [], ["rag-query", "rag-clearance:UNKNOWN", "rag-releasability:FVEY"]),
    ("frank", "sub-frank", "ORG_A", [], ["rag-admin", "rag-purge", "rag-clearance:SECRET", *(f"rag-releasability:{c}" for c in CAVEATS)]),
]

LEVELS_SQL = "(values ('UNCLASSIFIED', 0, true), ('CUI', 1, true), ('SECRET', 2, true)) levels(value, rank, active)"


def _list_sql(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::varchar[]"


PERSONAS_SQL = (
    "(values "
    + ", ".join(f"('{p}', '{s}', {'null' if o is None else repr(o)}, {_list_sql(g)}, {_list_sql(r)})" for p, s, o, g, r in PERSONAS)
    + ") personas(persona, sub, org, groups, roles)"
)

GOV_SQL = """(select doc_id, text, lang, source, n_chars,
  case doc_id % 3 when 0 then 'UNCLASSIFIED' when 1 then 'CUI' else 'SECRET' end as classification,
  case (doc_id // 3) % 5 when 0 then ['NONE'] when 1 then ['FVEY'] when 2 then ['NATO', 'FVEY'] when 3 then ['NOFORN'] else ['USA'] end as releasability,
  case doc_id % 4 when 0 then ['ALL_AUTHENTICATED'] when 1 then ['ORG_A'] when 2 then ['ORG_B'] else ['ORG_A', 'ORG_B'] end as access_scope,
  case doc_id % 7 when 4 then 'pending_review' when 5 then 'rejected' when 6 then 'superseded' else 'approved' end as status,
  concat('d', cast(doc_id % 50 as varchar), case doc_id % 5 when 0 then '.txt' when 1 then '.md' when 2 then '.html' when 3 then '.PDF' else '' end) as filename,
  case when cast(substr(source, 4) as int) % 2 = 0 then 'ORG_A' else 'ORG_B' end as owner_org,
  concat('type', cast(cast(substr(source, 4) as int) % 4 as varchar)) as doc_type,
  concat('user', substr(source, 4)) as uploader_sub,
  case when doc_id % 9 = 0 and doc_id > 0 then doc_id - 1 end as supersedes_id,
  timestamp '2024-01-01 00:00:00' + to_minutes(37 * doc_id) as created_at,
  timestamp '2024-01-02 00:00:00' + to_minutes(41 * (doc_id % 500)) as updated_at,
  case when doc_id % 4 > 0 then timestamp '2024-02-01 00:00:00' + to_minutes(13 * (doc_id % 97)) end as last_verified_at
 from documents) gov"""

AUDIT_SQL = """(select event_id, ts as created_at, concat('u', cast(user_id as varchar)) as actor_sub,
  case event_type when 'error' then 'query.denied' when 'view' then 'query' when 'click' then 'query' when 'purchase' then 'document.approve' else 'document.reject' end as action,
  cast(floor(value) as bigint) % 6 as result_count
 from events) audit"""


def levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEVELS, "value string, rank int, active boolean")


def releasability_values(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(v, True) for v in CAVEATS], "value string, active boolean")


def personas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PERSONAS, "persona string, sub string, org string, groups array<string>, roles array<string>")


def governed(documents: DataFrame) -> DataFrame:
    i, s = F.col("doc_id"), F.substring("source", 4, 9).cast("int")
    strings = lambda *v: F.array(*map(F.lit, v))
    third = F.floor(i / 3) % 5
    from_ = lambda start, minutes: F.timestamp_add("MINUTE", minutes.cast("int"), F.lit(start).cast("timestamp_ntz"))
    return documents.select(
        "doc_id",
        "text",
        "lang",
        "source",
        "n_chars",
        F.when(i % 3 == 0, "UNCLASSIFIED").when(i % 3 == 1, "CUI").otherwise("SECRET").alias("classification"),
        F.when(third == 0, strings("NONE")).when(third == 1, strings("FVEY")).when(third == 2, strings("NATO", "FVEY")).when(third == 3, strings("NOFORN")).otherwise(strings("USA")).alias("releasability"),
        F.when(i % 4 == 0, strings("ALL_AUTHENTICATED")).when(i % 4 == 1, strings("ORG_A")).when(i % 4 == 2, strings("ORG_B")).otherwise(strings("ORG_A", "ORG_B")).alias("access_scope"),
        F.when(i % 7 == 4, "pending_review").when(i % 7 == 5, "rejected").when(i % 7 == 6, "superseded").otherwise("approved").alias("status"),
        F.concat(F.lit("d"), (i % 50).cast("string"), F.when(i % 5 == 0, ".txt").when(i % 5 == 1, ".md").when(i % 5 == 2, ".html").when(i % 5 == 3, ".PDF").otherwise("")).alias("filename"),
        F.when(s % 2 == 0, "ORG_A").otherwise("ORG_B").alias("owner_org"),
        F.concat(F.lit("type"), (s % 4).cast("string")).alias("doc_type"),
        F.concat(F.lit("user"), F.substring("source", 4, 9)).alias("uploader_sub"),
        F.when((i % 9 == 0) & (i > 0), i - 1).alias("supersedes_id"),
        from_("2024-01-01 00:00:00", 37 * i).alias("created_at"),
        from_("2024-01-02 00:00:00", 41 * (i % 500)).alias("updated_at"),
        F.when(i % 4 > 0, from_("2024-02-01 00:00:00", 13 * (i % 97))).alias("last_verified_at"),
    )


def audit(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    action = F.when(kind == "error", "query.denied").when(kind.isin("view", "click"), "query").when(kind == "purchase", "document.approve").otherwise("document.reject")
    return events.select(
        "event_id",
        F.col("ts").alias("created_at"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor_sub"),
        action.alias("action"),
        (F.floor("value").cast("long") % 6).alias("result_count"),
    )
