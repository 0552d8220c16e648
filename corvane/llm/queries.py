"""The queries of this subpackage for the entry file: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fim, mixing, oracles, replies, resample, secrets, urls
from .ctw import score_documents
from .html import extract
from .phrases import remove_repeated_phrases
from .quality import judged
from .setsketch import near_duplicates
from .simhash import WIDE, fingerprint_documents, with_neighbours


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary_path() -> str:
    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_read(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_read(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_phrases(_read(spark, sf_dir, "documents"), digest=True)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_read(spark, sf_dir, "pages"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_read(spark, sf_dir, "documents"), vocabulary_path())


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"))
    return mixed.select(F.col("doc_id").cast("long"), "source", "block", "slot", "place")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_neighbours(fingerprint_documents(_read(spark, sf_dir, "documents")), F.col("doc_id") % 100 == 0, WIDE)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"), n=2)


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.digests(_read(spark, sf_dir, "conversations"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(_read(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES = [
    op1_secret_scans,
    op2_lm_scoring,
    op3_url_filters,
    op4_quality_rules,
    op5_substring_dedup,
    op6_html_extraction,
    op7_bpe,
    op8_mixing,
    op9_fingerprints,
    op10_near_dedup,
    op11_chat_formatting,
    op12_fill_in_middle,
    op13_importance_resampling,
]


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
