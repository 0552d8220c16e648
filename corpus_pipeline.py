"""A training corpus from `documents`: good texts, one of each group of near copies, live secrets masked, sources interleaved, encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, mixing, quality, secrets, setsketch
from corvane.llm.common import staged
from corvane.llm.queries import vocabulary_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the learned list go.

    Null and empty texts fail the base rules (under 20 words). Repeated rows are judged alike, each by its own text; a null id takes no part in
    learning. Without labels only the base rules hold. Further columns, whatever their names, pass through; an empty table stays empty.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of five-word near duplicates the document with the least id stays.

    Of rows with one id (a document's repeated rows too) the first by its columns in order stays. Rows without an id all stay, and null or empty texts link
    with nothing. Long texts are compared whole. Further columns pass through; an empty table stays empty.
    """
    return setsketch.keep_one(docs, n=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live secrets are masked in the texts; widely copied examples stay.

    n_chars follows the masked text. Null texts stay null, rows come out one for one (repeated ones too), a null source or language counts as an empty name.
    Further columns pass through; an empty table stays empty.
    """
    return secrets.mask_live(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are sorted so that blocks of the sources interleave at their target weights.

    All rows stay. A null source is a source of its own, a null or negative n_chars counts as none, sources of equal weight take slots in the order of their names, and
    rows with equal ids, sizes and texts are interchangeable. Further columns pass through; an empty table stays empty.
    """
    return mixing.interleaved(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, slot and place in the mix, token ids, their number, and whether decoding gives the text back; in the order of the mix.

    Files that are read again come in any order, so the schedule, which depends on the rows alone, is worked out again here.
    A null text has no ids and round_trip is true for it; null ids and sources stay null, repeated rows come out one for one. All other columns are left out; an empty table stays empty.
    """
    sized = ["n_chars"] if "n_chars" in docs.columns else []  # without it, both this stage and the one before size rows by their texts
    mixed = mixing.mix(docs.select("doc_id", "source", *sized, F.coalesce("text", F.lit("")).alias("text"))).orderBy("slot", "place")
    both = bpe.encode_and_decode(mixed, vocabulary_path())
    return both.select("doc_id", "source", "slot", "place", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("secret scans", secret_scans),
    ("source mixing", source_mixing),
    ("bpe encoding", bpe_encoding),
]

# The learned rules, the schedule and BPE are beyond SQL; tests/llm holds each stage against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs)
    return docs
