"""Where external models plug in: each seam takes a function on a batch, and has a deterministic stand-in that is no model.

Stand-ins make plans and tests run without a model; their numbers say nothing about a real one.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH = 32


def dense_embedder(embed: Callable[[list[str]], list[list[float]]]):
    """A column function text -> array<float>; texts go to `embed` BATCH at a time, and as many vectors must come back."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out: list[list[float]] = []
            for i in range(0, len(texts), BATCH):
                asked = texts.iloc[i : i + BATCH].fillna("").tolist()
                vectors = embed(asked)
                if len(vectors) != len(asked):
                    raise ValueError(f"{len(asked)} texts gave {len(vectors)} vectors")
                out += vectors
            yield pd.Series(out, index=texts.index)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")


def hashed_vectors(texts: list[str], size: int = 64) -> list[list[float]]:
    """Stand-in: hashed word counts at unit length."""
    out = []
    for text in texts:
        v = np.zeros(size, np.float32)
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
            v[h % size] += 1.0 if h >> 63 else -1.0
        length = float(np.linalg.norm(v))
        out.append((v / length if length else v).tolist())
    return out


def pair_scorer(score: Callable[[list[str], list[str]], list[float]]):
    """A column function (query, text) -> double."""

    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(score(queries.fillna("").tolist(), texts.fillna("").tolist()))

    return F.pandas_udf(run, "double")


def completion(ask: Callable[[str], str]):
    """A column function prompt -> reply; a failed call is null, since advice must not stop ingestion."""

    def one(prompt: str) -> str | None:
        try:
            return ask(prompt)
        except Exception:  # noqa: BLE001
            return None

    def run(prompts: pd.Series) -> pd.Series:
        return prompts.map(one)

    return F.pandas_udf(run, "string")


def captions(describe: Callable[[bytes], str], budget_seconds: float = 90.0):
    """A column function images (array<binary> of one document) -> array<string>: captions until the document's time is up; a failed one is null."""

    def one(images: list[bytes] | None) -> list[str | None]:
        began, out = time.monotonic(), []
        for image in images if images is not None else ():
            if time.monotonic() - began > budget_seconds:
                break
            try:
                out.append(describe(image))
            except Exception:  # noqa: BLE001  a caption is never worth a document
                out.append(None)
        return out

    def run(documents: pd.Series) -> pd.Series:
        return documents.map(one)

    return F.pandas_udf(run, "array<string>")


# -- replies ----------------------------------------------------------------------------------------------------


def parse_suggestion(reply: Column, levels: list[str]) -> Column:
    """(suggested_classification, suggested_doc_type, confidence, rationale): a known level whatever its case, confidence within 0 and 1, blanks null."""
    parsed = F.from_json(reply, "classification string, doc_type string, confidence double, rationale string")
    known = F.create_map(*(F.lit(x) for v in levels for x in (v.upper(), v)))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.struct(
        F.element_at(known, F.upper(F.trim(parsed["classification"]))).alias("suggested_classification"),
        blank(parsed["doc_type"]).alias("suggested_doc_type"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), parsed["confidence"])).alias("confidence"),
        blank(parsed["rationale"]).alias("rationale"),
    )


def parse_findings(reply: Column, most: int = 5) -> Column:
    """An array of (kind, rationale), those with a kind, at most `most`; null for a reply that is no such JSON."""
    parsed = F.from_json(reply, "findings array<struct<kind:string,rationale:string>>")["findings"]
    return F.slice(F.filter(parsed, lambda f: F.length(F.trim(f["kind"])) > 0), 1, most)


def parse_verdicts(reply: Column, n_findings: Column, most: int = 25) -> Column:
    """A map from a finding's index to (likely_false_positive, rationale): the first verdict on an index in range, true or false only."""
    parsed = F.from_json(reply, "verdicts array<struct<index:int,likely_false_positive:boolean,rationale:string>>")["verdicts"]
    good = F.slice(F.filter(parsed, lambda v: v["index"].between(0, n_findings - 1) & v["likely_false_positive"].isNotNull()), 1, most)
    first = lambda state, v: F.when(F.exists(state, lambda s: s["index"] == v["index"]), state).otherwise(F.concat(state, F.array(v)))
    kept = F.aggregate(good, F.array().cast("array<struct<index:int,likely_false_positive:boolean,rationale:string>>"), first)
    return F.map_from_entries(F.transform(kept, lambda v: F.struct(v["index"], F.struct(v["likely_false_positive"].alias("likely_false_positive"), v["rationale"].alias("rationale")))))


def with_verdicts(findings: DataFrame, verdicts: Column) -> DataFrame:
    """findings (an array) with each one's verdict by its position, null where there is none."""
    joined = F.transform("findings", lambda f, i: F.struct(f.alias("finding"), F.try_element_at(verdicts, i).alias("llm_verdict")))
    return findings.withColumn("findings", joined)
