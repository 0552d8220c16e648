"""Quality rules as a learned decision list.

Statistics of each whole text are columns. From labelled rows a list of rules is learned by sequential covering: a rule,
a conjunction of thresholds that foretells label 0, is grown on two thirds of the rows left, condition by condition by FOIL gain,
pruned on the last third, and kept while its precision there is high enough; the rows it covers are then set aside. The list
becomes one ordered conditional Spark expression over the columns.

At most SAMPLE labelled rows (those whose ids hash lowest) are used for fitting.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PART_BYTES, Ids, bounded, distinct, hash_words, packed, slices, to_bytes, unpacked, windows, words_of

SAMPLE = 6_000
SYMBOLS = "#*$%&|<>"
WINDOW = 8
STRETCH = 50  # distinct words are counted in stretches, so that their share does not fall with length
BREAKS = " \t\n\v\f\r"
REPEAT = 0x165667B19E3779F9
PRECISION = 0.93
LEAST_COVER = 5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_upper", "n_letters", "n_digits", "n_marks", "n_lines", "n_distinct", "n_short"]


# -- statistics -------------------------------------------------------------------------------------------------


def repeated_words(words: list[bytes], numbers: np.ndarray, hashes: np.ndarray) -> int:
    """Words within windows of WINDOW words that the text holds twice or more, the first of them included."""
    if len(words) < WINDOW:
        return 0
    h = windows(hashes[numbers], WINDOW, REPEAT)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    if not same.any():
        return 0  # equal windows have equal hashes
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    seen: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(again).tolist():
        seen.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    edge = np.zeros(len(words) + 1, np.int64)
    for places in seen.values():
        if len(places) > 1:
            np.add.at(edge, places, 1)
            np.add.at(edge, np.array(places) + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(texts: list[str | None]) -> np.ndarray:
    """A row of COUNTS and MORE for each text."""
    seen, parted = Ids(), []
    for text in texts:
        words = words_of(to_bytes(text))
        parted.append((words, np.fromiter(map(seen.__getitem__, words), np.int64, len(words))))
    hashes = hash_words(seen)
    short = np.fromiter((len(w) <= 3 for w in seen), bool, len(seen))
    out = np.zeros((len(texts), len(COUNTS) + len(MORE)), np.int64)
    for row, (text, (words, x)) in enumerate(zip(texts, parted, strict=True)):
        if not words:
            if text:
                out[row, 2] = sum(map(text.count, SYMBOLS))
            continue
        lines = [line for line in text.split("\n") if line.strip(BREAKS)]
        data = np.frombuffer(to_bytes(text), np.uint8)
        upper, lower = ((data >= a) & (data <= b) for a, b in ((65, 90), (97, 122)))
        out[row] = (
            len(words),
            len(text) - sum(map(text.count, BREAKS)),
            sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)),
            repeated_words(words, x, hashes),
            upper.sum(),
            upper.sum() + lower.sum(),
            ((data >= 48) & (data <= 57)).sum(),
            text.count("!") + text.count("?"),
            len(lines),
            len(distinct(np.arange(len(x)) // STRETCH * len(seen) + x)),
            short[x].sum(),
        )
    return out


STATISTICS = ", ".join(f"{c} long" for c in COUNTS + MORE)


def _frame(texts: pd.Series) -> pd.DataFrame:
    listed = texts.tolist()
    parts = [statistics(listed[some.start : some.stop]) for some in slices([len(t or "") + 512 for t in listed], PART_BYTES)]
    return pd.DataFrame(np.concatenate(parts) if parts else np.empty((0, len(COUNTS + MORE)), np.int64), columns=COUNTS + MORE)


def _measure(text: Column) -> Column:
    return F.pandas_udf(_frame, STATISTICS)(text)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row's text; a null text counts as empty."""
    return bounded(docs).select(F.col("doc_id").cast("long"), _measure(F.col("text").cast("string")).alias("_stats")).select("doc_id", "_stats.*")


def base_failed(of: str = "") -> Column:
    n, repeats = F.col(f"{of}n_words"), F.col(f"{of}n_repeat_words")
    return (n < 20) | (100 * repeats > 30 * n)


FEATURES = {
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "n_letters"),
    "digits": ("n_digits", "word_chars"),
    "marks": ("n_marks", "n_words"),
    "distinct": ("n_distinct", "n_words"),
    "short": ("n_short", "n_words"),
    "word_length": ("word_chars", "n_words"),
    "line_length": ("n_words", "n_lines"),
}


def feature(name: str, of: str = "") -> Column:
    """A share or mean of statistics (below the struct `of`, if given as "name."); 0 where its base is 0."""
    top, base = FEATURES[name]
    return F.coalesce(F.col(of + top) / F.nullif(F.col(of + base), F.lit(0)), F.lit(0.0))


# -- learning ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self, of: str = "") -> Column:
        value = feature(self.feature, of)
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(x.values()))), bool)
    for condition in rule:
        out &= condition.holds(x)
    return out


def _precision(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> float:
    hit = covered(rule, x)
    return (bad[hit].sum() + 1.0) / (hit.sum() + 2.0)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int = 4) -> Rule:
    rule, on = (), np.ones(len(bad), bool)
    while len(rule) < most and bad[on].any() and not bad[on].all():
        p0, n0 = bad[on].sum(), on.sum()
        best = (0.0, None)
        for name, values in x.items():
            v = values[on]
            order = np.argsort(v, kind="stable")
            s, b = v[order], np.cumsum(bad[on][order])
            cut = np.flatnonzero(s[1:] > s[:-1])
            for above in (False, True):
                p = b[cut] if not above else p0 - b[cut]
                n = cut + 1 if not above else n0 - cut - 1
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / n) - np.log2(p0 / n0)), 0.0)
                if len(gain) and gain.max() > best[0] + 1e-9:
                    i = int(gain.argmax())
                    best = (float(gain[i]), Condition(name, above, float((s[cut[i]] + s[cut[i] + 1]) / 2)))
        if best[1] is None:
            break
        rule += (best[1],)
        on = covered(rule, x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The shortest prefix of the best worth (bad - good) / covered on rows that did not grow it."""

    def worth(k: int) -> float:
        hit = covered(rule[:k], x)
        return (2.0 * bad[hit].sum() - hit.sum()) / max(1, hit.sum())

    return rule[: max(range(len(rule), 0, -1), key=lambda k: (worth(k), -k))] if rule else rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = PRECISION, most: int = 12, seed: int = 4) -> list[Rule]:
    """An ordered list of rules, each of which foretells a bad row."""
    part = np.random.default_rng(seed).permutation(len(bad)) % 3
    left, rules = np.ones(len(bad), bool), []
    pick = lambda on: ({k: v[on] for k, v in x.items()}, bad[on])
    while len(rules) < most and bad[left].sum() >= LEAST_COVER:
        rule = _grow(*pick(left & (part > 0)))
        rule = _prune(rule, *pick(left & (part == 0)))
        if not rule:
            break
        hit = covered(rule, x) & left
        if hit.sum() < LEAST_COVER or _precision(rule, *pick(left)) < precision or _precision(rule, *pick(left & (part == 0))) < precision - 0.1:
            break
        rules.append(rule)
        left &= ~hit
    return rules


def fired(rules: list[Rule], of: str = "") -> Column:
    """The number of the first rule that holds (from 1), else null: one CASE in the order of the list."""
    out = None
    for k, rule in enumerate(rules, 1):
        condition = rule[0].column(of)
        for c in rule[1:]:
            condition = condition & c.column(of)
        out = F.when(condition, k) if out is None else out.when(condition, k)
    return F.lit(None).cast("int") if out is None else out.cast("int")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """The list for labels (doc_id, quality); rows without an id, a 0 or a 1 are left out, and no labels give no rules.

    An id counts once: with the least of its labels, and the least of its texts; so the list depends on the rows alone.
    """
    picked = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    picked = F.broadcast(picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.join(picked, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    stats = bounded(rows).select("doc_id", "quality", _measure(F.col("text")).alias("_stats"))
    table = stats.select("doc_id", "quality", *(feature(f, "_stats.").alias(f) for f in FEATURES)).toPandas().sort_values("doc_id")  # `sample` rows at most
    if not len(table):
        return []
    return learn({f: table[f].to_numpy(float) for f in FEATURES}, table["quality"].to_numpy() == 0)


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with its columns, that judged() would keep."""
    rules = fit(docs, labels, sample)
    rows = packed(bounded(docs), _measure(F.col("text").cast("string")).alias("_stats"))
    return unpacked(rows.where(~base_failed("_stats.") & fired(rules, "_stats.").isNull()), docs.columns)


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and rule for each row.

    kept is false if base_failed, or if a rule of the learned list holds; `rule` is that rule's number. A null or empty text has no word and
    fails the base. Repeated rows are judged alike; other columns are left out.
    """
    rules = fit(docs, labels, sample)
    out = measured(docs).withColumn("base_failed", base_failed()).withColumn("rule", fired(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).select("doc_id", *COUNTS, "base_failed", "kept", "rule")
