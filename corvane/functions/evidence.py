"""Findings with their places: one automaton and one pattern for a whole batch of texts, and one rule for what is kept.

An Aho-Corasick automaton goes over a folded text once. It finds every phrase, and the anchors without which a detector can't match, so that most texts meet no
detector's pattern at all. Hits of all sources are alike, (kind, rank, offset, length, detail): the first MOST of a kind by rank and offset are kept, and shown by offset.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import groupby
from operator import itemgetter

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ALIASES, ASSIGNED, AWS, BANNERS, CANONICAL, CARD, GITHUB, NOISE, PEM, PHRASES, PORTION_ONLY, ROUTING, SLACK, SSN, TAIL

RADIUS, MOST, REDACTED = 20, 5, "[REDACTED]"
FINDINGS = "array<struct<kind:string,detail:string,context:string,offset:int>>"
MARKINGS = "array<struct<offset:int,classification:string,caveats:array<string>,matched:string>>"
CODE_POINT = "U+{:04X} {}"  # fixed value: how a finding names a character

Hit = tuple[str, int, int, int, str]  # kind, rank, offset, length, detail


class _Shown(dict):
    """For str.translate: what stands for a character in evidence that people read; tabs, line ends and printable ones stand for themselves."""

    def __missing__(self, code: int) -> str | int:
        found = self[code] = code if chr(code).isprintable() else "\\u%04x" % code
        return found


_SHOWN = _Shown({9: 9, 10: 10})


# -- detectors --------------------------------------------------------------------------------------------------


def _luhn(digits: str) -> bool:
    doubled = (int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits)))
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def _routing(digits: str) -> bool:
    return sum(w * int(c) for w, c in zip((3, 7, 1) * 3, digits, strict=True)) % 10 == 0


def _card(found: str) -> bool:
    digits = re.sub("[ -]", "", found)
    return 13 <= len(digits) <= 19 and _luhn(digits)


@dataclass(frozen=True)
class Detector:
    kind: str
    detail: str
    pattern: re.Pattern
    test: object = None
    anchors: tuple[str, ...] = ()  # in lower case; one stands in every match

    def hits(self, rank: int, text: str) -> Iterator[Hit]:
        for m in self.pattern.finditer(text):
            if self.test is None or self.test(m[0]):
                yield self.kind, rank, m.start(), len(m[0]), self.detail


# fixed values: kind, label and pattern, in the order in which kinds share their cap
DETECTORS = [
    Detector("ssn", "US Social Security Number pattern", re.compile(SSN)),
    Detector("credit_card", "Credit card number pattern (Luhn-valid)", re.compile(CARD), _card),
    Detector("bank_routing", "Bank routing number pattern (ABA checksum-valid)", re.compile(ROUTING), _routing),
    Detector("api_key", "AWS access key ID pattern", re.compile(AWS), None, ("akia",)),
    Detector("api_key", "GitHub access token pattern", re.compile(GITHUB), None, tuple(f"gh{c}_" for c in "pousr")),
    Detector("api_key", "Slack token pattern", re.compile(SLACK), None, tuple(f"xox{c}-" for c in "baprs")),
    Detector("api_key", "possible API key/token/secret assignment", re.compile(ASSIGNED), None, ("key", "token", "secret")),
    Detector("private_key_block", "PEM private-key block header", re.compile(PEM), None, ("private key",)),
]
_DIGITS = re.compile(r"\d[\d -]{7}")  # in every match of a detector without anchors


@cache
def automaton() -> ahocorasick.Automaton:
    """Values: the numbers of phrases, and of detectors as negative ones."""
    values: dict[str, list[int]] = {}
    for i, phrase in enumerate(PHRASES):
        values.setdefault(phrase, []).append(i)
    for i, d in enumerate(DETECTORS):
        for anchor in d.anchors:
            values.setdefault(anchor, []).append(-1 - i)
    out = ahocorasick.Automaton()
    for word, numbers in values.items():
        out.add_word(word, (len(word), numbers))
    out.make_automaton()
    return out


def scanned(folded: str) -> tuple[dict[int, list[int]], set[int]]:
    """In one pass: the offsets at which each phrase stands, without overlaps of its own, and the detectors whose anchors stand."""
    places: dict[int, list[int]] = {}
    detectors: set[int] = set()
    for last, (size, numbers) in automaton().iter(folded):
        for i in numbers:
            if i < 0:
                detectors.add(-1 - i)
            elif i not in places:
                places[i] = [last + 1 - size]
            elif last + 1 - size >= places[i][-1] + size:
                places[i].append(last + 1 - size)
    return places, detectors


def kept(hits: list[Hit]) -> list[Hit]:
    """The first MOST of each kind by rank and offset; all by offset, then rank."""
    some = [h for _, of in groupby(sorted(hits), itemgetter(0)) for h in list(of)[:MOST]]
    return sorted(some, key=itemgetter(2, 1))


def _finding(hit: Hit, context: str) -> dict:
    return {"kind": hit[0], "detail": hit[4], "context": context, "offset": hit[2]}


def pii_of(text: str | None) -> list[dict]:
    """Sensitive data, itself blacked out."""
    if not text:
        return []
    # ASCII letters alone fold here, one for one, but for the sign of Kelvin and the long s, which the patterns' case-blind part takes for k and s, too
    _, anchored = scanned(text.lower().replace("\u017f", "s"))
    numbers = bool(_DIGITS.search(text))
    hits = [h for i, d in enumerate(DETECTORS) if (i in anchored if d.anchors else numbers) for h in d.hits(i, text)]
    shown = lambda a, b: text[max(0, a) : max(0, b)].translate(_SHOWN)
    return [_finding(h, shown(h[2] - RADIUS, h[2]) + REDACTED + shown(h[2] + h[3], h[2] + h[3] + RADIUS)) for h in kept(hits)]


# -- what addresses a model, or hides -----------------------------------------------------------------------------

_SUSPECT = re.compile(r"[^\x20-\x7e\t\n\r]")


def _hidden(text: str) -> Iterator[Hit]:
    for m in _SUSPECT.finditer(text):
        kind = {"Cc": "control_character", "Cf": "invisible_unicode"}.get(unicodedata.category(m[0]))
        if kind and m[0] != "\u00ad" and (m[0], m.start()) != ("\ufeff", 0):
            yield kind, 0, m.start(), 1, CODE_POINT.format(ord(m[0]), unicodedata.name(m[0], "")).rstrip()


def risks_of(text: str | None) -> list[dict]:
    """Control and invisible characters, and phrases of PHRASES, whose places count in the case-folded text."""
    if not text:
        return []
    places, _ = scanned(text.casefold())
    phrases = [("injection_marker", 1 + i, at, len(PHRASES[i]), PHRASES[i]) for i, found in places.items() for at in found]
    return [_finding(h, text[max(0, h[2] - RADIUS) : h[2] + h[3] + RADIUS].translate(_SHOWN)) for h in kept([*_hidden(text), *phrases])]


def _counts(text: str | None) -> list[int] | None:
    if text is None:
        return None
    places, _ = scanned(text.lower())
    return [len(places.get(i, ())) for i in range(len(PHRASES))]


# -- markings -----------------------------------------------------------------------------------------------------

# A banner word with its tail, or an opening bracket before a word that counts in portions only; what stands in the brackets is scanned on, as banner words count there too.
_MARK = re.compile(rf"(?<![A-Za-z])(?P<banner>{'|'.join(BANNERS)}){TAIL}(?![A-Za-z])|\((?=(?P<portion>{'|'.join(PORTION_ONLY)}) *{TAIL}(?P<end>\)))")
_MEANT = {**ALIASES, **dict.fromkeys(NOISE, "")}


def _caveats(tail: str) -> list[str]:
    """The tail's tokens under their usual names, without noise, each once."""
    seen = dict.fromkeys(_MEANT.get(token, token) for token in re.findall(r"[^\s/,]+", tail))
    seen.pop("", None)
    return [*seen]


def markings_of(text: str | None) -> list[dict]:
    """Banner marks and portion marks in one scan, by place."""
    out = []
    for m in _MARK.finditer(text or ""):
        word, tail, end = (m["banner"], m[2], m.end()) if m["banner"] else (m["portion"], m[4], m.end("end"))
        out.append({"offset": m.start(), "classification": CANONICAL[word], "caveats": _caveats(tail), "matched": text[m.start() : end].strip()})
    return out


# -- as columns ---------------------------------------------------------------------------------------------------


def _arrow(function, schema: str, text: Column) -> Column:
    def over(texts: pd.Series) -> pd.Series:
        return texts.map(function, na_action=None)

    return F.pandas_udf(over, schema)(text)


def pii_findings(text: Column) -> Column:
    return _arrow(pii_of, FINDINGS, text)


def content_findings(text: Column) -> Column:
    return _arrow(risks_of, FINDINGS, text)


def marking_findings(text: Column) -> Column:
    return _arrow(markings_of, MARKINGS, text)


def phrase_counts(text: Column) -> Column:
    """How many non-overlapping times each phrase stands in the text, in lower case; an array in their order."""
    return _arrow(_counts, "array<int>", text)
