"""Evidence against a plain version: every phrase and detector by itself, each occurrence looked for from the last."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from corvane.functions import evidence as E
from corvane.functions import text as T

PIECES = [
    *T.PHRASES, "You are now an", "IGNORE PREVIOUS INSTRUCTIONS", "123-45-6789", "4111 1111 1111 1111", "4111-1111-1111-1112", "021000021", "021000022", "AKIA" + "B2" * 8, "ghp_" + "a1" * 20, "xoxb-0123456789ab",
    "api_key = abcdefghij0123456789xx", "CLIENT-ſECRET: 'abcdefghij0123456789yy'", "toKen", "-----BEGIN RSA PRIVATE KEY-----", "​", "­", "﻿", "\x07", "ß", "İ", "\n", " ", "x", "7", "(S//NF)", "(TS  )", "(U)", "(C//SECRET)",
    "TOP SECRET//NOFORN", "CUI//SP-CTI//REL TO USA, FVEY", "(CUI//NF)", "UNCLAS", "SECRETARY", "(", ")", "//",
]


def texts(n):
    rnd = random.Random(11)
    return [rnd.choice(["", " ", "-"]).join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def capped(found):
    """found: (kind, detail, offset, context) in the order in which kinds share their cap."""
    out = []
    for f in found:
        if sum(g[0] == f[0] for g in out) < E.MOST:
            out.append(f)
    return sorted(out, key=lambda f: f[2])


def plain_pii(text):
    found, shown = [], lambda s: s.translate(E._SHOWN)
    for d in E.DETECTORS:
        for m in d.pattern.finditer(text):
            if d.test is None or d.test(m[0]):
                found.append((d.kind, d.detail, m.start(), shown(text[max(0, m.start() - 20) : m.start()]) + E.REDACTED + shown(text[m.end() : m.end() + 20])))
    return capped(found)


def plain_risks(text):
    found = []
    for i, c in enumerate(text):
        kind = {"Cc": "control_character", "Cf": "invisible_unicode"}.get(unicodedata.category(c))
        if kind and c not in "\t\n\r­" and not (c == "﻿" and i == 0):
            found.append((kind, f"U+{ord(c):04X} {unicodedata.name(c, '')}".rstrip(), i, 1))
    folded = text.casefold()
    for phrase in T.PHRASES:
        found += [("injection_marker", phrase, m.start(), len(phrase)) for m in re.finditer(re.escape(phrase), folded)]
    return [(k, d, o, text[max(0, o - 20) : o + n + 20].translate(E._SHOWN)) for k, d, o, n in capped(found)]


def rows(found):
    return [(f["kind"], f["detail"], f["offset"], f["context"]) for f in found]


def test_findings_equal_plain_loops():
    for text in texts(4000):
        assert rows(E.pii_of(text)) == plain_pii(text), text
        assert rows(E.risks_of(text)) == plain_risks(text), text
        assert E._counts(text) == [len(re.findall(re.escape(p), text.lower())) for p in T.PHRASES]
    assert E.pii_of(None) == E.pii_of("") == E.risks_of(None) == E.markings_of(None) == [] and E._counts(None) is None


def test_marks_are_those_of_both_forms():
    """Banner words wherever they stand alone, and bracketed words that count in brackets only, each by a pattern of its own."""
    banner, portion = re.compile(T.BANNER), re.compile(T.PORTION)
    for text in texts(4000):
        want = [(m.start(), T.CANONICAL[m[1]], m[0].strip()) for m in banner.finditer(text)]
        want += [(m.start(), T.CANONICAL[m[1].strip()], m[0]) for m in portion.finditer(text) if m[1].strip() in T.PORTION_ONLY]
        assert [(m["offset"], m["classification"], m["matched"]) for m in E.markings_of(text)] == sorted(want), text
    assert E.markings_of("CUI//SP-CTI//REL TO USA, FVEY, NF")[0]["caveats"] == ["SP-CTI", "USA", "FVEY", "NOFORN"]


def test_columns(spark):
    some = [(i, t) for i, t in enumerate([*texts(40), None])]
    got = spark.createDataFrame(some, "i int, t string").select("i", E.pii_findings(F.col("t")).alias("p"), E.content_findings(F.col("t")).alias("c"), E.marking_findings(F.col("t")).alias("m"), E.phrase_counts(F.col("t")).alias("n")).collect()
    for r in got:
        t = dict(some)[r.i]
        assert [x.asDict() for x in r.p] == E.pii_of(t) and [x.asDict() for x in r.c] == E.risks_of(t) and [x.asDict() for x in r.m] == E.markings_of(t) and r.n == E._counts(t)
