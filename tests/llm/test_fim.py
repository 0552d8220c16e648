"""Fill-in-middle against plain code: units by character, word, token and line, sentinels, odd rows."""

import hashlib
import random
import re

import pytest

from corvane.llm import fim

DOCS = "doc_id long, text string, form string, `a b` int"
PLAIN = {"char": r"(?s).", "word": r"[^ \t\n\v\f\r]+|[ \t\n\v\f\r]+", "token": r"[A-Za-z0-9]|[^\x00-\x7F]|[\x00-\x7F]", "line": r"[^\n]*\n|[^\n]+"}


def plain_units(text, unit):
    """The units' first code points, by a regular expression."""
    if unit == "token":
        return [m.start() for m in re.finditer(r"(?:[A-Za-z0-9]|[^\x00-\x7F])+|[\x00-\x7F]", text)]
    return [m.start() for m in re.finditer(PLAIN[unit], text)]


def texts():
    rnd = random.Random(5)
    made = ["".join(rnd.choice("ab \n\t.,é漢\U0001f600<PSM>1") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    return [*made, "", " ", "\n", "\n\n", "a", "  a", "a  ", "a<", "<P", "<<P>", "x<P>y", "<S><M>", "é" * 40, "line\nline", "line\n"]


@pytest.mark.parametrize("unit", ["char", "word", "token", "line"])
def test_places_follow_from_sparse_events(unit):
    scanner = fim.Scanner(unit)
    for text in texts():
        units, marks = scanner.scan(text)
        want = plain_units(text, unit)
        assert units.n == len(want)
        assert [units.place(r) for r in range(units.n)] == want and units.place(units.n) == len(text)
        assert marks == [(m.start(), fim.SENTINELS.index(m[0])) for m in re.finditer("<P>|<S>|<M>", text)]


def test_characters_need_no_event_but_sentinels():
    units, marks = fim.Scanner("char").scan("a b\n" * 250_000)
    assert len(units.first) == 1 and units.n == 1_000_000 and units.place(777_777) == 777_777 and not marks


@pytest.mark.parametrize("unit", ["char", "word", "token", "line"])
@pytest.mark.parametrize("sentinels", [fim.SENTINELS, ("\x01", "\x02", "\x03"), (" a", " b", " c")])
def test_outputs_are_cut_at_units_and_rebuilt(unit, sentinels):
    scanner, forms = fim.Scanner(unit, sentinels), set()
    for i, text in enumerate(texts()):
        n, form, prefix, middle, output = scanner.cut(text, f"1:{i}", 90, 20)
        forms.add(form)
        assert scanner.rebuilt(output, form) == text
        assert (form == "plain") >= (not text or any(s in text for s in sentinels))
        if form == "plain":
            assert output == text and prefix is None and middle is None
            continue
        h = [int(hashlib.sha256(f"1:{i}".encode()).hexdigest()[8 * j : 8 * j + 8], 16) for j in range(4)]
        starts = [*plain_units(text, unit), len(text)]
        assert [prefix, prefix + middle] == sorted(starts[x % (n + 1)] for x in h[:2])
        p, s, m = sentinels
        parts = text[:prefix], text[prefix : prefix + middle], text[prefix + middle :]
        assert h[2] % 100 < 90 and (form == "spm") == (h[3] % 100 < 20)
        assert output == (s + parts[2] + p + parts[0] + m + parts[1] if form == "spm" else p + parts[0] + s + parts[2] + m + parts[1])
    assert forms == {"plain", "psm", "spm"}


def test_sentinels_that_could_arise_where_parts_meet_are_refused():
    for bad in [("<P>", "<P>", "<M>"), ("aba", "b", "c"), ("", "b", "c"), ("a", "b")]:
        with pytest.raises(ValueError, match="sentinels"):
            fim.Scanner("char", bad)
    with pytest.raises(ValueError, match="form"):
        fim.Scanner().rebuilt("<P>a<M>b", "psm")


def test_rows(spark):
    rows = [(i, t, "theirs", i) for i, t in enumerate(texts())]
    rows += [(1, None, None, None), (None, "no id", None, 1), (None, None, None, 1), (7, "long é " * 40_000, "x", 1)] + rows[:2] * 2
    docs = spark.createDataFrame(rows, DOCS)
    out = fim.restored(fim.fill_in_middle(docs))
    assert out.columns == ["doc_id", "text", "a b", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    got = out.collect()
    assert len(got) == len(rows) and all(r.restored == (r.text or "") and r.n == len(r.text or "") for r in got)
    scanner = fim.Scanner()
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == scanner.cut(r.text or "", f"1:{'' if r.doc_id is None else r.doc_id}", 90, 20)
    assert fim.digests(docs.limit(0)).count() == 0
    by_word = fim.restored(fim.fill_in_middle(docs, "word", fim_percent=100))
    assert by_word.where("restored <> coalesce(text, '')").count() == 0
