"""Fill-in-middle: texts cut into prefix, middle and suffix at units drawn from a hash of the id, and rebuilt exactly.

One Aho-Corasick automaton finds the ASCII characters at which a text's class changes and the sentinels. A gap between two of these events holds as many units as
its length says (each code point one, or the whole gap one), so a unit's place follows from the sparse events by a binary search and one addition; no list of units is made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, in_parts, quoted

SENTINELS = ("<P>", "<S>", "<M>")  # of prefix, suffix and middle
SPACES = " \t\n\v\f\r"
# What a unit is, by name: the ASCII characters that change the class, and what they and the gaps between them are.
#   each: every code point is a unit
#   runs: a gap is one unit, neighbouring class-changing characters are one, too
#   alone: a gap is one unit, every class-changing character is one
#   ends: a class-changing character ends the unit that it stands in
UNITS = {
    "char": ("", "each"),
    "word": (SPACES, "runs"),
    "token": ("".join(chr(c) for c in range(128) if not chr(c).isalnum()), "alone"),
    "line": ("\n", "ends"),
}
ADDED = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


@dataclass(frozen=True)
class Units:
    """Stretches of a text: each one's first code point, the units before it, and whether each of its code points is a unit. `n` units and `end` code points in all."""

    first: np.ndarray
    before: np.ndarray
    each: bool
    n: int
    end: int

    def place(self, rank: int) -> int:
        """The code point at which unit `rank` begins; the text's end for rank n."""
        if rank >= self.n:
            return self.end
        i = int(np.searchsorted(self.before, rank, "right")) - 1
        return int(self.first[i]) + (rank - int(self.before[i]) if self.each else 0)


class Scanner:
    def __init__(self, unit: str = "char", sentinels: Sequence[str] = SENTINELS):
        """unit: a name of UNITS. Of the sentinels, the first character may stand nowhere else in any of them: none can then arise where two parts meet."""
        if len(sentinels) != 3 or len(set(sentinels)) != 3 or any(not s or any(s[0] in t[1:] for t in sentinels) for s in sentinels):
            raise ValueError("three different sentinels are needed, whose first characters stand nowhere else in them")
        breaks, self.kind = UNITS[unit]
        self.sentinels = tuple(sentinels)
        # a sentinel of one character may be class-changing as well
        events: dict[str, int] = dict.fromkeys(breaks, 0)
        for i, s in enumerate(sentinels):
            events[s] = events[s] + (2 << i) if s in events else (2 << i) + 1
        self.found = ahocorasick.Automaton()
        for text, what in events.items():
            self.found.add_word(text, what)
        self.found.make_automaton()

    def scan(self, text: str) -> tuple[Units, list[tuple[int, int]]]:
        """The text's units, and the sentinels in it: (the first code point, which) in order."""
        marks, at = [], []
        for last, what in self.found.iter(text):
            if what > 1:
                which = what.bit_length() - 2
                marks.append((last + 1 - len(self.sentinels[which]), which))
            if not what & 1:
                at.append(last)
        return self._units(np.array(at, np.int64), len(text)), marks

    def _units(self, at: np.ndarray, end: int) -> Units:
        """at: the class-changing characters in order."""
        first = np.zeros(min(end, 1), np.int64)
        if self.kind == "each":
            return Units(first, first, True, end, end)
        if self.kind == "runs":  # a run's first character, and the one after its last
            edge = np.r_[True, np.diff(at) > 1] if len(at) else np.zeros(0, bool)
            more = np.r_[at[edge], at[np.r_[edge[1:], edge[:1]]] + 1]
        else:
            more = np.r_[at, at + 1] if self.kind == "alone" else at + 1
        first = np.unique(np.r_[first, more[more < end]])
        return Units(first, np.arange(len(first)), False, len(first), end)

    def cut(self, text: str, key: str, fim_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
        """n, the form, code points of prefix and middle, and the output of one text."""
        units, marks = self.scan(text)
        digest = hashlib.sha256(key.encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
        if not text or marks or h3 % 100 >= fim_percent:
            return units.n, "plain", None, None, text
        low, high = (units.place(r) for r in sorted((h1 % (units.n + 1), h2 % (units.n + 1))))
        p, s, m = self.sentinels
        prefix, middle, suffix = text[:low], text[low:high], text[high:]
        if h4 % 100 < spm_percent:
            return units.n, "spm", low, high - low, f"{s}{suffix}{p}{prefix}{m}{middle}"
        return units.n, "psm", low, high - low, f"{p}{prefix}{s}{suffix}{m}{middle}"

    def rebuilt(self, output: str, form: str) -> str:
        """The text, from its output and form alone."""
        if form == "plain":
            return output
        _, marks = self.scan(output)
        if [which for _, which in marks] != ([0, 1, 2] if form == "psm" else [1, 0, 2]):
            raise ValueError(f"no output of form {form}")
        ends = [at for at, _ in marks[1:]] + [len(output)]
        parts = {which: output[at + len(self.sentinels[which]) : end] for (at, which), end in zip(marks, ends, strict=True)}
        return parts[0] + parts[2] + parts[1]


def _with(df: DataFrame, added: dict[str, str], reads: Sequence[str], function) -> DataFrame:
    """df with columns that function(values of the columns `reads`) gives row by row; they replace columns of those names."""
    kept = [c for c in df.columns if c not in added]
    hidden = [f"_in{i}_" + "_".join(kept) for i in range(len(reads))]  # no name of df's
    asked = bounded(df.select(*map(quoted, kept), *(F.expr(sql).alias(h) for sql, h in zip(reads, hidden, strict=True))))
    schema = df.select(*map(quoted, kept), *(F.lit(None).cast(kind).alias(c) for c, kind in added.items())).schema
    kinds = [{"long": pa.int64(), "string": pa.string()}[k] for k in added.values()]

    def run(batches):
        for part in in_parts(batches, hidden[0]):
            given = [part.column(len(kept) + i).to_pylist() for i in range(len(reads))]
            rows = [function(*row) for row in zip(*given, strict=True)]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *made], [*kept, *added])

    return asked.mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, unit: str = "char", sentinels: Sequence[str] = SENTINELS, fim_percent: int = 90, spm_percent: int = 20, seed: str = "1") -> DataFrame:
    """docs with n (units of the text), form (plain, psm or spm), prefix_chars, middle_chars (code points; null if plain) and output.

    The cuts and the form follow from SHA-256 of `seed:doc_id`, so a row gives the same output in any run and order. A null text counts as empty; an empty text and
    one that holds a sentinel stay plain. A null id counts as an empty name. Repeated rows come out alike, one for one. Columns of the new names are
    replaced, others pass through. Whole texts are cut, whatever their length; an empty table stays empty.
    """
    Scanner(unit, sentinels)  # refuses before a job runs
    made: list[Scanner] = []

    def one(text: str | None, doc_id: str | None):
        if not made:
            made.append(Scanner(unit, sentinels))
        return made[0].cut(text or "", f"{seed}:{doc_id or ''}", fim_percent, spm_percent)

    return _with(docs, ADDED, ["cast(text as string)", "cast(doc_id as string)"], one)


def restored(cut: DataFrame, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """cut with `restored`: the text, from the columns output and form alone; a null output gives an empty text. An output that does not fit its form raises ValueError."""
    made: list[Scanner] = []

    def one(output: str | None, form: str):
        if not made:
            made.append(Scanner("char", sentinels))
        return (made[0].rebuilt(output or "", form),)

    return _with(cut, {"restored": "string"}, ["cast(output as string)", "cast(form as string)"], one)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and SHA-256 of the output and of the text restored from it."""
    both = restored(fill_in_middle(docs.select("doc_id", "text")).select("doc_id", *ADDED))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return both.select(F.col("doc_id").cast("long"), "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))


ORACLE = """
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || doc_id) as h from documents),
sized as (select doc_id, t, length(t) as n, cast(('0x' || h[1:8]) as bigint) as h1, cast(('0x' || h[9:16]) as bigint) as h2,
  cast(('0x' || h[17:24]) as bigint) as h3, cast(('0x' || h[25:32]) as bigint) as h4 from d),
formed as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from sized),
parts as (select *, left(t, a) as p, substr(t, a + 1, b - a) as m, substr(t, b + 1) as s from formed)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(a as bigint) end as prefix_chars, case when form <> 'plain' then cast(b - a as bigint) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256 from parts"""
