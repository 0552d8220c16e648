"""Byte-level BPE with a segment tree over the ranks of adjacent pairs.

A pre-token's pairs are the leaves; each node holds the least (rank, place) below it, so the root is the leftmost lowest-rank merge.
A merge changes three leaves, each a logarithmic update, until the root holds no pair. A pre-token of any length costs n log n.
Pre-tokens of one batch that are not known yet grow their trees together, a row of one array each, in rounds of
one merge a tree; those of over WIDE pairs grow one by one. Either way the root of a tree picks every merge.

The vocabulary file is a parameter, read on the driver; every worker gets it with the task and keeps encoded pre-tokens in two generations of KEPT at most, so that the
frequent ones stay.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_parts, quoted, slices

KEPT = 1 << 18
NEVER = 1 << 62
PLACE = (1 << 32) - 1
WIDE = 64
TOGETHER = 1 << 13
PIECES = 1 << 18
# fixed value: the pre-token pattern that vocabulary files mean by "ByteLevel" with "use_regex"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, to that byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _checked(parsed: dict) -> dict:
    """The definition, if it asks for what this module does; another one would give other ids without a word."""
    before, model = parsed.get("pre_tokenizer") or {}, parsed["model"]
    wanted = {"type": "ByteLevel", "add_prefix_space": False}
    odd = [k for k, v in wanted.items() if before.get(k) != v] + [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "fuse_unk") if model.get(k)]
    odd += ["use_regex"] * (not before.get("use_regex", True)) + ["normalizer"] * bool(parsed.get("normalizer")) + ["model"] * (model.get("type", "BPE") != "BPE")
    odd += [k for t in parsed["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized") if t.get(k)]
    if odd:
        raise ValueError(f"not a plain byte-level BPE vocabulary: {', '.join(odd)}")
    return parsed


class Vocabulary:
    def __init__(self, definition: str):
        """definition: the text of a tokenizer file with a byte-level BPE model, without normalizer and prefix space; others are refused."""
        parsed = _checked(json.loads(definition))
        ids, alphabet = parsed["model"]["vocab"], byte_alphabet()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in parsed["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.of_byte = np.zeros(256, np.int64)
        for character, byte in alphabet.items():
            self.of_byte[byte] = ids[character]
        self.ranks = {(ids[a] << 32) | ids[b]: rank for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.pairs = np.array(sorted(self.ranks), np.int64)
        self.rank_of = np.array([self.ranks[k] for k in self.pairs.tolist()], np.int64)
        self.bytes_of = {i: bytes(alphabet[c] for c in token) for token, i in ids.items()}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.split = regex.compile(PATTERN)
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda text: [text]
        #: ids, as bytes of int32, of pre-tokens, and of special tokens by their number
        self.known: dict[str | int, bytes] = {}
        self.older: dict[str | int, bytes] = {}

    # -- merging ------------------------------------------------------------------------------------------------

    def _leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """(rank, place) of pairs as numbers; NEVER where there is no such merge."""
        want = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)
        return np.where(self.pairs[at] == want, (self.rank_of[at] << 32) | place, NEVER)

    def _merge_together(self, tokens: list[bytes], size: int) -> list[bytes]:
        """Merges tokens of 2 to size + 1 bytes; size: a power of two, the number of a tree's leaves."""
        count, lengths = len(tokens), np.fromiter(map(len, tokens), np.int64, len(tokens))
        wide = size + 2  # the last place of a row stands for "none"
        filled = np.arange(wide) < lengths[:, None]
        symbols = np.full((count, wide), -1, np.int64)
        symbols[filled] = self.of_byte[np.frombuffer(b"".join(tokens), np.uint8)]
        after, before = (np.tile(np.arange(wide) + d, (count, 1)) for d in (1, -1))
        after[np.arange(count), lengths - 1] = wide - 1
        before[:, 0] = wide - 1
        paired = np.flatnonzero(filled[:, 1 : size + 1])
        row, place = paired // size, paired % size
        tree = np.full((count, 2 * size), NEVER, np.int64)
        tree[row, size + place] = self._leaves(symbols[row, place], symbols[row, place + 1], place)
        for level in range(size.bit_length() - 2, -1, -1):
            low, high = 1 << level, 2 << level
            tree[:, low:high] = np.minimum(tree[:, 2 * low : 2 * high : 2], tree[:, 2 * low + 1 : 2 * high : 2])
        symbols, after, before, tree = (x.reshape(-1) for x in (symbols, after, before, tree))
        rows = np.arange(count)
        while True:
            rows = rows[tree[rows * 2 * size + 1] != NEVER]
            if not len(rows):
                break
            base, root = rows * wide, rows * 2 * size
            best = tree[root + 1]
            i = best & PLACE
            new, j = self.made[best >> 32], after[base + i]
            k, h = after[base + j], before[base + i]
            symbols[base + i], symbols[base + j] = new, -1
            after[base + i], before[base + k] = k, i
            for at, found in (
                (j, np.full(len(rows), NEVER)),
                (i, np.where(k < wide - 1, self._leaves(new, symbols[base + k], i), NEVER)),
                (h, np.where(h < wide - 1, self._leaves(symbols[base + h], new, h), NEVER)),
            ):
                node = np.where(at < size, size + at, 0)  # 0 is no node of the tree: the last symbol has no leaf
                tree[root + node] = found
                for _ in range(size.bit_length() - 1):
                    node >>= 1
                    tree[root + node] = np.minimum(tree[root + 2 * node], tree[root + 2 * node + 1])
        left = symbols.reshape(count, wide)
        edges = np.r_[0, np.cumsum((left >= 0).sum(axis=1))].tolist()
        ids = left[left >= 0].astype("<i4").tobytes()
        return [ids[4 * a : 4 * b] for a, b in zip(edges, edges[1:], strict=False)]

    def _merge_one(self, token: bytes) -> bytes:
        """Merges one token, whose tree has a leaf for each of its pairs."""
        symbols, ranks, n = self.of_byte[np.frombuffer(token, np.uint8)].tolist(), self.ranks, len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        size = 1 << max(0, n - 2).bit_length()
        tree = [NEVER] * (2 * size)

        def key(i: int) -> int:
            j = after[i]
            found = ranks.get((symbols[i] << 32) | symbols[j]) if j < n else None
            return NEVER if found is None else (found << 32) | i

        for i in range(n - 1):
            tree[size + i] = key(i)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int) -> None:
            value, at = key(i), size + i
            while at and tree[at] != value:
                tree[at] = value
                at >>= 1
                value = min(tree[2 * at], tree[2 * at + 1])

        while tree[1] != NEVER:
            i, j = tree[1] & PLACE, after[tree[1] & PLACE]
            symbols[i], symbols[j] = int(self.made[tree[1] >> 32]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            after[j] = n  # the place is gone: it has no pair any more
            if j < n - 1:
                put(j)
            put(i)
            if before[i] >= 0:
                put(before[i])
        return np.array([s for s in symbols if s >= 0], "<i4").tobytes()

    def merge(self, tokens: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as bytes of int32."""
        out: list[bytes] = [b""] * len(tokens)
        by_size: dict[int, list[int]] = {}
        for i, token in enumerate(tokens):
            by_size.setdefault(1 << max(0, len(token) - 2).bit_length() if len(token) > 1 else 0, []).append(i)
        for size, at in by_size.items():
            for begin in range(0, len(at), TOGETHER):
                some = at[begin : begin + TOGETHER]
                group = [tokens[i] for i in some]
                if size == 0:
                    merged = [self.of_byte[list(t)].astype("<i4").tobytes() for t in group]
                else:
                    merged = self._merge_together(group, size) if size <= WIDE else map(self._merge_one, group)
                for i, ids in zip(some, merged, strict=True):
                    out[i] = ids
        return out

    # -- encoding -----------------------------------------------------------------------------------------------

    def pieces(self, text: str) -> Iterator[str | int]:
        """Pre-tokens, and the numbers of special tokens."""
        for part in self.parts(text):
            if part in self.special:
                yield self.special[part]
            elif len(part) > PIECES:
                yield from (m[0] for m in self.split.finditer(part))
            else:
                yield from self.split.findall(part)

    def _learn(self, pieces: Iterable[str | int]) -> None:
        """Gives `known` all the pieces."""
        if len(self.known) > KEPT:
            self.known, self.older = {}, self.known
        new = []
        for piece in set(pieces).difference(self.known):
            found = self.older.get(piece)
            if found is not None:
                self.known[piece] = found
            elif isinstance(piece, int):
                self.known[piece] = np.array([piece], "<i4").tobytes()
            else:
                new.append(piece)
        self.known.update(zip(new, self.merge([x.encode("utf-8", "surrogatepass") for x in new]), strict=True))

    def _ids(self, pieces: list[str | int]) -> bytes:
        return b"".join(map(self.known.__getitem__, pieces))

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text of any length, some of its pieces at a time."""
        source, out = self.pieces(text), []
        while some := list(islice(source, PIECES)):
            self._learn(some)
            out.append(self._ids(some))
        return np.frombuffer(b"".join(out), "<i4")

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; a null or empty one has none."""
        out = []
        for some in slices([len(t or "") for t in texts], PIECES):
            if len(some) == 1:
                out.append(self.encode(texts[some[0]] or ""))
                continue
            pieces = [list(self.pieces(texts[i] or "")) for i in some]
            self._learn(chain.from_iterable(pieces))
            out += [np.frombuffer(self._ids(x), "<i4") for x in pieces]
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; unknown ids give nothing, and bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.get, ids, repeat(b""))).decode("utf-8", "replace")


_loaded: dict[str, Vocabulary] = {}


def vocabulary(definition: str) -> Vocabulary:
    if definition not in _loaded:
        _loaded.clear()
        _loaded[definition] = Vocabulary(definition)
    return _loaded[definition]


def _definition(docs: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: of fixed size


def _mapped(docs: DataFrame, path: str, column: str, made: dict[str, str], function) -> DataFrame:
    """docs with the columns `made` (name: type), which function(vocabulary, values of the column) gives as Arrow arrays; they replace columns of those names."""
    definition = _definition(docs, path)
    kept = [c for c in docs.columns if c not in made or c == column]
    docs = docs.select(*map(quoted, kept))
    place = kept.index(column)

    def run(batches):
        known = vocabulary(definition.value)
        for part in in_parts(batches, kept[place]):
            yield pa.RecordBatch.from_arrays([*part.columns, *function(known, part.column(place).to_pylist())], [*kept, *made])

    return docs.mapInArrow(run, docs.select("*", *(F.lit(None).cast(kind).alias(c) for c, kind in made.items())).schema)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    edges = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))


def encode(docs: DataFrame, path: str, column: str = "text", out: str = "ids") -> DataFrame:
    """docs with an array of token ids of the column's whole text; a null or empty text has none."""
    return _mapped(docs, path, column, {out: "array<int>"}, lambda known, texts: [_lists(known.encode_all(texts))])


def decode(encoded: DataFrame, path: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """encoded with the text of the column's ids; null ids give an empty text."""
    return _mapped(encoded, path, column, {out: "string"}, lambda known, lists: [pa.array([known.decode(x) if x else "" for x in lists], pa.string())])


def encode_and_decode(docs: DataFrame, path: str, column: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with both, in one pass of one worker: the text that the ids decode to beside them."""

    def both(known: Vocabulary, texts: list[str | None]) -> list[pa.Array]:
        made = known.encode_all(texts)
        return [_lists(made), pa.array([known.decode(x.tolist()) for x in made], pa.string())]

    return _mapped(docs, path, column, {ids: "array<int>", decoded: "string"}, both)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the comma-joined ids and of the decoded text, for each row's whole text."""
    both = encode_and_decode(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select(
        F.col("doc_id").cast("long"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
