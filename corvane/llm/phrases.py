"""Substring dedup by repeated-phrase automata.

Every window of `n` consecutive words is hashed. A shard sends each distinct window once, with the smallest
document that holds it; a bucket tells a shard which of its windows start in a smaller document elsewhere. A window that does, or that two documents of the shard
start, is confirmed.

Confirmed windows are joined to passages: one follows another if it does wherever either stands in the shard (the unbranched paths of the graph of windows), so
a passage is found whole or not at all. Each shard compiles its distinct passages, cut to pieces of at most
PIECE windows that overlap by n - 1 words, into an Aho-Corasick automaton over word numbers (of distinct 64-bit word hashes), and streams all its documents through it: the automaton locates
every occurrence. A piece carries the first document of its windows: where it ends in a document with a greater id, all its words are covered.

Nothing grows with a group of copies: a shard sends a window once however many of its documents hold it.
Between shards windows are told apart by 64 bits within one of n_shards buckets, so the width grows with the corpus.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix, pack, released, shard_count, sharded, to_bytes, unpack, windows, without_id, word_hashes_of, words_of

PIECE = 40
REQUEST = "bucket int, shard int, hashes binary, docs binary"
RESPONSE = "shard int, bucket int, earlier binary"
FIRST, SECOND = 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25
EARLIER = np.iinfo(np.int64).min


def _read(table: pa.Table, n: int):
    """Documents in the order of their ids: ids, texts, hashes of their words; and for all windows hash, bucket hash, row, start."""
    table = table.sort_by("doc_id")
    ids, texts = table["doc_id"].to_numpy(), [to_bytes(t) for t in table["text"].to_pylist()]
    hashes = word_hashes_of(texts)
    lengths = np.array([max(0, len(h) - n + 1) for h in hashes], np.int64)
    row = np.repeat(np.arange(len(ids)), lengths)
    start = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    # windows over all texts one after the other, less those that run on into the next text
    begin = np.cumsum([0, *map(len, hashes)])[:-1]
    inside = begin[row] + start
    every = np.concatenate([np.empty(0, np.uint64), *hashes])
    first, second = windows(every, n, FIRST)[inside], windows(mix(every), n, SECOND)[inside]
    return ids, texts, hashes, first, second, row, start


def _distinct(first: np.ndarray, second: np.ndarray, n_buckets: int):
    """Order by (bucket, hash), heads of the distinct ones, and in that order the buckets and hashes of all."""
    bucket = (second % np.uint64(n_buckets)).astype(np.uint16 if n_buckets <= 1 << 16 else np.uint32)
    order = np.argsort(first)
    order = order[np.argsort(bucket[order], kind="stable")]
    b, h = bucket[order], first[order]
    new = np.ones(len(order), bool)
    new[1:] = (b[1:] != b[:-1]) | (h[1:] != h[:-1])
    return order, np.flatnonzero(new), b, h


def _ask(table: pa.Table, n: int, n_buckets: int) -> pa.Table:
    ids, _, _, first, second, row, _ = _read(table, n)
    order, heads, b, h = _distinct(first, second, n_buckets)
    d = ids[np.minimum.reduceat(row[order], heads)] if len(heads) else ids[:0]
    b, h = b[heads], h[heads]
    edges = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.empty(0, int)
    out = [(int(b[i]), pack(h[i:j], True), pack(d[i:j])) for i, j in zip(edges, np.r_[edges[1:], len(b)].astype(int), strict=True)]
    shard = table["shard"][0].as_py()
    return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "shard": pa.array([shard] * len(out), pa.int32()), "hashes": pa.array([x[1] for x in out], pa.binary()), "docs": pa.array([x[2] for x in out], pa.binary())})


def _answer(table: pa.Table) -> pa.Table:
    """For each shard's column of windows: one bit a window, set if another shard has it in a smaller document."""
    hashes = [unpack(x, True) for x in table["hashes"].to_pylist()]
    docs = [unpack(x).view(np.int64) for x in table["docs"].to_pylist()]
    h, d = np.concatenate(hashes), np.concatenate(docs)
    order = np.argsort(h, kind="stable")
    heads = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
    least = np.empty(len(h), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(d[order], heads), np.diff(np.r_[heads, len(h)]))
    bits, at, earlier = least < d, 0, []
    for x in hashes:
        earlier.append(np.packbits(bits[at : at + len(x)]).tobytes())
        at += len(x)
    return pa.table({"shard": table["shard"], "bucket": table["bucket"], "earlier": pa.array(earlier, pa.binary())})


def _confirmed(ids, first, second, row, answers: pa.Table, n_buckets: int):
    """For each distinct window: its first place, how often it stands, its first document's id (EARLIER if in another shard) and whether it is confirmed; and each place's window."""
    order, heads, b, _ = _distinct(first, second, n_buckets)
    elsewhere = np.zeros(len(heads), bool)
    bits = dict(zip(answers["bucket"].to_pylist(), answers["earlier"].to_pylist(), strict=True))
    edges = np.flatnonzero(np.r_[True, b[heads][1:] != b[heads][:-1], True])
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        elsewhere[i:j] = np.unpackbits(np.frombuffer(bits[int(b[heads[i]])], np.uint8), count=j - i).astype(bool)
    place, count = np.minimum.reduceat(order, heads), np.diff(np.r_[heads, len(order)])
    own = ids[row[order]]
    least, most = np.minimum.reduceat(own, heads), np.maximum.reduceat(own, heads)
    window = np.empty(len(order), np.int32)
    window[order] = np.repeat(np.arange(len(heads), dtype=np.int32), count)
    return place, count, np.where(elsewhere, EARLIER, least), elsewhere | (most > least), window


def _passages(ids, first, second, row, answers: pa.Table, n_buckets: int) -> list[tuple[int, int, int]]:
    """(first place, number of windows, first document) of each distinct passage."""
    place, count, owner, confirmed, window = _confirmed(ids, first, second, row, answers, n_buckets)
    follows = np.r_[row[1:] == row[:-1], False]  # whether a place has a next one in its document
    after = np.where(follows, np.r_[window[1:], -1], -1)
    usual = after[place]  # the window after each window's first place
    always = np.bincount(window[after == usual[window]], minlength=len(place)) == count
    to = np.maximum(usual, 0)
    joined = confirmed & (usual >= 0) & always & confirmed[to] & (count[to] == count) & (owner[to] == owner) & (to != np.arange(len(to)))
    chosen = np.flatnonzero(confirmed)
    chosen = chosen[np.argsort(place[chosen])]
    heads = np.flatnonzero(np.r_[True, ~(joined[chosen[:-1]] & (usual[chosen[:-1]] == chosen[1:]))]) if len(chosen) else chosen
    sizes = np.diff(np.r_[heads, len(chosen)])
    return list(zip(place[chosen[heads]].tolist(), sizes.tolist(), owner[chosen[heads]].tolist(), strict=True))


def _remove(docs: pa.Table, answers: pa.Table, n: int, n_buckets: int) -> pa.Table:
    ids, texts, hashes, first, second, row, start = _read(docs, n)
    numbers = np.split(np.unique(np.concatenate([np.empty(0, np.uint64), *hashes]), return_inverse=True)[1], np.cumsum([len(h) for h in hashes])[:-1])
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for place, size, owner in _passages(ids, first, second, row, answers, n_buckets) if len(row) else ():
        of, begin = numbers[row[place]], int(start[place])
        for at in range(0, size, PIECE):
            at = max(0, min(at, size - PIECE))
            key = tuple(of[begin + at : begin + min(at + PIECE, size) + n - 1].tolist())
            automaton.add_word(key, (len(key), owner))
    del first, second, row, start, hashes
    if len(automaton):
        automaton.make_automaton()
    n_words, n_removed, kept = [], [], []
    for doc_id, text, x in zip(ids.tolist(), texts, numbers, strict=True):
        covered = np.zeros(len(x) + 1, np.int64)
        for last, (size, owner) in automaton.iter(tuple(x.tolist())) if len(automaton) and len(x) >= n else ():
            if owner < doc_id:
                covered[last - size + 1] += 1
                covered[last + 1] -= 1
        words = words_of(text)
        left = list(compress(words, (np.cumsum(covered[:-1]) == 0).tolist())) if covered.any() else words
        n_words.append(len(words))
        n_removed.append(len(words) - len(left))
        kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.string())})


def remove_repeated_phrases(docs: DataFrame, n: int = 13, n_shards: int | None = None, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the text without words of windows that an earlier document also starts.

    A null text has no words; rows without an id count as one document after all others. Documents of under n words keep all. Rows with the same id belong to one
    document and never remove from each other. Other columns are left out. With digest, kept_sha256 stands
    in for kept_text, so that the words need not leave the worker.
    """
    n_shards = n_shards or shard_count(docs)
    own = sharded(docs, n_shards, "doc_id", "text")
    asked = own.groupBy("shard").applyInArrow(released(lambda t: _ask(t, n, n_shards)), REQUEST)
    # a task for each bucket: the session's partitions would give fewer and larger ones
    answers = asked.repartition(n_shards, "bucket").groupBy("bucket").applyInArrow(released(_answer), RESPONSE)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = _remove(left, right, n, n_shards)
        if not digest:
            return out
        hashed = [hashlib.sha256(to_bytes(t)).hexdigest() for t in out["kept_text"].to_pylist()]
        return out.drop_columns("kept_text").append_column("kept_sha256", pa.array(hashed, pa.string()))

    schema = f"doc_id long, n_words long, n_removed long, {'kept_sha256' if digest else 'kept_text'} string"
    return without_id(own.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(released(finish), schema))
