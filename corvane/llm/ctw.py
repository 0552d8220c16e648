"""Language-model scores by context-tree weighting over bytes.

A lower-cased text is coded byte by byte, closed by 0xFF (which UTF-8 never has). The context of a byte is the DEPTH bytes
before it, spaces included; before the text stand spaces. A byte is eight binary decisions, each with its own context tree.

Training counts, per context of each depth, the two outcomes of each decision. Nodes with under LEAST occurrences, whatever the size of the
corpus, go to a "rest" child of their parent. On the kept tree the weights are exact: P_w = (P_kt + product of the children's P_w) / 2.

The model stays distributed. A shard sends its distinct keys (the DEPTH bytes before a byte, and that byte) with their training counts to buckets,
dealt by the last TOP bytes of the context, so that all below such a context is in one bucket. From each bucket the nodes with TOP bytes go to the driver, which weighs the
trees above them (their number is bounded by the values of TOP bytes, not by the corpus); with those, each bucket answers the keys that were asked for.

The base score needs each token's count in the training texts of the whole corpus: shards send counts of distinct words to
buckets and get the corpus's back, on the same way.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHARD_BYTES, distinct, mix, pack, release, released, sharded, shards_for, staged, to_bytes, unpack, without_id, word_hashes_of

DEPTH, TOP = 7, 3
WIDTH = 7  # bytes of context that fit a key
LEAST = 2
PART = 1 << 20
END = b"\xff"
UNITS = float(1 << 20)
END_TOKEN = np.uint64(0x0A0A0A0A0A0A0A0A)  # stands for the end among the hashes of words
WORDS, CONTEXTS = 0, 1


# -- contexts ---------------------------------------------------------------------------------------------------


def _low(d: int) -> np.uint64:
    """A mask of the d lowest bytes."""
    return np.uint64((1 << 8 * d) - 1)


def _keys(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each closed text: itself and the depth bytes before it as a number, turned; and its text's number.

    Turned: the latest byte of the context highest and the coded byte lowest, as shards and buckets sort and send keys: those of one bucket lie close.
    """
    data = b"".join(b" " * WIDTH + t + END for t in texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    number = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    at = np.ndarray(len(data) - WIDTH, "<u8", data, strides=(1,))  # eight bytes from each place on, the last one highest
    inside = np.ones(len(at), bool)
    ends = (np.cumsum(lengths + WIDTH) - WIDTH)[:-1]
    inside[(ends[:, None] + np.arange(WIDTH)).ravel()] = False
    keys = at[inside]
    keys = (keys << np.uint64(8)) | (keys >> np.uint64(56))
    if depth < WIDTH:
        keys &= ~((np.uint64(1) << np.uint64(8 * (8 - depth))) - np.uint64(1)) | np.uint64(255)
    return keys, number


def _plain(turned: np.ndarray) -> np.ndarray:
    """Keys with the latest byte of the context next to the coded byte, the lowest."""
    return ((turned >> np.uint64(8)) | (turned << np.uint64(56))).byteswap()


def _parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts in turn, in parts of about PART bytes."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text) + 1
        if size > PART:
            yield part
            part, size = [], 0
    if part:
        yield part


def _summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    if not len(keys):
        return keys, *counts
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    heads = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[heads], *(np.add.reduceat(c[order], heads) for c in counts)


def _merged(keys: Iterable[np.ndarray], counts: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of ascending columns, a few at a time."""
    k, c, held = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    for x, y in zip(keys, counts, strict=True):
        k.append(x)
        c.append(y)
        held += len(x)
        if held > max(PART, len(k[0]) // 2):
            x, y = _summed(np.concatenate(k), np.concatenate(c))
            k, c, held = [x], [y], 0
    return _summed(np.concatenate(k), np.concatenate(c))


# -- training ---------------------------------------------------------------------------------------------------


def _tally(texts: list[bytes], held_out: list[bool], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of all texts, turned, with their counts in those that are not held out."""
    keys, counts = [], []
    for held in (False, True):
        for part in _parts([t for t, h in zip(texts, held_out, strict=True) if h == held]):
            k, c = np.unique(_keys(part, depth)[0], return_counts=True)
            keys.append(k)
            counts.append(c * (not held))
    return _merged(keys, counts)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


_HALVES, _WHOLES = (_log_gamma(np.arange(1 << 14) + x) for x in (0.5, 1.0))


def _log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov estimate of counts; nearly all are in the tables."""
    a, b = n0.astype(np.int64), n1.astype(np.int64)
    small = a + b < len(_WHOLES)
    x, y = np.where(small, a, 0), np.where(small, b, 0)
    out = _HALVES[x] + _HALVES[y] - _WHOLES[x + y]
    if not small.all():
        x, y = a[~small].astype(float), b[~small].astype(float)
        out[~small] = _log_gamma(x + 0.5) + _log_gamma(y + 0.5) - _log_gamma(x + y + 1)
    return out - math.log(math.pi)


def _above(node: np.ndarray, d: int) -> np.ndarray:
    """The node with d bytes of context that each node is below."""
    return (node & _low(d + 1) & ~np.uint64(255)) | (node & np.uint64(255))


def _mixed(kt: np.ndarray, a: np.ndarray, b: np.ndarray, kids: tuple[np.ndarray, ...] | None):
    """log P_w of nodes with counts a and b, the weight of their own estimate, and the estimate of a 1 in what no child holds.

    kids: of the children that are kept, the place of the node above, both counts and log P_w.
    """
    if kids is None or not len(kids[0]):
        return kt, np.ones(len(a)), np.full(len(a), 0.5)
    to, ca, cb, cw = kids
    has = np.bincount(to, minlength=len(a)) > 0
    ra, rb = a - np.bincount(to, ca, len(a)), b - np.bincount(to, cb, len(a))
    own, split = kt + math.log(0.5), np.bincount(to, cw, len(a)) + _log_kt(ra, rb) + math.log(0.5)
    both = np.where(has, np.logaddexp(own, split), kt)
    return both, np.where(has, np.exp(own - both), 1.0), np.where(has, (rb + 0.5) / (ra + rb + 1), 0.5)


def _depths(keys: np.ndarray, counts: np.ndarray, depth: int, top: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """For each depth from top to depth: sorted distinct keys, their counts, and the place of each among those of one depth less."""
    keys, counts = _summed(keys, counts)
    out = []
    for d in range(depth, top, -1):
        cut = keys & _low(d)
        order = np.argsort(cut, kind="stable")
        cut = cut[order]
        new = np.r_[True, cut[1:] != cut[:-1]] if len(cut) else np.empty(0, bool)
        up = np.empty(len(keys), np.int32)
        up[order] = np.cumsum(new) - 1
        out.append((keys, counts, up))
        heads = np.flatnonzero(new)
        keys, counts = cut[heads], np.add.reduceat(counts[order], heads) if len(heads) else counts
    return [(keys, counts, None), *out[::-1]]


class Trees:
    """The context trees of one decision, from depth top on, over the keys of a bucket: a node is a run of sorted keys."""

    def __init__(self, depths, bit: int, top: int):
        self.bit, self.top, self.levels = bit, top, []
        kids = None
        for keys, counts, up in depths[::-1]:
            at = keys >> np.uint64(8 - bit)
            new = np.r_[True, at[1:] != at[:-1]]
            heads, run = np.flatnonzero(new), (np.cumsum(new) - 1).astype(np.int32)
            one = (keys >> np.uint64(7 - bit)) & np.uint64(1) == 1
            a, b = (np.add.reduceat(np.where(x, counts, 0), heads) for x in (~one, one))
            keep = a + b >= LEAST
            if kids is not None:
                kids = (run[kids[0]], *kids[1:])
            kt = _log_kt(a, b)
            whole, weight, rest = _mixed(kt, a, b, kids)
            self.levels.append((heads, run, keep, (b + 0.5) / (a + b + 1.0), weight, rest, up))
            self.counts, self.whole = (a, b), whole
            if up is not None:
                kids = (up[heads[keep]], a[keep], b[keep], whole[keep])
        self.levels.reverse()
        self.keys = depths[0][0]

    def nodes(self) -> tuple[np.ndarray, ...]:
        """Of depth top: node, both counts, log P_w; all nodes, the kept ones count only."""
        k = self.keys[self.levels[0][0]]
        node = (k & ~np.uint64(255)) | (np.uint64(1) << np.uint64(self.bit)) | ((k & np.uint64(255)) >> np.uint64(8 - self.bit))
        return node, *self.counts, self.whole

    def ones(self, above) -> np.ndarray:
        """For each key of the full depth, the probability of a 1 mixed over all depths."""
        node = self.nodes()[0]
        p, left, value = np.zeros(len(node)), np.ones(len(node)), np.full(len(node), 0.5)
        on = np.arange(len(node))
        for d, (keys, kt, weight, rest) in enumerate(above):
            if not len(on) or not len(keys):
                break
            want = _above(node[on], d)
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            on, at = on[keys[at] == want], at[keys[at] == want]
            p[on] += left[on] * weight[at] * kt[at]
            left[on] *= 1.0 - weight[at]
            value[on] = p[on] + left[on] * rest[at]
        back = None
        for heads, run, keep, kt, weight, rest, up in self.levels:
            if up is not None:
                to = back[up[heads]]
                p, left, value = p[to], left[to], value[to]
            p = p + left * weight * kt
            left = left * (1.0 - weight)
            value = np.where(keep, p + left * rest, value)
            back = run
        return value[back]


def _weigh_top(node: np.ndarray, n0: np.ndarray, n1: np.ndarray, whole: np.ndarray, top: int) -> list[tuple[np.ndarray, ...]]:
    """The model above all buckets' nodes of depth top: for each depth the kept nodes, their KT estimate of a 1, their weight, and the rest's estimate."""
    model, below = [], (node, n0, n1, whole)
    for d in range(top - 1, -1, -1):
        node, n0, n1 = _summed(_above(node, d), n0, n1)
        keep = below[1] + below[2] >= LEAST
        kids = np.searchsorted(node, _above(below[0][keep], d)), *(x[keep] for x in below[1:])
        whole, weight, rest = _mixed(_log_kt(n0, n1), n0, n1, kids)
        keep, below = n0 + n1 >= LEAST, (node, n0, n1, whole)
        model.append((node[keep], *(x[keep].astype(np.float32) for x in ((n1 + 0.5) / (n0 + n1 + 1.0), weight, rest))))
    return model[::-1]


def _top_nodes(keys: np.ndarray, counts: np.ndarray, depth: int, top: int) -> tuple[np.ndarray, ...]:
    """The nodes of depth top of a bucket that training texts hold, sorted: node, both counts, log P_w."""
    if not len(keys):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    depths = _depths(keys, counts, depth, top)
    node, n0, n1, whole = map(np.concatenate, zip(*(Trees(depths, bit, top).nodes() for bit in range(8)), strict=True))
    order = np.argsort(node)
    return node[order], n0[order], n1[order], whole[order]


# -- scoring ----------------------------------------------------------------------------------------------------


def _log10_of_keys(above, keys: np.ndarray, counts: np.ndarray, depth: int, top: int) -> np.ndarray:
    """For the sorted distinct keys of a bucket, with their training counts, log10 of the probability of the byte."""
    total = np.zeros(len(keys))
    depths = _depths(keys, counts, depth, top) if len(keys) else []
    for bit in range(8 if len(keys) else 0):
        p = Trees(depths, bit, top).ones(above)
        total += np.log10(np.where((keys >> np.uint64(7 - bit)) & np.uint64(1) == 1, p, 1.0 - p))
    return total


def _short(logs: np.ndarray) -> np.ndarray:
    """Logarithms as whole numbers of a millionth or so: most fit three bytes, a few of which hardly vary."""
    return np.rint(logs * -UNITS).astype(np.int64)


def _long(short: np.ndarray) -> np.ndarray:
    return short.astype(np.float64) / -UNITS


def _texts(table: pa.Table) -> Iterator[bytes]:
    for batch in table.to_batches(256):
        for text in batch.column("text").to_pylist():
            yield to_bytes(text).lower()


def _dealt(h: np.ndarray, n_buckets: int) -> np.ndarray:
    return (mix(h) % np.uint64(n_buckets)).astype(np.uint16 if n_buckets <= 1 << 16 else np.int64)  # numpy sorts the former in one pass


def _word_places(hashes: np.ndarray, n_buckets: int):
    """Of ascending hashes; a bucket's stay ascending."""
    bucket = _dealt(hashes, n_buckets)
    return np.argsort(bucket, kind="stable"), bucket


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint64), *parts])


def _context_places(keys: np.ndarray, n_buckets: int, top: int):
    """Of turned keys; a bucket's keep their order."""
    bucket = _dealt(keys >> np.uint64(64 - 8 * top) if top else np.zeros_like(keys), n_buckets)
    return np.argsort(bucket, kind="stable"), bucket


def _ask(table: pa.Table, n_buckets: int, depth: int) -> pa.Table:
    """Of a shard, for each bucket: distinct words, and distinct keys, ascending, with their training counts."""
    texts, held = list(_texts(table)), table["held_out"].to_pylist()
    learned, other = (_joined(word_hashes_of([t for t, h in zip(texts, held, strict=True) if h == which])) for which in (False, True))
    h, c = _summed(np.r_[learned, other, END_TOKEN], np.r_[np.ones(len(learned), np.int64), np.zeros(len(other), np.int64), np.int64(held.count(False))])
    order, bucket = _word_places(h, n_buckets)
    asked = [(WORDS, h[order], c[order], bucket[order])]
    del learned, other
    k, c = _tally(texts, held, depth)
    order, bucket = _context_places(k, n_buckets, min(TOP, depth))
    asked.append((CONTEXTS, k[order], c[order], bucket[order]))
    rows = []
    for what, h, c, bucket in asked:
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
        rows += [(what, int(bucket[i]), pack(h[i:j], True), pack(c[i:j])) for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    what, bucket, hashes, counts = zip(*rows, strict=True)
    return pa.table({"what": pa.array(what, pa.int32()), "bucket": pa.array(bucket, pa.int32()), "shard": pa.array([table["shard"][0].as_py()] * len(rows), pa.int32()), "hashes": pa.array(hashes, pa.binary()), "counts": pa.array(counts, pa.binary())})


BUCKET = "what int, bucket int, shards array<int>, hashes array<binary>, counts array<binary>, tokens long, vocabulary long, node binary, n0 binary, n1 binary, whole binary"


def _sums(hashes: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return _merged((unpack(x, True) for x in hashes), (unpack(x).astype(np.int64) for x in counts))


def _gather(table: pa.Table, depth: int) -> pa.Table:
    """All that was asked of a bucket as one row, with what the driver needs of it: token counts, or nodes."""
    hashes, counts = table["hashes"].to_pylist(), table["counts"].to_pylist()
    what, (k, c) = table["what"][0].as_py(), _sums(hashes, counts)
    tokens, nodes = (int(c.sum()), int((c > 0).sum())) if what == WORDS else (0, 0), [None] * 4
    if what == CONTEXTS:
        trained = c > 0
        node, n0, n1, whole = _top_nodes(_plain(k[trained]), c[trained], depth, min(TOP, depth))
        nodes = [pack(node, True), pack(n0), pack(n1), whole.tobytes()]
    row = [what, table["bucket"][0].as_py(), table["shard"].to_pylist(), hashes, counts, *tokens, *nodes]
    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.int64(), pa.int64(), *[pa.binary()] * 4]
    return pa.table([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=[c.split()[0] for c in BUCKET.split(", ")])


def _answer(depth: int, above):
    """For each shard that asked: the corpus's counts of its words, log10 of the probabilities of its keys."""

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                what, bucket, shards, hashes, counts = (batch.column(name)[i].as_py() for name in ("what", "bucket", "shards", "hashes", "counts"))
                k, c = _sums(hashes, counts)
                if what == CONTEXTS:
                    plain = _plain(k)
                    order = np.argsort(plain, kind="stable")
                    c[order] = _short(_log10_of_keys(above.value, plain[order], c[order], depth, min(TOP, depth)))
                for shard, x in zip(shards, hashes, strict=True):
                    yield pa.RecordBatch.from_pydict({"what": pa.array([what], pa.int32()), "bucket": pa.array([bucket], pa.int32()), "shard": pa.array([shard], pa.int32()), "found": pa.array([pack(c[np.searchsorted(k, unpack(x, True))])], pa.binary())})
                release()

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"


def score_documents(docs: DataFrame, depth: int = DEPTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Each document's unigram base score and context-tree score, both log10, learned from the rows that are not held out.

    Held out: crc32 of the id as text is 1 modulo 5 (of "" for a null id). A null text is empty: one end token
    and one closing byte. Words unseen in training have a count of 0; with no training row at all every
    decision has probability 1/2. Repeated rows count as often as they stand; other columns are left out.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    if not 0 <= depth <= WIDTH:
        raise ValueError(f"depth is {depth}; a key holds {WIDTH} bytes of context")
    docs = docs.select("doc_id", "text", (F.crc32(key.cast("binary")) % 5 == 1).alias("held_out"))
    n_shards = shards_for(docs.sparkSession, docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0, shard_bytes)
    top = min(TOP, depth)

    own = sharded(docs, n_shards, "text", "held_out")
    asked = own.groupBy("shard").applyInArrow(released(lambda t: _ask(t, n_shards, depth)), "what int, bucket int, shard int, hashes binary, counts binary")
    buckets = staged(asked.repartition(n_shards, "what", "bucket").groupBy("what", "bucket").applyInArrow(released(lambda t: _gather(t, depth)), BUCKET))
    n, v = (x or 0 for x in buckets.agg(F.sum("tokens"), F.sum("vocabulary")).first())
    # the nodes with `top` bytes of context: as many as there are values of those bytes, whatever the corpus
    rows = buckets.where(F.col("what") == CONTEXTS).select("node", "n0", "n1", "whole").collect()
    nodes = [unpack(r["node"], True) for r in rows], [unpack(r["n0"]).astype(np.int64) for r in rows], [unpack(r["n1"]).astype(np.int64) for r in rows], [np.frombuffer(r["whole"]) for r in rows]
    above = docs.sparkSession.sparkContext.broadcast(_weigh_top(*(np.concatenate([np.empty(0, t), *x]) for x, t in zip(nodes, (np.uint64, np.int64, np.int64, float), strict=True)), top))
    answers = buckets.select("what", "bucket", "shards", "hashes", "counts").mapInArrow(_answer(depth, above), "what int, bucket int, shard int, found binary")
    rest = math.log10(n + 0.5 * (v + 1)) if n else 0.0

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {(a, b): x for a, b, x in zip(right["what"].to_pylist(), right["bucket"].to_pylist(), right["found"].to_pylist(), strict=True)}
        texts = list(_texts(left))
        own_words = [np.r_[h, END_TOKEN] for h in word_hashes_of(texts)]
        n_tokens = np.array([len(x) for x in own_words], np.int64)
        of = np.repeat(np.arange(len(texts)), n_tokens)
        words, back = np.unique(_joined(own_words), return_inverse=True)
        order, bucket = _word_places(words, n_shards)
        counts = np.empty(len(words), np.int64)
        counts[order] = np.concatenate([unpack(found[WORDS, int(b)]).astype(np.int64) for b in np.unique(bucket)])
        base_score = np.bincount(of, (np.log10(counts + 0.5) - rest)[back], len(texts))
        n_known = np.bincount(of, (counts > 0)[back], len(texts)).astype(np.int64)
        del own_words, words, back, of
        coded, size = [], []
        for part in _parts(texts):
            k, number = _keys(part, depth)
            own_keys, back = np.unique(k, return_inverse=True)
            coded.append((own_keys, back.astype(np.int32), number))
            size.append(len(part))
        keys = distinct(np.concatenate([x[0] for x in coded]))
        order, bucket = _context_places(keys, n_shards, top)
        logs = np.empty(len(keys))
        logs[order] = np.concatenate([_long(unpack(found[CONTEXTS, int(b)])) for b in np.unique(bucket)])
        scores = [np.bincount(number, logs[np.searchsorted(keys, k)][back], n_texts) for (k, back, number), n_texts in zip(coded, size, strict=True)]
        return pa.table(
            {
                "doc_id": left["doc_id"],
                "held_out": left["held_out"],
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "train_tokens": pa.array([n] * len(texts), pa.int64()),
                "base_score": pa.array(base_score, pa.float64()),
                "score": pa.array(np.concatenate(scores), pa.float64()),
                "n_bytes": pa.array(list(map(len, texts)), pa.int64()),
            }
        )

    scored = own.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(released(finish), SCORES)
    return without_id(scored).withColumn("bits_per_byte", -F.col("score") / math.log10(2) / (F.col("n_bytes") + 1)).drop("n_bytes")
