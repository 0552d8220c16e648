"""Each operator against plain code on small inputs: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import bpe, components, ctw, html, mixing, phrases, quality, queries, secrets, setsketch, simhash, urls

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sample(n=60, seed=1, size=60):
    """Odd rows: nulls, empty, blank, one word, copies, near copies, a long text."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["the", "of", "Été", "漢字"]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, size))) for _ in range(n)]
    base = " ".join(rnd.choice(vocabulary) for _ in range(80))
    near = base.split()
    near[40] = "changed"
    texts += [None, "", " \t\n", "one", "one", "ONE", base, base, " ".join(near), "x\x0bbreak\u00a0kept " + base, " ".join(f"long{i % 900}" for i in range(9000))]
    return [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return sample()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- 1 secrets --------------------------------------------------------------------------------------------------


def plain_spans(text):
    out = []
    for k, (kind, pattern, group, least) in enumerate([("assign", secrets.ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return sorted(out)


def test_secret_spans(spark, empty):
    texts = [
        'é𝒳 token = "0641917ea4e9feb9cda83477b57ac2654884f485" x',
        "secret: token: abcdefgh",  # the short first match takes the second keyword
        "PassWord='abc' password=abcdef API_KEY:abcdef/1 apikey = x",
        "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + " AKIAAKIA" + "C" * 30,
        "a" * 23 + " " + "b" * 24 + "g" + "c" * 40,
        None,
        "",
        "password=abcdefpassword=abcdef",
        "x" * 5000 + " token:" + "0123456789abcdef" * 400,
        "key Ab3dEf6hIj9kLm2nOp5q end",
    ]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)] * 2, DOCS)
    got = secrets.scan(frame).collect()
    assert len(got) == 2 * len(texts) and secrets.scan(empty).count() == 0
    for r in got:
        want = plain_spans(texts[r.doc_id])
        joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in want)
        assert r.base_sha256 == sha(joined), texts[r.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in want) for k in range(3))
        assert set(filter(None, joined.split(","))) <= set(filter(None, r.spans.split(",")))
    assert "token:4:24" in next(r.spans for r in got if r.doc_id == 9)


def test_many_spans_of_one_text(spark):
    text = " ".join(f"é token={i:06x}z" for i in range(6000))
    frame = spark.createDataFrame([(1, text, "en", "s", 0)], DOCS)
    got = secrets.scan(frame).first()
    want = plain_spans(text)
    assert got.n_assign == 6000 and got.base_sha256 == sha(",".join(f"{kind}:{a}:{b}" for a, _, b, kind in want))


def test_owner_frequency_parts_examples_from_live_secrets(spark):
    example, live = "AKIA" + "E" * 16, "AKIA" + "L" * 16
    mixed = "Ab3dEf6hIj9kLm2nOp5q"
    made = [(i, f"use {example} and {mixed}", "en", f"s{i}", 0) for i in range(4)] + [(9, f"my {live} é", "en", "s9", 9)]
    frame = spark.createDataFrame(made, DOCS)
    got = {r.doc_id: r for r in secrets.scan(frame).collect()}
    assert (got[0].n_live, got[0].n_example, got[0].spans) == (0, 1, "access:4:24") and (got[9].n_live, got[9].n_example) == (1, 0)
    assert got[0].spread == "4/4" and got[9].spread == "1/1"
    # two owners in six repositories copy an example; one owner in six, and two in five, hold a secret
    held = [("A", "xyxyxy"), ("B", "xxxxxx"), ("C", "xyxyx")]
    made2 = [(10 * k + i, "AKIA" + letter * 16, f"lang{i}", who, 0) for k, (letter, owners) in enumerate(held) for i, who in enumerate(owners)]
    wide = {r.doc_id: (r.n_live, r.n_example, r.spread) for r in secrets.scan(spark.createDataFrame(made2, DOCS)).collect()}
    assert wide[0] == (0, 1, "2/6") and wide[10] == (1, 0, "1/6") and wide[20] == (1, 0, "2/5")
    masked = {r.doc_id: r for r in secrets.mask_live(frame).collect()}
    assert masked[9].text == f"my {secrets.MASK} é" and masked[9].n_chars == len(masked[9].text) and masked[0].text == made[0][1]
    plan = secrets.scan(frame)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- 2 language model -------------------------------------------------------------------------------------------


def test_base_scores(spark, docs, rows, empty):
    got = {r.doc_id: r for r in ctw.score_documents(docs, shard_bytes=20_000).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, *_ in rows}
    lower = {i: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t)] + ["\n"] for i, t, *_ in rows}
    counts = collections.Counter(w for i, ws in lower.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in lower.items():
        want = math.fsum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert math.isclose(got[i].base_score, want, rel_tol=1e-9) and got[i].score < 0
    assert ctw.score_documents(empty).count() == 0


class PlainTrees:
    """Context-tree weighting as it is written: one tree of contexts for each decision, weighed by recursion."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.kids = depth, collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)
        for text in texts:
            for context, byte in self.coded(text):
                for bit in range(8):
                    for d in range(depth + 1):
                        node = (bit, byte >> (8 - bit), context[len(context) - d :])
                        self.counts[node][byte >> (7 - bit) & 1] += 1
                        if d:
                            self.kids[(bit, byte >> (8 - bit), context[len(context) - d + 1 :])].add(node)
        self.known = {}

    def coded(self, text):
        data = b" " * self.depth + text.lower().encode() + b"\xff"
        return [(data[i - self.depth : i], data[i]) for i in range(self.depth, len(data))]

    @staticmethod
    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def weighed(self, node):
        """log P_w, the weight of the node's own estimate, and the counts that no kept child holds."""
        if node not in self.known:
            a, b = self.counts[node]
            kept = [k for k in self.kids[node] if sum(self.counts[k]) >= 2]
            rest = a - sum(self.counts[k][0] for k in kept), b - sum(self.counts[k][1] for k in kept)
            own, split = self.kt(a, b), sum(self.weighed(k)[0] for k in kept) + self.kt(*rest)
            top = max(own, split)
            whole = top + math.log((math.exp(own - top) + math.exp(split - top)) / 2) if kept else own
            self.known[node] = whole, math.exp(own + math.log(0.5) - whole) if kept else 1.0, rest
        return self.known[node]

    def one(self, bit, prefix, context, d=0):
        node = (bit, prefix, context[len(context) - d :])
        if sum(self.counts.get(node, (0, 0))) < 2:
            return 0.5
        (a, b), (_, weight, rest) = self.counts[node], self.weighed(node)
        below = (bit, prefix, context[len(context) - d - 1 :])
        inside = d < self.depth and sum(self.counts.get(below, (0, 0))) >= 2
        split = self.one(bit, prefix, context, d + 1) if inside else (rest[1] + 0.5) / (sum(rest) + 1)
        return weight * (b + 0.5) / (a + b + 1) + (1 - weight) * split

    def byte(self, context, byte):
        ones = [(self.one(bit, byte >> (8 - bit), context), byte >> (7 - bit) & 1) for bit in range(8)]
        return math.prod(p if x else 1 - p for p, x in ones)

    def score(self, text):
        return math.fsum(math.log10(self.byte(context, byte)) for context, byte in self.coded(text))


@pytest.mark.parametrize("depth,shard_bytes", [(0, 500), (2, 300), (5, 1 << 20), (7, 700)])
def test_scores_equal_context_trees_by_recursion(spark, depth, shard_bytes):
    """Every document's score, over one shard and over many, held out or not, with texts that end, repeat and are empty."""
    rnd = random.Random(depth)
    texts = ["".join(rnd.choice(["abra", "cad", " ", "a", "é", "The "]) for _ in range(rnd.randint(0, 25))) for _ in range(40)] + ["", "abra abra", "abra abra"]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, None, None, None, None)], DOCS)
    got = {r.doc_id: r for r in ctw.score_documents(frame, depth=depth, shard_bytes=shard_bytes).collect()}
    plain = PlainTrees([t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1] + [""], depth)
    assert any(r.held_out for r in got.values()) and math.isclose(got[None].score, plain.score(""), rel_tol=1e-5)
    for i, text in enumerate(texts):
        assert math.isclose(got[i].score, plain.score(text), rel_tol=1e-5), (i, text)


def test_probabilities_of_all_next_bytes_sum_to_one():
    """In the plain trees that the scores equal."""
    plain = PlainTrees(["abab abba abc", "abab", "b a"], 3)
    for context in (b"   ", b" ab", b"bab", b"zzz"):
        assert math.isclose(sum(plain.byte(context, x) for x in range(256)), 1.0, rel_tol=1e-9)


def test_one_huge_text(spark):
    """2 MB in one document, learned from and scored like any other."""
    frame = spark.createDataFrame([(0, "many words of one text " * 90_000, "en", "s", 0), (1, "many words", "en", "s", 0), (3, "zqx", "en", "s", 0)], DOCS)
    got = {r.doc_id: r for r in ctw.score_documents(frame).collect()}
    assert got[0].n_tokens == 450_001 and -got[0].score < 1000 and got[0].bits_per_byte < got[3].bits_per_byte


def test_depth_fits_a_key(docs):
    with pytest.raises(ValueError, match="depth"):
        ctw.score_documents(docs, depth=8)


def test_held_out_texts_beat_uniform_bytes(spark):
    total = ctw.score_documents(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out").agg(F.avg("bits_per_byte")).first()[0]
    assert total < 3.0


def test_order_of_words_counts(spark):
    """Texts in the order of the training texts score better than their words shuffled."""
    rnd = random.Random(4)
    words_ = [f"{a}{b}{c}" for a in "bdk" for b in "aeo" for c in "lmn"]
    turned = [w for i in range(120) for w in words_[i % 27 :] + words_[: i % 27]]
    lines = [" ".join(turned[i : i + 25]) for i in range(0, 3000, 25)]
    mixed = [" ".join(rnd.sample(line.split(), 25)) for line in lines]
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 == 1]
    made = [*zip(ids, lines, strict=False), (held[0], lines[0]), (held[1], mixed[0])]
    got = {r.doc_id: r.score for r in ctw.score_documents(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert got[held[0]] > got[held[1]] + 20


# -- 3 urls -----------------------------------------------------------------------------------------------------


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "https://A.Example.ORG/es/x?y": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "https://example.org/en/12#t": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "http://x.com/fr/a": ("x.com", "/fr/a", "com/fr/", "allow"),
        "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"),
        "http://casino-win.com/en": ("casino-win.com", "/en", None, "block"),
        "http://cheap-pills.net/": ("cheap-pills.net", "/", None, "block"),
        "http://cheap-cheap.net/": ("cheap-cheap.net", "/", None, "allow"),
        "http://cheaper.farmhouse.net/": ("cheaper.farmhouse.net", "/", None, "allow"),
        "http://org?x=1": ("org", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    frame = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(cases)], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(frame).collect()}
    assert list(got[i] for i in range(len(cases))) == list(cases.values())
    assert urls.judge_urls(frame.limit(0)).count() == 0


def test_weighted_vocabularies(spark):
    pages = spark.createDataFrame([(0, "http://a.net/%63%41sino%20x"), (1, "http://a.net/mauve-teal"), (2, "http://a.net/mauve"), (3, "http://a.net/c%C3%A9/%zz/%"), (4, "http://a.net/Ochre"), (5, "http://mauve.net/teal/teal%2Dmauve" + "/x" * 50_000)], "page_id long, url string")
    assert [r.verdict for r in urls.judge_urls(pages, rules=[]).orderBy("page_id").collect()] == ["block", *["allow"] * 5]
    table = spark.createDataFrame([("Mauve", 1.5), ("mauve", 1.0), ("teal", 0.5), ("OCHRE", 7.0), ("", 9.0), (None, 9.0), ("x", None)], "term string, weight double")
    got = urls.judge_urls(pages, rules=[], terms=table).orderBy("page_id").collect()
    assert [(r.verdict, r.n_strict, r.n_soft, r.weight) for r in got] == [("allow", 0, 0, 0.0), ("block", 0, 2, 2.0), ("allow", 0, 1, 1.5), ("allow", 0, 0, 0.0), ("block", 1, 0, 7.0), ("block", 0, 2, 2.0)]
    assert not set(urls.STRICT) & set(urls.SOFT) and all(t == t.lower() for t in urls.STRICT + urls.SOFT)


# -- 4 quality --------------------------------------------------------------------------------------------------


def plain_quality(text):
    ws, text, seen, dup = words(text), text or "", set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    mark = [False] * len(ws)
    for i in range(len(ws) - 7):
        if grams[tuple(ws[i : i + 8])] > 1:
            mark[i : i + 8] = [True] * 8
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), dup, sum(mark)


def test_statistics(rows):
    texts = [t for _, t, *_ in rows] + ["a\nb\na\n \n \n a\n", "## *a* | <b> & $% \x85 \u2028x", "r s t u v w x y " * 4, "é " * 30]
    for text, got in zip(texts, quality.statistics(texts).tolist(), strict=True):
        assert tuple(got[:5]) == plain_quality(text), text


def test_learned_list_finds_the_planted_rule_and_nothing_in_noise():
    rnd = random.Random(2)
    x = {f: quality.np.array([rnd.random() for _ in range(900)]) for f in ("a", "b", "c")}
    bad = (x["a"] > 0.8) & (x["b"] <= 0.5)
    rules = quality.learn(x, bad)
    hit = quality.np.any([quality.covered(r, x) for r in rules], axis=0)
    assert (hit == bad).mean() > 0.98
    assert quality.learn(x, quality.np.array([rnd.random() < 0.3 for _ in range(900)])) == []
    assert quality.learn(x, quality.np.zeros(900, bool)) == []


def test_quality_verdicts_generalise(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    rows = quality.judged(docs, train).join(test, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    junk = [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.97 and sum(junk) / len(junk) < 0.1


def test_repeated_ids_do_not_change_the_list(spark):
    """An id with several texts and labels counts once, by a total order, however the rows are dealt."""
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    more = base.select((F.col("doc_id") % 50).alias("doc_id"), "text")
    docs = base.unionByName(more)
    both = labels.unionByName(labels.select("doc_id", (1 - F.col("quality")).cast(labels.schema["quality"].dataType).alias("quality")).where("doc_id % 9 = 0"))
    assert quality.fit(docs, both, 300) == quality.fit(docs.repartition(7), both.repartition(5), 300)


def test_quality_edges(spark, docs, rows, empty):
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judged(docs, labels).collect()}
    for i, t, *_ in rows:
        n, *_, repeats = plain_quality(t)
        assert got[i].base_failed == (n < 20 or 100 * repeats > 30 * n) and got[i].kept == (not got[i].base_failed)
    assert quality.judged(empty, labels.limit(0)).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.keep_good(docs, labels).count() == sum(r.kept for r in got.values())


# -- 5 phrases --------------------------------------------------------------------------------------------------


def plain_removed(rows, n):
    first = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        ws = words(t)
        for k in range(len(ws) - n + 1):
            first.setdefault(tuple(ws[k : k + n]), i)
    out = {}
    for i, t, *_ in rows:
        ws = words(t)
        gone = set(itertools.chain.from_iterable(range(k, k + n) for k in range(len(ws) - n + 1) if first[tuple(ws[k : k + n])] < i))
        out[i] = (len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone))
    return out


@pytest.mark.parametrize("shards", [1, 5])
def test_phrases(spark, shards, empty):
    rnd = random.Random(4)
    made = sample(30, 7, 40)
    passages = [[rnd.choice("abcdefgh") for _ in range(size)] for size in (3, 4, 30, 120)]
    for i in range(40):
        parts = [[f"u{rnd.random()}" for _ in range(rnd.randint(0, 4))] for _ in range(3)]
        for part in parts:
            p = rnd.choice(passages)
            at = rnd.randint(0, len(p) // 2)
            part += p[at : at + rnd.randint(2, 90)]
        made.append((1000 + i, " ".join(sum(parts, [])), "en", "s", 0))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in phrases.remove_repeated_phrases(spark.createDataFrame(made, DOCS), n=4, n_shards=shards).collect()}
    assert got == plain_removed(made, 4)
    assert phrases.remove_repeated_phrases(empty).count() == 0


def test_word_hashes_tell_words_apart_however_the_text_is_cut(monkeypatch):
    from corvane.llm import common

    rnd = random.Random(12)
    texts = [b"", b"  ", b"one", b" a\tb\x0bc\n\x0cd\r e", "é 漢字\u00a0x".encode(), b"\x00 \xff\xfe z"]
    texts += [b" ".join(bytes(rnd.choice(b"abcdefgh\xc3\xa9") for _ in range(rnd.randint(1, 12))) for _ in range(rnd.randint(0, 60))) + b" " * rnd.randint(0, 2) for _ in range(200)]
    whole = common.word_hashes_of(texts)
    assert [len(h) for h in whole] == [len(t.split()) for t in texts]
    known = {}
    for t, h in zip(texts, whole, strict=True):
        for w, x in zip(t.split(), h.tolist(), strict=True):
            assert known.setdefault(w, x) == x
    assert len(set(known.values())) == len(known)
    monkeypatch.setattr(common, "SLICE", 7)
    monkeypatch.setattr(common, "_tables", {})
    assert all((common.word_hashes(t) == h).all() for t, h in zip(texts, whole, strict=True))
    assert all((a == h).all() for a, h in zip(common.word_hashes_of(texts), whole, strict=True))
    anagrams = ["".join(p).encode() for p in itertools.permutations("abcdefgh")]
    assert len(set(common.word_hashes(b" ".join(anagrams)).tolist())) == len(anagrams)


def test_passages_are_unbranched_and_found_whole():
    """Random texts over few words, where windows repeat, overlap and loop within a text: the automaton finds what a scan of all windows does."""
    rnd = random.Random(11)
    pa = phrases.pa
    for trial in range(150):
        n = rnd.choice([2, 3, 4])
        made = [(i * 3, " ".join(rnd.choice("abc"[: rnd.choice([1, 2, 3])]) for _ in range(rnd.randint(0, 30)))) for i in range(rnd.randint(1, 8))]
        made += rnd.sample(made, rnd.randint(0, 1))
        shard = pa.table({"doc_id": pa.array([i for i, _ in made], pa.int64()), "text": [t for _, t in made], "shard": pa.array([0] * len(made), pa.int32())})
        asked = phrases._ask(shard, n, 3)
        answers = pa.concat_tables([phrases._answer(asked.filter(pa.compute.equal(asked["bucket"], b))) for b in set(asked["bucket"].to_pylist())]) if asked.num_rows else pa.table({"bucket": [], "earlier": []})
        got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in phrases._remove(shard, answers, n, 3).to_pylist())
        want = collections.Counter()
        firsts = {}
        for i, t in sorted(made):
            w = t.split()
            for k in range(len(w) - n + 1):
                firsts.setdefault(tuple(w[k : k + n]), i)
        for i, t in made:
            w = t.split()
            gone = {p for k in range(len(w) - n + 1) if firsts[tuple(w[k : k + n])] < i for p in range(k, k + n)}
            want[i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)] += 1
        assert got == want, (trial, made)


def test_phrases_of_repeated_ids_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(20))
    frame = spark.createDataFrame([(5, text), (5, text), (7, text), (None, text)], "doc_id long, text string")
    got = sorted((r.doc_id or 99, r.n_removed) for r in phrases.remove_repeated_phrases(frame, n_shards=2).collect())
    assert got == [(5, 0), (5, 0), (7, 20), (99, 20)]


# -- 6 html -----------------------------------------------------------------------------------------------------

PARAGRAPH = "The river of the town was in the valley and it is for that reason that the people of the town are at the river with the boats on it. "


def test_html():
    page = f"""<!doctype html><html><head><title>T of the</title><style>p{{}}</style></head><body><header><a href=/>Home</a> Site of the day</header><nav><ul><li><a href=/a>The A of it</a></li></ul></nav>
    <div class="cookie-notice">{PARAGRAPH}</div><div id="sidebar"><p>{PARAGRAPH}</p></div><article><h1>Title &amp; more</h1><p>{PARAGRAPH}<script>var t="</p>";</script><br>and&nbsp;on</p><p>Short one.<p>{PARAGRAPH}<div class=ad>Buy the best of it now</div></article>
    <form><p>{PARAGRAPH}</p></form><section class="comments"><p>{PARAGRAPH}</p></section><footer>&copy; the owner of it</footer></body></html>"""
    p = PARAGRAPH.strip()
    assert html.main_text(page) == f"Title & more\n\n{p} and on\n\nShort one.\n\n{p}"


def test_html_edges(spark):
    odd = [None, "", "<", "<p", "plain text", "<p>" * 500, "<a href='x", "<script>never closed <p>x</p>", "<div><b>x</div></b>", "&#0;&bogus; &lt;", "<p>" + PARAGRAPH * 3000 + "</p>"]
    frame = spark.createDataFrame([(i, None, h, 0) for i, h in enumerate(odd)], "page_id long, url string, html string, n_chars int")
    got = {r.page_id: r for r in html.extract(frame).collect()}
    assert all(r.n_chars == len(r.text) for r in got.values()) and got[0].text == got[1].text == "" and got[10].n_chars > 100_000
    assert html.extract(frame.limit(0)).count() == 0


def test_html_on_pages(spark):
    wrong = 0
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    for r in pages:
        article = re.search("<article>(.*)</article>", r.html, re.S)[1]
        parts = (" ".join(html.html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h\d)>", article))
        wrong += html.main_text(r.html) != "\n\n".join(filter(None, parts))
    assert wrong == 0


def plain_labels(blocks):
    """The two passes as they are described, each open block looking at all others."""
    density = [html.stop_density(b.text) for b in blocks]
    spoken = 4 * sum(len(b.text) for b, d in zip(blocks, density, strict=True) if d > 0) >= sum(len(b.text) for b in blocks)
    first = []
    for b, d in zip(blocks, density, strict=True):
        n, links = len(b.text), b.linked / max(1, len(b.text))
        long_ = n > html.LONG or b.main
        if b.out or (links > html.LINKS and not b.main):
            first.append("bad")
        elif b.tag in html.HEADINGS:
            first.append("heading")
        elif not b.main and (b.text[0] in "©®" or (n < html.SHORT and links > 0)):
            first.append("bad")
        elif n < html.SHORT:
            first.append("short")
        elif not spoken or d >= html.STOP_HIGH:
            first.append("good" if long_ else "near")
        else:
            first.append("near" if d >= html.STOP_LOW or b.main else "bad")
    sure = [i for i, x in enumerate(first) if x in ("good", "bad")]
    out = []
    for i, b in enumerate(blocks):
        if i in sure:
            out.append(first[i])
            continue

        def sides(some):
            return max((j for j in some if j < i), default=None), min((j for j in some if j > i), default=None)

        left, right = sides([j for j in sure if blocks[j].place == b.place])
        if left is None and right is None:
            left, right = sides(sure)
            if b.main and "good" not in [first[j] for j in (left, right) if j is not None]:
                out.append("good")
                continue
        if first[i] == "heading" and right is not None:
            out.append(first[right])
            continue
        if not sure:
            out.append("good")
            continue
        if b.main:
            left, right = (right if left is None else left), (left if right is None else right)
        (x, m), (y, n) = (("bad", e) if j is None else (first[j], abs(j - i)) for j, e in ((left, i + 1), (right, len(blocks) - i)))
        if x == y:
            out.append(x)
        elif first[i] == "near" or b.main:
            out.append("good")
        else:
            out.append("bad" if m == n else x if m < n else y)
    return out


def test_block_labels_equal_a_plain_labeller():
    rnd = random.Random(6)
    words_ = ["the", "of", "and", "to", "stone", "river", "blue", "kayak"]
    for _ in range(300):
        blocks = []
        for _ in range(rnd.randint(0, 25)):
            text = " ".join(rnd.choice(words_[: rnd.choice([4, 8, 8])] if rnd.random() < 0.7 else words_[4:]) for _ in range(rnd.choice([2, 5, 14, 20, 50])))
            blocks.append(html.Block(rnd.choice(["", "", "© "]) + text, rnd.choice([0, 0, 0, 5, len(text)]), rnd.choice(["p", "p", "p", "h2", "li"]), rnd.randint(0, 3), rnd.random() < 0.15, rnd.random() < 0.2))
        html.classify(blocks)
        assert [b.label for b in blocks] == plain_labels(blocks)


def test_long_and_broken_pages_take_linear_time():
    import time

    n = 80_000
    began = time.process_time()
    text = html.main_text("<body><article>" + "".join(f"<p>short text {i} of it</p>" for i in range(n)) + "</article></body>")
    assert text.count("\n\n") == n - 1 and text.endswith(f"short text {n - 1} of it")
    for odd in ("<a x='\"z>", '<p class="x>', "<a '", "<!", "<script </script ", "<span>", "<div>", "</script", "<a x=\"'>", "<!--", "&amp"):
        html.main_text(odd * n)
    html.main_text("<span>" * n + "</b>" * n)
    assert time.process_time() - began < 90


def test_tags_end_where_their_quotes_say():
    tags = lambda page: [(t[2], t[3], t[4].strip()) for t in html.Tags(page)]
    assert tags("<a title=\"x > y\" b='>'>t</a>") == [("a", False, "title=\"x > y\" b='>'"), ("a", True, "")]
    assert tags("<p class=\"x>one</p>") == [("p", False, 'class="x'), ("p", True, "")]
    assert tags("a < b > c <1> <!-- <p> --><!doctype html><?x?>") == [("", False, "")] * 3
    assert tags("<p") == [] and tags("</p x") == [] and html.main_text("a < b") == "a < b"


def test_no_block_of_an_article_goes_for_its_signs_or_links():
    sign = "© is the sign of a right that is held in a text, and ® is that of a mark, in a paragraph of the article."
    links = "<p>See <a href=/a>this page of the town on it</a>.</p><p><a href=/b>All of it is a link in the text</a></p>"
    page = f"<body><p>© the owner of the page</p><article><p>{PARAGRAPH}</p><p>{sign}</p>{links}<p>® short</p><p>{PARAGRAPH}</p></article><p><a href=/c>A link of the page to it</a></p><footer>© it</footer></body>"
    p = PARAGRAPH.strip()
    assert html.main_text(page) == "\n\n".join([p, sign, "See this page of the town on it.", "All of it is a link in the text", "® short", p])


def test_elements_within_an_article_stay():
    page = f"<body><article><p>{PARAGRAPH}</p><noscript><p>no script of it</p></noscript><p>let <math><mi>x</mi></math> be <object>a thing</object> and <canvas>drawn</canvas></p><p>{PARAGRAPH}</p><svg><title>t</title></svg><select><option>o</select></article></body>"
    assert html.main_text(page) == f"{PARAGRAPH.strip()}\n\nno script of it\n\nlet x be a thing and drawn\n\n{PARAGRAPH.strip()}"


# -- 7 bpe ------------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, docs, rows):
    from tokenizers import Tokenizer

    path = queries.vocabulary_path()
    library, own = Tokenizer.from_file(path), bpe.Vocabulary(open(path, encoding="utf-8").read())
    rnd = random.Random(5)
    letters = list("abcdeé 'st'll re \n\t  123٣ñ漢字🙂<|>") + ["<|endoftext|>", "\x00", "\u00a0", "\x85", "aaaa", "the "]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(1500)] + ["a" * 3000, "ab" * 2000, "?!" * 900, "x" * 33, "x" * 32, " " * 100]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        got = own.encode(text).tolist()
        assert got == want, text
        assert own.decode(got) == library.decode(want, skip_special_tokens=False)
    assert own.decode([own.of_byte[0xC3], own.of_byte[0x28]]) == "\ufffd("
    assert [x.tolist() for x in own.encode_all([*texts, None, ""])] == [*(own.encode(t).tolist() for t in texts), [], []]
    got = {r.doc_id: r for r in bpe.digests(docs, path).collect()}
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(t or ""))
    back = bpe.decode(bpe.encode(docs, path), path).collect()
    assert all(r.decoded == (r.text or "") for r in back) and bpe.encode(docs.limit(0), path).count() == 0
    clash = docs.withColumn("ids", F.lit("x")).withColumn("decoded", F.lit(1))
    assert bpe.encode_and_decode(clash, path).schema["ids"].dataType.simpleString() == "array<int>"


def test_trees_pick_every_merge(monkeypatch):
    """Trees grown together, trees grown alone and a scan over all pairs make the same merges; no pre-token goes another way."""
    own = bpe.Vocabulary(open(queries.vocabulary_path(), encoding="utf-8").read())

    def scan(token):
        symbols = own.of_byte[list(token)].tolist()
        while True:
            ranked = [(own.ranks[p], i) for i, (a, b) in enumerate(itertools.pairwise(symbols)) if (p := a << 32 | b) in own.ranks]
            if not ranked:
                return symbols
            rank, i = min(ranked)
            symbols[i : i + 2] = [int(own.made[rank])]

    rnd = random.Random(3)
    tokens = [w.encode() for w in "the of hello transformation internationalisation naïveté aaaaaaaa x".split()]
    tokens += [bytes(rnd.choice(b"etaoin shrdlu\xc3\xa9") for _ in range(rnd.randint(2, 70))) for _ in range(800)]
    want = [scan(t) for t in tokens]
    ids = lambda found: [list(memoryview(x).cast("i")) for x in found]
    calls = []
    for name in ("_merge_together", "_merge_one"):
        monkeypatch.setattr(bpe.Vocabulary, name, lambda self, x, *more, f=getattr(bpe.Vocabulary, name): calls.append(1 if isinstance(x, bytes) else len(x)) or f(self, x, *more))
    assert ids(own.merge(tokens)) == want and sum(calls) == sum(len(t) > 1 for t in tokens)
    assert ids(map(own._merge_one, (t for t in tokens if len(t) > 1))) == [w for t, w in zip(tokens, want, strict=True) if len(t) > 1]


def test_other_vocabularies_are_refused():
    import json

    definition = json.loads(open(queries.vocabulary_path(), encoding="utf-8").read())
    for key, value in (("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": True})):
        with pytest.raises(ValueError, match="byte-level"):
            bpe.Vocabulary(json.dumps(definition | {key: value}))


def test_a_very_long_text_is_encoded_some_pieces_at_a_time(monkeypatch):
    own = bpe.Vocabulary(open(queries.vocabulary_path(), encoding="utf-8").read())
    text = "some words of a text 12 " * 4000 + "x" * 30_000
    whole = own.encode(text).tolist()
    monkeypatch.setattr(bpe, "PIECES", 1000)
    monkeypatch.setattr(bpe, "KEPT", 5)
    assert own.encode(text).tolist() == whole and own.decode(whole) == text
    assert [x.tolist() for x in own.encode_all([text, "a b", text])] == [whole, own.encode("a b").tolist(), whole]


# -- 8 mixing ---------------------------------------------------------------------------------------------------


def edf(shares, period):
    taken, out = [0] * len(shares), []
    for slot in range(period):
        ready = [(-(-(k + 1) * period // w), i) for i, (w, k) in enumerate(zip(shares, taken, strict=True)) if k < w and k * period // w <= slot]
        _, i = min(ready)
        out.append((i, taken[i], slot))
        taken[i] += 1
    return out


@pytest.mark.parametrize("weights", [[1.0], [0.5, 0.3, 0.2], [9.0, 1.0, 1.0, 1.0, 1.0], [0.34, 0.33, 0.33]])
def test_schedule_is_edf_and_stays_within_a_block(spark, weights):
    frame = spark.createDataFrame([(f"s{i}", w) for i, w in enumerate(weights)], "source string, weight double")
    shared = mixing.shares(frame, 100)
    shares = [r.share for r in shared.orderBy("number").collect()]
    period = shared.first().period
    assert sum(shares) == period and min(shares) >= 1
    got = sorted(((r.number, r.turn, r.slot) for r in mixing.schedule(shared).collect()), key=lambda r: r[2])
    assert got == edf(shares, period)
    taken = [0] * len(shares)
    for i, _, slot in got:
        taken[i] += 1
        assert all(abs(k - (slot + 1) * w / period) < 1 for k, w in zip(taken, shares, strict=True))


def test_mix_keeps_every_row_and_interleaves(spark, docs, rows, empty):
    rows_ = [(i, f"s{0 if i % 3 else i % 5}", "clash") for i in range(900)] + [(1, "s0", "clash"), (None, None, "clash"), (None, None, "clash")]
    frame = spark.createDataFrame(rows_, "doc_id long, source string, slot string")
    weights = spark.createDataFrame([("s0", 0.5), ("s3", 0.25)], "source string, weight double")
    got = mixing.mix(frame, weights, block=8, period=100).collect()
    assert len(got) == len(rows_) and len({(r.slot, r.place) for r in got}) == len(rows_)
    blocks = collections.defaultdict(set)
    sizes = collections.Counter()
    for r in got:
        blocks[r.slot].add((r.source, r.block))
        sizes[r.source, r.block] += 1
    assert all(len(b) == 1 for b in blocks.values())
    last = {s: max(b for t, b in sizes if t == s) for s, _ in sizes}
    assert all(n == 8 for (s, b), n in sizes.items() if b < last[s])
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert mixing.mix(empty).count() == 0
    ordered = mixing.in_order(mixing.mix(docs))
    assert ordered.columns == docs.columns and ordered.count() == len(rows)


def test_blocks_hold_characters_and_sums_go_by_chunks_and_groups(spark, monkeypatch):
    """Long texts of one source take no more of the mix than their weight; against plain running sums."""
    rnd = random.Random(8)
    made = [(i if i % 4 else None, "abc"[i % 3], rnd.randint(800, 1200) if i % 3 == 0 else rnd.randint(0, 60)) for i in range(1500)] + [(7, "a", None), (8, "a", -5)]
    frame = spark.createDataFrame(made, "doc_id long, source string, n_chars long")
    weights = spark.createDataFrame([(s, 1.0) for s in "abc"], "source string, weight double")
    monkeypatch.setattr(mixing, "CHUNK", 3000)
    monkeypatch.setattr(mixing, "GROUP", 3)
    got = mixing.mix(frame, weights, block=2000, period=30).collect()
    assert collections.Counter((r.doc_id, r.source, r.n_chars) for r in got) == collections.Counter(made)
    for name in "abc":
        at = 0
        for r in sorted((r for r in got if r.source == name), key=lambda r: (r.block, r.place)):
            assert (r.block, r.place) == divmod(at, 2000)
            at += 1 + max(0, r.n_chars or 0)
    ends = {s: max(r.slot for r in got if r.source == s) for s in "abc"}
    until = min(ends.values())
    taken = {s: sum(1 + max(0, r.n_chars or 0) for r in got if r.source == s and r.slot < until) for s in "abc"}
    assert max(taken.values()) - min(taken.values()) < 2 * 2000 + 1200


def test_schedule_of_the_most_sources(spark):
    import time

    n = mixing.MOST_SOURCES
    shared = mixing.shares(spark.createDataFrame([(f"s{i:04}", 1.0 + i % 7) for i in range(n)], "source string, weight double")).cache()
    shares = [r.share for r in shared.orderBy("number").collect()]
    began = time.time()
    got = sorted(((r.number, r.turn, r.slot) for r in mixing.schedule(shared).collect()), key=lambda r: r[2])
    assert time.time() - began < 300 and got == edf(shares, mixing.SPARE * n)


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame([(i, f"s{i}") for i in range(3)], "doc_id long, source string"))


# -- 9 fingerprints ---------------------------------------------------------------------------------------------


def test_neighbours_of_asked_rows(spark):
    text = " ".join(f"w{i}" for i in range(400))
    frame = spark.createDataFrame([(0, text), (1, text), (2, text.replace("w7 ", "x ")), (100, "other words here"), (3, None), (200, None), (None, "n")], "doc_id long, text string")
    prints = simhash.fingerprint_documents(frame).cache()
    got = {r.doc_id: r.n_within for r in simhash.with_neighbours(prints, F.col("doc_id") % 100 == 0).collect()}
    value = {r.doc_id: int(r.fingerprint, 16) for r in prints.collect()}
    want = {i: sum((value[i] ^ v).bit_count() <= 3 for v in value.values()) - 1 if i is not None and i % 100 == 0 else None for i in value}
    assert got == want and got[0] >= 1


def test_registered_search_finds_planted_near_copies(spark, tmp_path):
    """One word changed in 400: the query finds what all pairs within 6 bits give, most of the copies, and tells their ids."""
    rnd = random.Random(9)
    made = []
    for i in range(0, 6000, 100):
        text = [f"w{rnd.randrange(3000)}" for _ in range(400)]
        near = list(text)
        near[rnd.randrange(400)] = "changed"
        made += [(i, " ".join(text)), (i + 1, " ".join(near)), (i + 2, " ".join(near))]
    spark.createDataFrame(made, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op9_fingerprints(spark, str(tmp_path)).collect()}
    value = {i: int(r.fingerprint, 16) for i, r in got.items()}
    carriers = collections.defaultdict(list)
    for i, r in got.items():
        carriers[r.fingerprint].append(i)
    for i, r in got.items():
        if i % 100:
            assert r.n_within is None and r.within is None
            continue
        want = sorted(j for j in got if j != i and (value[i] ^ value[j]).bit_count() <= 6)
        assert r.n_within == len(want) and sorted(j for e in r.within for j in carriers[e.fingerprint] if j != i) == want
        assert all(e.doc_id == min(carriers[e.fingerprint]) and e.n == len(carriers[e.fingerprint]) for e in r.within)
    apart = [(value[i] ^ value[i + 1]).bit_count() for i in range(0, 6000, 100)]
    print("distances", sorted(apart), "within 3:", sum(d <= 3 for d in apart), "within 6:", sum(d <= 6 for d in apart), "of", len(apart))
    assert sum(got[i].n_within >= 2 for i in range(0, 6000, 100)) == sum(d <= 6 for d in apart) > 0.8 * len(apart)


@pytest.mark.parametrize("shards", [1, 6])
def test_fingerprints(spark, docs, rows, shards, empty):
    got = {r.doc_id: r for r in simhash.fingerprint_documents(docs, shards).collect()}
    prints = {}
    for k, (i, t, *_) in enumerate(rows):
        text, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha(edited))
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert r.edited_fingerprint == simhash.fingerprints([edited])[0].tobytes().hex()
        other = got[rows[(k + 1) % len(rows)][0]].fingerprint
        assert math.isclose(r.near_next, 1 - (int(r.fingerprint, 16) ^ int(other, 16)).bit_count() / simhash.BITS)
        assert math.isclose(r.near_edited, 1 - (int(r.fingerprint, 16) ^ int(r.edited_fingerprint, 16)).bit_count() / simhash.BITS)
    assert simhash.fingerprint_documents(empty).count() == 0


def test_fingerprints_of_a_lone_row_and_of_equal_ids(spark):
    one = simhash.fingerprint_documents(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == sha("abab") and one.near_next == 1.0


@pytest.mark.parametrize("shards", [1, 3, 9])
def test_rows_of_one_id_and_of_none_are_cut_into_ranges(spark, shards):
    made = [(1, f"text of {i}") for i in range(40)] + [(None, f"other {i} x") for i in range(40)] + [(1, "text of 3"), (0, "first"), (2, None)]
    frame = spark.createDataFrame(made, "doc_id long, text string")
    turns = {r.text: r.turn for r in frame.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("turn")).collect()}
    order = sorted(((1 << 62 if i is None else i, turns[t or ""], t or "") for i, t in made))
    texts = [t for *_, t in order]
    want = collections.Counter()
    for k, (i, _, text) in enumerate(order):
        after, half = texts[(k + 1) % len(texts)], len(text) // 2
        want[None if i == 1 << 62 else i, sha(text[: len(text) - half] + after[:half])] += 1
    got = simhash.fingerprint_documents(frame, shards).collect()
    assert collections.Counter((r.doc_id, r.edited_sha256) for r in got) == want


def test_a_huge_text_votes_in_bounded_memory():
    import time
    import tracemalloc

    text = " ".join(f"{i * 7919 % 1000003:x}{i % 97}" for i in range(2_500_000))
    assert len(text) > 15 << 20
    tracemalloc.start()
    began = time.process_time()
    (long_,) = simhash.fingerprints([text])
    took, peak = time.process_time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20 and took < 60
    assert (simhash.fingerprints(["A b c", "a  B\nc"])[0] == simhash.fingerprints(["a b c"])[0]).all() and long_.any()


def test_block_tables_find_all_within_the_radius(spark):
    rnd = random.Random(6)
    base = [rnd.getrandbits(128) for _ in range(20)]
    made = base + [b ^ sum(1 << k for k in rnd.sample(range(128), d)) for b in base for d in (1, 3, 6, 7, 9)]
    frame = spark.createDataFrame([(f"{x:032x}",) for x in made + made[:5]] + [(None,)], "fingerprint string")
    for radius in (0, 3, 6):
        got = {(r.query, r.fingerprint): r.distance for r in simhash.within_radius(frame, frame, radius).collect()}
        assert got == {(f"{a:032x}", f"{b:032x}"): (a ^ b).bit_count() for a in made for b in made if (a ^ b).bit_count() <= radius}
    with pytest.raises(ValueError):
        simhash.within_radius(frame, frame, 7)


# -- 10 near duplicates -----------------------------------------------------------------------------------------


def plain_components(sets, percent):
    part = {i: i for i in sets}

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            part[y] = x
    return {i: find(i) for i in sets}


def shingles(text, n):
    ws = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(text)]
    size = min(n, len(ws))
    return {tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} if ws else set()


def groups(seed):
    """Families of copies at all distances, so that some link only by way of others."""
    rnd = random.Random(seed)
    texts = []
    for _ in range(6):
        base = [f"v{rnd.randint(0, 500)}" for _ in range(rnd.randint(15, 90))]
        for _ in range(25):
            copy = list(rnd.choice([base, base, texts[-1].split() if texts else base]))
            for _ in range(rnd.randint(0, max(1, len(copy) // 9))):
                copy[rnd.randrange(len(copy))] = f"z{rnd.randint(0, 10**6)}"
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("n,seed", [(2, 1), (2, 2), (5, 3)])
def test_near_duplicates(spark, n, seed, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 8)
    monkeypatch.setattr(setsketch, "SMALL", 3)
    made = [(i, t) for i, t in enumerate(groups(seed))] + [(500 + i, t) for i, (_, t, *_) in enumerate(sample(20))]
    frame = spark.createDataFrame(made, "doc_id long, text string")
    got = {r.doc_id: r for r in setsketch.near_duplicates(frame, n).collect()}
    sets = {i: shingles(t, n) for i, t in made}
    want = plain_components(sets, 80)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    kept = setsketch.keep_one(frame, n)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in sets if want[i] == i)


def test_near_duplicates_edges(spark, empty):
    assert setsketch.near_duplicates(empty).count() == 0
    rows_ = [(1, "a b c"), (1, "x y z"), (2, "x y z"), (3, "a b c"), (None, "q r s"), (4, None), (5, ""), (1, "a b c")]
    got = [(r.doc_id, r.component_id) for r in setsketch.near_duplicates(spark.createDataFrame(rows_, "doc_id long, text string"), 2).collect()]
    assert collections.Counter(got) == collections.Counter([(1, 1)] * 3 + [(2, 1), (3, 1), (None, None), (4, 4), (5, 5)])


def test_one_of_repeated_rows_stays_whatever_their_columns(spark):
    frame = spark.createDataFrame([(1, "a b c d e f", {"k": 2}), (1, "a b c d e f", {"k": 1}), (2, None, None), (None, "x", {})], "doc_id long, text string, `odd.name` map<string,int>")
    got = setsketch.keep_one(frame).collect()
    assert sorted((r.doc_id or 9, (r["odd.name"] or {}).get("k")) for r in got) == [(1, 1), (2, None), (9, None)]


def test_registers_merge_and_estimate():
    rnd = setsketch.np.random.default_rng(1)
    pool = rnd.integers(0, 1 << 63, 3000, setsketch.np.uint64)
    a, b = pool[:2000], pool[500:2500]
    ra, rb = setsketch.registers(a), setsketch.registers(b)
    assert (setsketch.merged(ra, rb) == setsketch.registers(setsketch.np.union1d(a, b))).all()
    j = setsketch.similarity(ra[None], rb[None], setsketch.np.array([2000.0]), setsketch.np.array([2000.0]))[0]
    assert abs(j - 0.6) < 0.12


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, x) for x in range(101, 180)] + [(7, 7), (3, 2), (2, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, **{x: 100 for x in range(101, 180)}}


# -- pipeline and contracts -------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.01"  # the smallest size has too few labels to learn from
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near dedup", "secret scans", "source mixing", "bpe encoding"]
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf).cache())
    good, one, masked, mixed, encoded = out[1:]
    assert all(f.columns == docs.columns for f in out[1:5])
    kept = {r.doc_id for r in good.collect()}
    assert sum(labels.get(i) == 0 for i in kept) <= 1 and sum(labels.get(i) == 1 for i in kept) > 300
    sets = {r.doc_id: shingles(r.text, 5) for r in good.collect()}
    want = plain_components(sets, 80)
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i in sets if want[i] == i)
    assert masked.count() == one.count() == mixed.count() == encoded.count()
    assert encoded.where("not round_trip").count() == 0 and encoded.where("n_tokens <> size(ids)").count() == 0


def test_pipeline_of_odd_and_of_no_rows(spark, tmp_path):
    """Nulls in every column, empty and repeated rows, a long text, ties, columns that clash with the stages' own."""
    rnd = random.Random(15)
    text = lambda n: " ".join(rnd.choice(["stone", "river", "blue", "kayak", "walks", "under", "seven"]) + str(rnd.randint(0, 99)) for _ in range(n))
    good = [(i, text(40), f"s{i % 3}") for i in range(12)]
    odd = [(20, None, "s0"), (21, "", "s0"), (22, " \n", None), (23, "few words only", "s1"), (24, text(60_000), "s1"), (None, text(30), None), (None, None, None), (25, text(30), None)]
    made = [(i, t, None if i == 3 else "en", s, None if i == 4 else len(t or "")) for i, t, s in [*good, *odd, good[5], good[5], (5, text(45), "s2")]]
    frame = spark.createDataFrame(made, DOCS).withColumns({c: F.lit("own") for c in ("slot", "place", "_id", "kept", "ids")})
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", frame), ("none", frame.limit(0))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.limit(0 if name == "none" else 9).write.parquet(str(tmp_path / name / "labels.parquet"))
        given = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            given = stage(spark, given, str(tmp_path / name))
            assert given.columns == frame.columns
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    ids = sorted(r.doc_id for r in got if r.doc_id is not None)
    assert ids == [*range(12), 24, 25] and sum(r.doc_id is None for r in got) == 1
    assert all(r.round_trip and r.n_tokens == len(r.ids) > 0 for r in got) and len({(r.slot, r.place) for r in got}) == len(got)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_pipeline_keeps_the_order_of_the_mix_over_files(spark, tmp_path):
    """Part files of other sizes than their turn, as Spark packs them by size when it reads them again."""
    made = [(i, f"text {i} " * (1 + (i * 37) % 400), f"s{0 if i % 4 else i % 3}") for i in range(2000)]
    frame = spark.createDataFrame(made, "doc_id long, text string, source string")
    want = [r.doc_id for r in mixing.mix(frame).orderBy("slot", "place").collect()]
    corpus_pipeline.source_mixing(spark, frame, SF).repartition(7, "doc_id").write.parquet(str(tmp_path / "mixed"))
    out = corpus_pipeline.bpe_encoding(spark, spark.read.parquet(str(tmp_path / "mixed")), SF)
    assert [r.doc_id for r in out.collect()] == want
    out.write.parquet(str(tmp_path / "ids"))
    again = spark.read.parquet(str(tmp_path / "ids"))
    assert [r.doc_id for r in again.orderBy("slot", "place").collect()] == want


def test_queries_match_their_sql(spark):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, SF).toPandas(), con.execute(sql).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        plain = lambda t: sorted(t[columns].astype(object).where(t[columns].notna(), None).itertuples(index=False, name=None), key=repr)
        assert plain(got) == plain(want), name


def test_clashing_columns_pass_through(spark, rows):
    """Columns named like the operators' own go through untouched."""
    names = ["_row", "_id", "_stats", "_live", "_text", "_content", "_hash", "_source", "_key", "_at", "shard", "bucket", "node", "part", "share", "period", "number"]
    frame = spark.createDataFrame(rows, DOCS)
    for i, name in enumerate(names):
        frame = frame.withColumn(name, F.lit(i))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for out in (quality.keep_good(frame, labels), setsketch.keep_one(frame), secrets.mask_live(frame), mixing.in_order(mixing.mix(frame)), bpe.encode(frame, queries.vocabulary_path()).drop("ids")):
        assert out.columns == frame.columns
        assert [out.first()[name] for name in names] == list(range(len(names)))
    for out in (phrases.remove_repeated_phrases(frame), setsketch.near_duplicates(frame), secrets.scan(frame), simhash.fingerprint_documents(frame), ctw.score_documents(frame), quality.judged(frame, labels)):
        assert out.count() == len(rows)


def test_html_of_other_layouts():
    p = PARAGRAPH.strip()
    page = f"""<body class="home comments-open"><div class="header"><p>{p}</p></div><div class="menu"><p>{p}</p></div><article class="post has-comments"><header><h1>The title of it</h1></header>
    <p>{p} <span class="share">Share it</span> and more</p><ul><li>{p}</li><li>Short item</li></ul><aside><p>{p}</p></aside><table><tr><td>{p}</td></tr></table></article>
    <div id="disqus_thread"><article class="comment"><p>{p}</p></article></div><div class="newsletter-signup">{p}</div><p hidden>{p}</p></body>"""
    assert html.main_text(page) == "\n\n".join(["The title of it", f"{p} and more", p, "Short item", p])
    plain = f"<body><p>Menu</p><h2>Head of the text</h2><p>{p * 2}</p><p>So it was.</p><p>{p * 2}</p><p>&copy; me</p></body>"
    assert html.main_text(plain) == "\n\n".join(["Head of the text", " ".join((p * 2).split()), "So it was.", " ".join((p * 2).split())])
