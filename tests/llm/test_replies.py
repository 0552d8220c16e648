"""Reply trees against plain recursion: branches, ranks, circles and orphans; a template whose marks texts can't forge."""

import hashlib
import itertools
import random

import pytest

from corvane.llm import replies

MESSAGES = "tree_id string, message_id long, parent_id long, role string, text string, score double, extra int"
PIECES = ["", "a", "\\", "<", "[", "]", ">", "/", "s>", "INST]", "é", "\U0001f600", "\n", *replies.CONTROL, *(c[0] + "\\" + c[1:] for c in replies.CONTROL), "[\\\\INST]"]


def test_what_is_written_is_read_back():
    rnd = random.Random(4)
    roles = ["user", "assistant", "system", "tool", "", None, "[TEXT]", "</s>", "USER"]
    for _ in range(3000):
        turns = [(rnd.choice(roles), "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 6)))) for _ in range(rnd.randint(0, 5))]
        text, spans = replies.written(turns)
        assert replies.read(text) == [(r or "", t) for r, t in turns]
        assert [replies.unescaped(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_texts_hold_no_control_string_once_escaped():
    for some in itertools.product(PIECES, repeat=2):
        text = "".join(some)
        assert not any(c in replies.escaped(text) for c in replies.CONTROL) and replies.unescaped(replies.escaped(text)) == text


@pytest.mark.parametrize("bad", ["[INST]a", "x", "<s>a</s>b", "[TURN]a[/TURN]", "[INST]a[/INST]</s>"])
def test_other_texts_are_refused(bad):
    with pytest.raises(ValueError):
        replies.read(bad)


def plain_branches(rows):
    """{tree: [(mean score, length, leaf, ids from the root)] in order}, by walking up from each leaf."""
    trees = {}
    for r in rows:
        parent, score = trees.setdefault(r[0], {}).get(r[1], (None, 0.0))
        mine = None if r[2] == r[1] else r[2]
        trees[r[0]][r[1]] = (min(x for x in (parent, mine) if x is not None) if (parent, mine) != (None, None) else None, max(score, r[5] or 0.0) if r[1] in trees[r[0]] else r[5] or 0.0)
    out = {}
    for tree, nodes in trees.items():
        parents = {i: (p if p in nodes else None) for i, (p, _) in nodes.items()}
        for i in sorted(nodes, key=lambda x: (x is not None, x)):  # the least of a circle is cut
            seen, at = [], i
            while at is not None and at not in seen:
                seen.append(at)
                at = parents[at]
            if at == i and at is not None and min(seen) == i:
                parents[i] = None
        found = []
        for leaf in set(nodes) - {p for p in parents.values() if p is not None}:
            path, at = [], leaf
            while at is not None or not path:
                path.append(at)
                at = parents[at]
            found.append((sum(nodes[x][1] for x in path) / len(path), len(path), leaf, path[::-1]))
        out[tree] = sorted(found, key=lambda x: (-x[0], -x[1], x[2] is not None, x[2] or 0))
    return out


def forest(seed):
    rnd = random.Random(seed)
    rows = []
    for t in range(6):
        n = rnd.randint(1, 25)
        for i in range(n):
            parent = rnd.choice([None, rnd.randrange(n), rnd.randrange(n), max(0, i - 1), max(0, i - 1), 999])
            rows.append((f"t{t}", i, parent, rnd.choice(["user", "assistant"]), f"{t}/{i}</s>", rnd.choice([None, 0.25, 0.5, 1.0]), 1))
    rows += [("chain", i, i - 1 if i else None, "user", str(i), 0.5, 1) for i in range(100)]
    rows += [("star", i, 0 if i else None, "assistant", str(i), float(i % 3), 1) for i in range(200)]
    rows += [("ring", i, (i + 1) % 5, "user", str(i), 0.0, 1) for i in range(5)] + [("ring", 9, 3, "user", "hangs below", 1.0, 1)]
    rows += [(None, 1, None, None, None, None, 1), (None, None, 1, "user", "no id", 1.0, 1), ("lone", 3, 3, "tool", "", 0.0, 1)]
    return rows


@pytest.mark.parametrize(("seed", "keep"), [(1, 1), (2, 3), (3, None)])
def test_branches(spark, seed, keep):
    rows = forest(seed)
    want, texts = {}, {(r[0], r[1]): (r[3] or "", r[4] or "") for r in rows}
    for tree, found in plain_branches(rows).items():
        for rank, (score, n, leaf, path) in enumerate(found[:keep], 1):
            want[tree, leaf] = (rank if keep else None, round(score, 9), n, *replies.written([texts[tree, x] for x in path]))
    got = replies.conversations(spark.createDataFrame(rows, MESSAGES).repartition(3), keep).collect()
    assert {(r.tree_id, r.leaf_id): (r["rank"], round(r.score, 9), r.n_turns, r.text, [(s.start, s.end) for s in r.loss]) for r in got} == want
    assert len(got) == len(want)


def test_repeated_rows_follow_each_other(spark):
    rows = [("a", 1, None, "user", "q", 0.0, 1), ("a", 2, 1, "assistant", "x", 0.0, 1), ("a", 2, 1, "assistant", "x", 0.0, 1), ("a", 2, None, "assistant", "b", 2.0, 1)]
    got = replies.conversations(spark.createDataFrame(rows, MESSAGES)).collect()
    assert [(r.n_turns, r.text) for r in got] == [(4, "[INST]q[/INST]<s>b</s><s>x</s><s>x</s>")]
    assert replies.conversations(spark.createDataFrame([], MESSAGES)).count() == 0


def test_digests(spark):
    rnd = random.Random(6)
    turns = [(c, t, rnd.choice(["user", "assistant", "tool", None]), rnd.choice([None, "", "x", "</s>", "[INST]" * 3, "long é " * 5000]), 1) for c in (0, 5, None) for t in range(rnd.randint(1, 30))]
    turns += [(7, t, "assistant", f"{t} ", 1) for t in range(300)]
    got = {r.conv_id: r for r in replies.digests(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, tree_id int").repartition(4)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    turns += [(*t, 1) for t in replies.ADDED]
    for c in {t[0] for t in turns}:
        mine = sorted((t for t in turns if t[0] == c), key=lambda t: t[1])
        loss = "".join(t[3] or "" for t in mine if t[2] == "assistant")
        r = got.pop(c)
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(mine), sha("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in mine)), len(loss), sha(loss))
        assert r.formatted_chars == len(replies.written([t[2:4] for t in mine])[0])
    assert not got
