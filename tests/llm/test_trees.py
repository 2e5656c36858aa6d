"""The conversation trie and the Merkle manifest against brute force, with nulls, ties, repeats and empty tables."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from tessella.llm import manifest, trie


def H(*x):
    return sha256("".join(x).encode()).hexdigest()


# ---------------------------------------------------------------- conversations


def brute_trie(rows):
    talk = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            talk[c].append((t is not None, t, r or "", x or ""))
    for c in talk:
        talk[c] = [(r, x) for _, _, r, x in sorted(talk[c], key=lambda v: (v[0], v[1] or 0, v[2], v[3]))]
    built = {}
    for c in talk:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(talk.get(c - c % 100, [])[:h] + talk[c][h:])
    node = defaultdict(list)
    for c, b in built.items():
        for d in range(len(b) + 1):
            node[b[:d]].append(c)
    kids = defaultdict(list)
    for p in node:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(node, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(node[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in kids[p])
    out = []
    for p, cs in node.items():
        done = sorted(c for c in cs if len(built[c]) == len(p))
        out.append((min(cs), len(p), min(node[p[:-1]]) if p else None, len(cs), len(kids[p]), leaves[p], saved[p], H(",".join(map(str, done)))))
    return sorted(out)


def talks(seed, n=260, longest=9):
    r = random.Random(seed)
    say = [(a, b) for a in ("user", "bot", None) for b in ("hi", "no 😀", "", None, "so so", "x" * 300)]
    rows = []
    for c in r.sample(range(420), n):
        shared = r.random() < 0.3
        for t in range(r.randint(1, longest)):
            role, text = say[t % len(say)] if shared else r.choice(say)
            rows.append((c, None if r.random() < 0.1 else t, role, text, "clash"))
            if r.random() < 0.1:
                rows.append(rows[-1])
    rows += [(None, 1, "user", "nowhere", "clash"), (5000, 0, "user", "alone", "clash")]
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string, c0 string"


def of(df):
    return sorted(tuple(r)[:8] for r in df.collect())


def test_trie(spark):
    rows = talks(1)
    got = of(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(4)))
    assert got == brute_trie(rows)
    # conversations without a base that are shorter than what is cut off are members of the root alone
    assert any(zlib.crc32(str(c).encode()) % 6 and c == 5000 for c in {r[0] for r in rows if r[0] is not None})


def test_trie_runs_and_long_conversations(spark, monkeypatch):
    """Several runs of turns and depths a conversation, ids in many pieces, and a text of a million characters."""
    monkeypatch.setattr(trie, "RUN", 16)
    monkeypatch.setattr(trie, "IDS", 8)
    rows = [(c, t, "user", f"turn {t % 3}" if t < 150 else f"{c} {t}", "") for c in (100, 101, 103, 207, 700, 745) for t in range(200)]
    rows += [(c, 0, "user", "same", "") for c in range(300, 400)] + [(800, 0, "user", "long " * 200_000, "")]
    assert of(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute_trie(rows)


def test_trie_collisions_are_seen(spark):
    rows = talks(2, 30, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    # primes this small give equal fingerprints to different sequences whatever the base
    with pytest.raises(RuntimeError):
        trie.nodes(df, (11,), attempts=2)
    assert of(trie.prefix_trie(df, (2147483647,))) == brute_trie(rows)


def test_trie_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(df).collect() == []
    assert trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", "c")], SCHEMA)).collect() == []


# ---------------------------------------------------------------- manifest


def brute_tree(hashes):
    """Root, and for each leaf its siblings on the way up with their side; a node without one is hashed alone."""
    level, at, path = list(hashes), list(range(len(hashes))), [[] for _ in hashes]
    while len(level) > 1:
        for i, k in enumerate(at):
            path[i].append((level[k ^ 1], k % 2) if k ^ 1 < len(level) else ("", 0))
        at = [k // 2 for k in at]
        level = [H(*level[k : k + 2]) for k in range(0, len(level), 2)]
    return level[0], path


def leaf_of(row, more=0):
    d, x, lang, source, n, *_ = row
    n = None if n is None else n + more
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, source, lang, n, x)))


def brute_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: (sorted(by[lang], key=lambda v: v[:3])) for lang in langs}
    sub = {lang: brute_tree([v[2] for v in trees[lang]]) for lang in langs}
    root, top = brute_tree([sub[lang][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for v, path in zip(trees[lang], sub[lang][1], strict=True):
            r, way = v[3], path + top[k]
            bad = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf_of(r, 1) if bad else v[2]
            for s, left in way:
                h = H(s, h) if left else H(h, s)
            out.append((r[0], v[2], sub[lang][0], root, H(*(s for s, _ in way)), h, h == root))
    return out


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, leaf string, tree string"


def documents(n, langs=("en", "de", None, "ß", "zh-Hant"), seed=3):
    r = random.Random(seed)
    rows = [(i if i % 37 else None, r.choice(["a", "", None, "ünï 😀\n" * 5]), r.choice(langs), r.choice(["web", None]), r.choice([3, None, 10**12]), "clash", "clash") for i in range(n)]
    return rows + rows[:3] + rows[:3]


@pytest.mark.parametrize("n,size", [(1, 2), (2, 2), (5, 2), (33, 2), (150, 3), (150, 12)])
def test_manifest(spark, n, size):
    rows = documents(n)
    got = [tuple(r) for r in manifest.tamper_proof(spark.createDataFrame(rows, DOCS).repartition(3), size).collect()]
    want = brute_manifest(rows)
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((g[:7] for g in got), key=order) == sorted(want, key=order)
    bad = sorted(r[0] for r in rows if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)
    assert sorted(g[0] for g in got if not g[6]) == bad


def test_manifest_one_language_long_text_and_empty(spark):
    rows = [(i, "x" * (2_000_000 if i == 3 else i), "en", "s", 1, "", "") for i in range(9)]
    got = sorted(tuple(r)[:7] for r in manifest.tamper_proof(spark.createDataFrame(rows, DOCS), 2).collect())
    assert got == sorted(brute_manifest(rows))
    assert manifest.tamper_proof(spark.createDataFrame([], DOCS)).collect() == []


def test_frontier_extends_witnesses():
    """After each append all complete subtrees have their witnesses; open ones keep partial witnesses."""
    state, leaves = manifest.Frontier(), [H(str(i)) for i in range(6)]
    for x in leaves:
        state.append(x)
    assert [len(w) for w in state.witness] == [2, 2, 2, 2, 1, 1]
    assert state.finish(None) == brute_tree(leaves)[0]
    assert state.sides[4] == ["R", "-", "L"]
    assert state.finish(None) == state.finish(None)
