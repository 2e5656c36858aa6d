"""Operators on documents against brute force, on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import bpe, decontam, jaccard, quality, sharding

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, component_id string, n_words string"


@pytest.fixture(scope="module")
def rows(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(120).collect()
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 3
    odd = [
        (9001, None), (9002, ""), (9003, " \n\t "), (9004, "one"), (9005, "One"), (9006, "one two"),
        (9007, "x" * 5000), (9008, base), (9009, base.upper()), (9009, base), (9009, base), (None, base), (None, None),
        (9010, "nul\x00byte 中文 é   \x0b\x0c end"), (9011, "a b c " * 2000), (9012, "\n\nsame line\nsame line\n\nother # $ %"),
    ]
    return [(r[0], r[1]) for r in given] + odd


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", 1, "clash", "clash") for r in rows], SCHEMA).repartition(3)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def ngram_set(t, n):
    w = words(lower(t))
    if len(w) < n:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def classes(rows, n, num, den):
    sets = [ngram_set(t, n) for _, t in rows]
    par = list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and den * o >= num * (len(sets[i]) + len(sets[j]) - o):
                par[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return Counter((d, len(sets[i]), low.get(find(i))) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("n", "num", "den"), [(3, 9, 10), (5, 8, 10)])
def test_jaccard(spark, docs, rows, n, num, den):
    got = jaccard.jaccard_join(docs, n, num, den).collect()
    assert Counter(tuple(r) for r in got) == classes(rows, n, num, den)


def test_jaccard_near_copies(spark):
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for size in (12, 40, 150, 700):
        for _ in range(6):
            w = [f"w{x}" for x in rng.integers(0, 5000, size)]
            for _ in range(8):
                v = list(w)
                for i in rng.integers(0, size, int(rng.integers(0, max(2, size // 40)))):
                    v[i] = f"z{rng.integers(0, 10**6)}"
                rows.append((k, " ".join(v)))
                k += 1
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for n, num, den in ((3, 9, 10), (5, 8, 10)):
        assert Counter(tuple(r) for r in jaccard.jaccard_join(df, n, num, den).collect()) == classes(rows, n, num, den)


def test_trie_links_equal_brute_force():
    rng = np.random.default_rng(1)
    for round_ in range(30):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(40)]
        sizes = np.array([len(s) for s in sets])
        start = np.arange(40)
        if round_ % 3 == 1:
            start[30:] = start[5]
        for num, den in ((9, 10), (8, 10), (1, 2)):
            for cut in (0, 17):
                want = start.copy()
                for a in range(cut or 40):
                    for b in range(cut, 40):
                        o = len(np.intersect1d(sets[a], sets[b]))
                        if den * o >= num * (sizes[a] + sizes[b] - o):
                            x, y = sorted((want[a], want[b]))
                            want[want == y] = x
                assert jaccard.trie_links(sets, sizes, cut, start, num, den).tolist() == want.tolist()


def test_jaccard_in_small_blocks_with_frequent_ngrams(spark, monkeypatch):
    """Many flushes, buckets and blocks, and n-grams so frequent that the index doesn't count them."""
    rng = np.random.default_rng(8)
    base, rows = [f"w{x}" for x in rng.integers(0, 5000, 120)], []
    for k in range(240):
        v = list(base) if k % 3 == 0 else [f"w{x}" for x in rng.integers(0, 5000, 60)] + base[: int(rng.integers(20, 120))]
        for i in rng.integers(0, len(v), int(rng.integers(0, 6))):
            v[i] = f"z{rng.integers(0, 10**6)}"
        rows.append((k, " ".join(v)))
    for name, v in (("FLUSH", 1500), ("FREQUENT", 6), ("BLOCK_NGRAMS", 2000)):
        monkeypatch.setattr(jaccard, name, v)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    for n, num, den in ((3, 9, 10), (5, 8, 10)):
        assert Counter(tuple(r) for r in jaccard.jaccard_join(df, n, num, den).collect()) == classes(rows, n, num, den)
    prof = jaccard.profile(df, 5)
    total = prof.agg({"n_shingles": "sum"}).first()[0]
    assert 0 < len(jaccard.frequent(prof, total)) <= 1500 // 6


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert jaccard.jaccard_join(none).count() == 0
    assert decontam.report(none, items).count() == 0
    assert sharding.shard_documents(none).count() == 0
    assert quality.quality_rules(none, none.select("doc_id")).count() == 0


def test_sharding(docs, rows):
    got = sharding.shard_documents(docs, 24).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    for s in range(24):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 24) for r in got)
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})


def test_hash_tree_moves_only_into_changed_subtrees(spark):
    rows = spark.range(20000)
    tree = [sharding.Shard(r, 10 * r + k, 100 * r + 10 * k + s) for r in range(3) for k in range(2) for s in range(2)]
    heavier = [sharding.Shard(s.region, s.rack, s.shard, 2.0 if s.shard == 100 else 1.0) for s in tree]
    got = sharding.descend(sharding.descend(rows, "id", tree, "a"), "id", heavier, "b").where("a <> b").select("a", "b").collect()
    assert got and all(r.b // 100 == 1 for r in got)  # rows that move end in the heavier region
    assert all(r.b == 100 for r in got if r.a // 10 == 10)  # within its rack they go to the heavier shard
    sizes = [r["count"] for r in sharding.descend(rows, "id", tree, "a").groupBy("a").count().collect()]
    assert len(sizes) == 12 and max(sizes) < 1.2 * min(sizes)


def test_bpe(docs, rows):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    want = Counter()
    for d, t in rows:
        ids = ref.encode_ordinary(t or "")
        want[d, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe.digests(docs, path, P.PATTERN).collect()) == want
    both = bpe.decode(bpe.encode(docs.withColumn("ids", F.lit("clash")), path, P.PATTERN), path, P.PATTERN)
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in both.collect())
    assert both.count() == len(rows)


def hits(text, items, size):
    tok = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w = tok(text)
    flags, found = [False] * len(w), set()
    for i, t in items:
        v = tok(t)
        for k in range(max(1, len(v) - size + 1) if v else 0):
            win = v[k : k + size]
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    flags[j : j + len(win)] = [True] * len(win)
                    found.add(i)
    return len(w), flags, found


def test_decontamination(spark, docs, rows):
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    items += [(901, "one"), (902, "Lambda,MU-nu! xi"), (903, None), (904, "..."), (905, "lambda mu nu xi"), (None, "alpha")]
    df = spark.createDataFrame(items, "item_id bigint, text string")
    known = [x for x in items if x[0] is not None]
    want = Counter()
    for d, t in rows:
        n, flags, found = hits(t, known, 10)
        want[d, n, sum(flags), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), any(flags)] += 1
    assert Counter(tuple(r) for r in decontam.report(docs, df, 10).collect()) == want
    for r in decontam.find_hits(docs, df, 10).collect():
        cut = [w for s in r.hits for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text[s.start : s.end]))]
        assert len(cut) == r.n_hit


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    """Several automata in a worker, long items cut in two, and several portions of items."""
    df = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").union(docs.where("doc_id = 9008").select(F.lit(77), "text"))
    want = Counter(tuple(r) for r in decontam.report(docs, df, 10).collect())
    spans = Counter((r.doc_id, r.text, str(r.hits)) for r in decontam.find_hits(docs, df, 10).collect())
    for words, portion in ((60, 10**9), (10**6, 900), (60, 900)):
        monkeypatch.setattr(decontam, "AUTOMATON_WORDS", words)
        monkeypatch.setattr(decontam, "PORTION_BYTES", portion)
        monkeypatch.setattr(decontam, "GROUP_BYTES", 20_000)
        assert Counter(tuple(r) for r in decontam.report(docs, df, 10).collect()) == want
        assert Counter((r.doc_id, r.text, str(r.hits)) for r in decontam.find_hits(docs, df, 10).collect()) == spans


@pytest.mark.parametrize("size", [1, 2, 5, 10])
def test_scanner_equals_brute_force(size):
    rng = np.random.default_rng(size)
    for _ in range(60):
        items = [(int(rng.integers(0, 6)), [b"w%d" % x for x in rng.integers(0, 3, rng.integers(0, 2 * size + 4))]) for _ in range(5)]
        scan = decontam.Scanner(items, size)
        w = [b"w%d" % x for x in rng.integers(0, 4, 60)]
        got, who = scan.scan(w)
        _, flags, found = hits(b" ".join(w).decode(), [(i, b" ".join(v).decode()) for i, v in items], size)
        assert got.tolist() == flags and who == found


def test_automaton_memory():
    """A worker holds AUTOMATON_WORDS at a time: some 300 bytes for each word of the items."""
    import subprocess
    import sys

    code = """
import resource, numpy as np
from tessella.llm import decontam
r = np.random.default_rng(1)
items = [(i, [b"w%d" % x for x in r.integers(0, 50000, 200)]) for i in range(2000)]
start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
s = decontam.Scanner(items, 10)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - start)
"""
    kb = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert kb * 1024 < 500 * 400_000


def test_quality(docs, rows):
    trusted = docs.select("doc_id").where("doc_id % 3 = 0")
    got = quality.quality_rules(docs.withColumn("kept", F.lit("clash")), trusted).collect()
    want = Counter()
    for d, t in rows:
        w = words(t)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want[d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)] += 1
    assert Counter((r.doc_id, int(r.n_words), r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    # the model against a direct count, equal texts once
    w = [quality._buckets(quality.Words([(t or "").encode()], quality.space_lut_cased()).hash) for _, t in rows]
    ids = {t or "": {d for d, x in rows if (x or "") == (t or "")} for _, t in rows}
    known = [any(d is not None and d % 3 == 0 for d in ids[t or ""]) for _, t in rows]
    first = [d == min(ids[t or ""], key=lambda x: (x is None, x or 0)) for d, t in rows]
    model = np.array([sum(np.bincount(h, minlength=1 << 16) * one for h, one in zip(w, first, strict=True)), sum(np.bincount(h, minlength=1 << 16) * k * one for h, k, one in zip(w, known, first, strict=True))])
    want_llr = Counter()
    for (d, _), h, k in zip(rows, w, known, strict=True):
        own = np.bincount(h, minlength=1 << 16)
        raw = (model[0] - own + 5) / (model[0].sum() - own.sum() + 5 * 65536)
        t = (model[1] - own * k + 327680 * raw) / (model[1].sum() - own.sum() * k + 327680)
        want_llr[d, round(float((np.log(t) - np.log(raw))[h].mean()), 6) + 0.0 if len(h) else 0.0] += 1
    assert Counter((r.doc_id, round(r.llr, 6) + 0.0) for r in got) == want_llr
    assert all(r.kept == (not r.base_failed and r.llr >= -0.08) for r in got)


def test_quality_of_a_document_does_not_hang_on_the_size_of_the_target(spark):
    """Few labels or many: clean documents stay, those with none of the target's words go."""
    rng = np.random.default_rng(3)
    text = lambda a, b: " ".join(f"w{x}" for x in rng.integers(a, b, 300))
    rows = [(i, text(0, 400)) for i in range(3000)] + [(i, text(5000, 5400)) for i in range(3000, 3200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for labels in (500, 2500):
        got = quality.quality_rules(df, df.select("doc_id").where(f"doc_id < {labels}")).collect()
        assert all(r.kept for r in got if r.doc_id < 3000) and not any(r.kept for r in got if r.doc_id >= 3000)
