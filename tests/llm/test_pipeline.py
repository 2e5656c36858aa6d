"""The pipeline's rows against its stages worked out by hand."""

import re

import numpy as np

import corpus_pipeline
from tessella.llm import bpe, decontam, jaccard, pii, quality

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    import public_tokenizers as P
    import tiktoken

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    trusted = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    src = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality.quality_rules(src, trusted).where("kept").collect()}
    left = [d for d in docs if d.doc_id in kept]
    sets = {}
    for d in left:
        w = d.text.encode().lower().split()
        sets[d.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    f = {d: d for d in sets}

    def find(x):
        while f[x] != x:
            x = f[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and sets[a] and sets[b]:
                o = len(sets[a] & sets[b])
                if 10 * o >= 8 * (len(sets[a]) + len(sets[b]) - o):
                    x, y = sorted((find(a), find(b)))
                    f[y] = x
    left = [d for d in left if find(d.doc_id) == d.doc_id]
    items = [(r.item_id, decontam.words(r.text.encode())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    scan = decontam.Scanner(items, 10)
    left = [d for d in left if not scan.scan(decontam.words(d.text.encode()))[1]]
    path = P.path("byte_bpe_multi_50k.tiktoken")
    tok = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    found = {r.doc_id: r for r in pii.find_pii(src).collect()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == {d.doc_id for d in left}
    assert all(got[d.doc_id].lang == d.lang and got[d.doc_id].n_tokens == len(got[d.doc_id].ids) for d in left)
    changed = 0
    for d in left:
        text = tok.decode(got[d.doc_id].ids)
        r = found[d.doc_id]
        if not any((r.email, r.ip, r.card, r.phone)):
            assert text == d.text
        else:
            changed += 1
            assert len(re.findall("<(?:EMAIL|IP|CARD|PHONE)>", text)) >= 1
            assert tok.encode_ordinary(text) == list(got[d.doc_id].ids)
    assert changed or not any(r.email for r in found.values())
    assert len(left) > 0.5 * len(docs)


def test_drop_near_copies_edges(spark):
    t = "a b c d e f g h i j k l m n o p"
    rows = [(5, t, "x"), (5, t, "x"), (2, t + " q", "y"), (None, t, "z"), (7, None, "e"), (7, None, "e"), (None, "", "e"), (9, "solo words in here", "k"), (None, "only a null id", "k"), (None, "only a null id", "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_shingles string").repartition(3)
    got = sorted((tuple(r) for r in jaccard.drop_near_copies(df).collect()), key=str)
    assert got == sorted([(2, t + " q", "y"), (7, None, "e"), (7, None, "e"), (None, "", "e"), (9, "solo words in here", "k"), (None, "only a null id", "k")], key=str)
    assert np.array([len(r) == 3 for r in got]).all()


def test_stages_with_nulls_repeats_and_clashing_columns(spark):
    words = lambda k: " ".join(f"w{(k * 37 + i * 11) % 400}x{k}" if i % 2 else f"a{i}" for i in range(80))
    rows = [(i, words(i), f"own {i}", 7.5, i) for i in range(20)]
    rows += [(3, words(3), "own 3", 7.5, 3), (None, words(90) + " +49 30 1234567", "null id", None, None), (91, None, "null text", 1.0, 1), (92, "", "empty", 1.0, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept string, llr double, n_hit bigint").repartition(3)
    trusted = docs.where("doc_id < 10").select("doc_id")
    for df in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, df, SF)
            assert got.schema.simpleString() == docs.schema.simpleString(), name
            out = [tuple(r) for r in got.collect()]
            if df is not docs:
                assert not out
            elif name == "pii":
                assert len(out) == len(rows) and {r[1].split()[-1] for r in out if r[2] == "null id"} == {"<PHONE>"}
            elif name == "ngram_jaccard_join":
                assert sorted(out, key=str) == sorted(set(rows), key=str)
            elif name == "benchmark_decontamination":
                assert sorted(out, key=str) == sorted(rows, key=str)
            else:
                assert set(out) <= set(rows)
    assert quality.quality_rules(docs, trusted).count() == len(rows)
    tokens = corpus_pipeline.token_stage(spark, docs.selectExpr("doc_id", "text", "kept lang", "'s' source"), SF).collect()
    assert len(tokens) == len(rows) and sorted(r.n_tokens for r in tokens)[:3] == [0, 0, sorted(r.n_tokens for r in tokens)[2]]
