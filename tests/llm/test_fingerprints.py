"""Fingerprints against plain multisets of paragraphs."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import common, fingerprints as fp


def plain(text):
    """The paragraphs of a text, cut word by word in Python."""
    out = []
    for line in text.split("\n"):
        piece = []
        for w in line.split():
            piece.append(w)
            if int(common.Words([w.encode()], common.space_lut_cased()).hash[0]) % fp.CUT == 0:
                out.append(tuple(piece))
                piece = []
        if piece:
            out.append(tuple(piece))
    return Counter(out)


def near(a, b):
    x, y = plain(a), plain(b)
    whole = (x | y).total()
    return (x & y).total() / whole if whole else 1.0


def prose(r, n):
    return "".join(r.choice("abcdefgh") * r.randint(1, 2) + r.choice([" "] * 12 + ["\n", "  "]) for _ in range(n))


def expected(rows):
    docs = sorted(((d is not None, d or 0, t or "", d) for d, t, *_ in rows))
    out = []
    for k, (_, _, t, d) in enumerate(docs):
        o = docs[(k + 1) % len(docs)][2]
        e = t[: len(t) - len(t) // 2] + o[: len(t) // 2]
        out.append((d, len(t), sha256(e.encode()).hexdigest(), round(near(t, e), 9), round(near(t, o), 9)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()), key=str)


def sample():
    r = random.Random(5)
    rows = [(i * 7 % 501 - 40, r.choice([prose(r, r.randint(0, 120)), None, "", "ünï 😀 " * 9, "same words here\n" * 20])) for i in range(300)]
    return rows + [(None, "null id"), (None, "another"), (3, "ties"), (3, "ties"), (3, "b"), (10**12, prose(r, 30_000))]


@pytest.mark.parametrize("parts", [1, 5])
def test_versions(spark, parts):
    rows = sample()
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id bigint, text string, block string").repartition(parts)
    assert rows_of(fp.versions(df)) == expected(rows)


def test_versions_of_few(spark):
    for rows in ([], [(5, "just one document")], [(None, None)], [(1, "a b"), (1, "a b")]):
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        assert rows_of(fp.versions(df)) == expected(rows)


def test_equal_texts_have_equal_fingerprints(spark):
    rows = [(i, "one text\nof two lines" if i % 2 else f"text {i}") for i in range(40)]
    got = {r.doc_id: r.fingerprint for r in fp.versions(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len({got[i] for i in range(1, 40, 2)}) == 1 and len(set(got.values())) == 21


def test_peeling_recovers_what_differs():
    r = random.Random(6)
    a = [prose(r, n).encode() for n in (0, 3, 50, 400, 9000)]
    b = [x + b"\nmore " + prose(r, (0, 3, 90, 5, 2000)[k]).encode() for k, x in enumerate(a)]
    p, q = fp.paragraphs(a), fp.paragraphs(b)
    owner, keys, sign, took = fp.differences(p, q)
    for i in range(len(a)):
        x, y = set(p.keys[p.first[i] : p.first[i + 1]].tolist()), set(q.keys[q.first[i] : q.first[i + 1]].tolist())
        assert set(keys[(owner == i) & (sign > 0)].tolist()) == x - y
        assert set(keys[(owner == i) & (sign < 0)].tolist()) == y - x
    # few differences come out of the fingerprints themselves, however long the texts; many need larger tables
    assert took[0] == took[1] == fp.CELLS and took[4] > 4 * fp.CELLS
    few = fp.differences(p, fp.paragraphs([x + b"\nend" for x in a]))
    assert (few[3] == fp.CELLS).all()


def test_written_fingerprints_subtract():
    a, b = ["a b c\nd e f\ng"] * 2, ["a b c\nd e f\ng", "a b c\nx\ng"]
    p, q = (fp.paragraphs([x.encode() for x in t]) for t in (a, b))
    diff = fp.read(fp.written(p)) - fp.read(fp.written(q))
    owner, keys, sign, empty = fp.peel(diff)
    assert empty.all() and set(owner.tolist()) == {1} and sorted(sign.tolist()) == [-1, 1]
    assert set(keys.tolist()) == set(p.keys[p.first[1] :].tolist()) ^ set(q.keys[q.first[1] :].tolist())


def test_near_edited_tells_edits_from_others(spark):
    got = fp.versions(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.length("text") > 400)).collect()
    edits, others = np.array([r.near_edited for r in got]), np.array([r.near_next for r in got])
    assert np.median(edits) > 0.25 and np.median(others) < 0.05 and ((0 <= edits) & (edits <= 1)).all()
