"""Toxicity: a convolutional text classifier with hashed word embeddings, trained in numpy.

A word is the sum of the embeddings of its hash and of the hashes of its first
bytes.  Filters of several widths slide over the words of a whole text, the
largest response of each filter is kept (max pooling), and a logistic layer
turns these into a score.  Training takes a bounded sample of labelled rows;
scoring runs over all documents.  Thresholds are calibrated by language on
labelled rows that training did not take.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import BYTE_CODE, U, Words, _powers, alnum_lut, chunks, mix

#: Labelled rows of each class that training takes, by the order of a hash of doc_id; longer texts than this many words are left out of the sample.
SAMPLE_ROWS, SAMPLE_WORDS = 2000, 4000
#: Hash slots of the embedding, embedding rows, dimensions, filters of each width.
SLOT_BITS, ROWS, DIM, FILTERS = 20, 1 << 16, 8, 8
WIDTHS = (1, 2, 3)
PREFIXES = (4, 5, 6, 7, 8)
EPOCHS, BATCH, RATE = 6, 64, 0.02


def word_features(w: Words) -> np.ndarray:
    """Hashes of each word and of its first bytes: array (1 + len(PREFIXES), words); 0 where a word is too short."""
    lens = w.end - w.start
    out = np.zeros((1 + len(PREFIXES), len(lens)), dtype=U)
    if not len(lens):
        return out
    out[0] = w.hash
    lut = alnum_lut()
    for k, p in enumerate(PREFIXES, 1):
        long = np.flatnonzero(lens >= p)
        at = w.start[long][:, None] + np.arange(p)
        out[k, long] = mix((BYTE_CODE[lut[w.buf[at]]] * _powers(16)[:p]).sum(axis=1, dtype=U) + U(1000 + p))
    return out


class Model:
    """Parameters only: arrays of fixed size."""

    def __init__(self):
        r = np.random.default_rng(7)
        self.guard = np.zeros(1 << SLOT_BITS, dtype=np.uint32)
        self.row = np.zeros(1 << SLOT_BITS, dtype=np.int32)
        self.E = np.zeros((1, DIM), dtype=np.float32)
        self.W = [(r.normal(0, 0.1, (k, DIM, FILTERS))).astype(np.float32) for k in WIDTHS]
        self.b = [np.full(FILTERS, -0.05, dtype=np.float32) for _ in WIDTHS]
        self.v = (r.normal(0, 0.1, FILTERS * len(WIDTHS))).astype(np.float32)
        self.c = np.float32(-2.0)

    def rows(self, feats: np.ndarray) -> np.ndarray:
        """Embedding rows of feature hashes; row 0 is the zero vector of all that training did not see."""
        slot = (feats >> U(64 - SLOT_BITS)).astype(np.int64)
        known = self.guard[slot] == (feats & U(0xFFFFFFFF)).astype(np.uint32)
        return np.where(known & (feats != 0), self.row[slot], 0)

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        x = self.E[rows[0]]
        for r in rows[1:]:
            x = x + self.E[r]
        return x

    def respond(self, x: np.ndarray, k: int) -> np.ndarray:
        """Responses of the filters of one width at each start; x is padded by width - 1 zero vectors behind."""
        w, n = self.W[k], len(x) - WIDTHS[k] + 1
        y = x[:n] @ w[0]
        for j in range(1, WIDTHS[k]):
            y += x[j : j + n] @ w[j]
        return y + self.b[k]

    def pool(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        pad = np.concatenate([x, np.zeros((max(WIDTHS) - 1, DIM), dtype=np.float32)])
        top, where = [], []
        for k, width in enumerate(WIDTHS):
            y = self.respond(pad[: len(x) + width - 1], k) if len(x) else np.zeros((1, FILTERS), dtype=np.float32)
            i = y.argmax(axis=0)
            where.append(i)
            top.append(np.maximum(y[i, np.arange(FILTERS)], 0))
        return np.concatenate(top), where

    def score(self, rows: np.ndarray) -> float:
        x = self.vectors(rows) if rows.shape[1] else np.zeros((0, DIM), dtype=np.float32)
        z = float(self.pool(x)[0] @ self.v + self.c)
        return round(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))), 6)


def _features(text: bytes) -> np.ndarray:
    return word_features(Words([text], alnum_lut()))


def train(texts: list[bytes], labels: list[int], weights: list[float]) -> Model:
    """Fits the model to a bounded list of texts; they are held as embedding rows, four bytes a feature."""
    m = Model()
    y = np.array(labels, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        m.v[:] = 0
        m.c = np.float32(2.0 if len(y) and y.min() == 1 else -3.0)
        return m
    # evidence of each hash: a lower bound of its log odds, from how many texts of each class hold it
    seen = [np.unique(_features(t)) for t in texts]
    pos = np.unique(np.concatenate([s[s != 0] for s, v in zip(seen, y, strict=True) if v]), return_counts=True)
    neg = np.unique(np.concatenate([s[s != 0] for s, v in zip(seen, y, strict=True) if not v]), return_counts=True)
    del seen
    allh = np.union1d(pos[0], neg[0])
    a, b = np.zeros(len(allh)), np.zeros(len(allh))
    a[np.searchsorted(allh, pos[0])] = pos[1]
    b[np.searchsorted(allh, neg[0])] = neg[1]
    na, nb = y.sum(), len(y) - y.sum()
    odds = np.log((a + 0.5) / (na + 1)) - np.log((b + 0.5) / (nb + 1))
    sure = np.sign(odds) * np.maximum(0, np.abs(odds) - 1.5 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)))
    keep = np.flatnonzero(a + b >= 3)
    keep = keep[np.lexsort((allh[keep], -(a + b)[keep], -np.abs(sure[keep])))][: ROWS - 1]
    m.E = np.zeros((len(keep) + 1, DIM), dtype=np.float32)
    m.E[1:] = np.random.default_rng(11).normal(0, 0.02, (len(keep), DIM))
    m.E[1:, 0] = 0.5 * np.clip(sure[keep], -1, 4)
    for r, h in zip(range(len(keep), 0, -1), keep[::-1], strict=True):  # stronger evidence overwrites
        s = int(allh[h]) >> (64 - SLOT_BITS)
        m.guard[s], m.row[s] = int(allh[h]) & 0xFFFFFFFF, r
    for k in range(len(WIDTHS)):
        m.W[k][:, 0, :4] += 0.5
        m.b[k][:4] -= 0.4
    m.v[:] = np.abs(m.v)
    rows = [m.rows(_features(t)).astype(np.int32) for t in texts]
    wts = np.array(weights, dtype=np.float32)
    names = ["E", "v"] + [("W", k) for k in range(len(WIDTHS))] + [("b", k) for k in range(len(WIDTHS))]
    get = lambda n: getattr(m, n) if isinstance(n, str) else getattr(m, n[0])[n[1]]
    mom = {n: (np.zeros_like(get(n)), np.zeros_like(get(n))) for n in names}
    mc, vc, step = 0.0, 0.0, 0
    order = np.random.default_rng(3)
    for _ in range(EPOCHS):
        perm = order.permutation(len(y))
        for lo in range(0, len(perm), BATCH):
            g = {n: np.zeros_like(get(n)) for n in names}
            gc = 0.0
            batch = perm[lo : lo + BATCH]
            for i in batch:
                x = m.vectors(rows[i]) if rows[i].shape[1] else np.zeros((0, DIM), dtype=np.float32)
                top, where = m.pool(x)
                p = 1 / (1 + np.exp(-(top @ m.v + m.c)))
                d = float((p - y[i]) * wts[i])
                gc += d
                g["v"] += d * top
                dt = d * m.v * (top > 0)
                for k, width in enumerate(WIDTHS):
                    dk = dt[k * FILTERS : (k + 1) * FILTERS]
                    g["b", k] += dk
                    for f in np.flatnonzero(dk):
                        at = where[k][f]
                        for j in range(width):
                            if at + j < len(x):
                                g["W", k][j, :, f] += dk[f] * x[at + j]
                                np.add.at(g["E"], rows[i][:, at + j], dk[f] * m.W[k][j, :, f])
            g["E"][0] = 0
            step += 1
            for n in names:
                p = get(n)
                grad = g[n] / len(batch) + (1e-4 * p if n != "E" else 0)
                m1, m2 = mom[n]
                m1 += 0.1 * (grad - m1)
                m2 += 0.01 * (grad * grad - m2)
                p -= (RATE if n != "E" else RATE / 4) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
            m.E[0] = 0
            gc /= len(batch)
            mc += 0.1 * (gc - mc)
            vc += 0.01 * (gc * gc - vc)
            m.c = np.float32(m.c - RATE * (mc / (1 - 0.9**step)) / (np.sqrt(vc / (1 - 0.99**step)) + 1e-6))
    return m


def _held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _calibrating(doc_id):
    """A quarter of the labelled rows, by hash: thresholds are set on them, the model never learns from them."""
    return F.pmod(F.xxhash64(doc_id.cast("bigint"), F.lit("calibrate")), F.lit(4)) == 0


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> list:
    """At most 2 x rows labelled texts (bytes, label, weight, doc_id), from rows that are neither held out nor kept for calibration.

    The ids are drawn from the labels first (the smallest hashes of each
    class), so one scan of the documents with a broadcast of those ids suffices.
    """
    lab = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~_held_out(F.col("doc_id")) & ~_calibrating(F.col("doc_id")))
    share = {r.toxic: r["count"] for r in lab.groupBy("toxic").count().collect()}
    picked = None
    for y in (0, 1):
        part = lab.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        picked = part if picked is None else picked.union(part)
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in picked.select("doc_id", "toxic").collect()], "doc_id bigint, toxic int")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keep = []
            for first, part in chunks(batch.column(1)):
                n = np.diff(Words(part, alnum_lut()).first)
                keep += [first + i for i in np.flatnonzero(n <= SAMPLE_WORDS).tolist()]
            yield batch.take(pa.array(keep, pa.int64()))

    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null").join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic")
    # repeated rows of a document count once; of several texts of one doc_id the one with the smallest hash
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "toxic")).alias("x")
    got = src.mapInArrow(run, src.schema).groupBy("doc_id").agg(one).select("doc_id", "x.text", "x.toxic").collect()
    got.sort(key=lambda r: r.doc_id)
    n = {y: sum(r.toxic == y for r in got) for y in (0, 1)}
    total = sum(share.values()) or 1
    return [(r.text.encode(), r.toxic, share.get(r.toxic, 0) / total * len(got) / n[r.toxic], r.doc_id) for r in got]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[Model, list[int]]:
    """The model and the doc_ids that it has learned from, 2 x rows at most."""
    s = training_sample(docs, labels, rows)
    return train([x[0] for x in s], [x[1] for x in s], [x[2] ** 0.5 for x in s]), [x[3] for x in s]


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Input rows and columns plus score (0 to 1) of every whole text; null and empty texts get the score of no words."""
    load = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != "score"]
    at = kept.index("text")
    src = docs.select(*kept)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load.value
        for batch in it:
            for first, part in chunks(batch.column(at)):
                w = Words(part, alnum_lut())
                rows = m.rows(word_features(w))
                out = [m.score(rows[:, a:b]) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(part)).columns, pa.array(out, pa.float64())], [*kept, "score"])

    return src.mapInArrow(run, src.withColumn("score", F.lit(0.0)).schema)


def calibrate(scored: DataFrame, labels: DataFrame, learned: list[int] = (), precision: float = 0.9, default: float = 0.3, least: int = 5) -> DataFrame:
    """lang, threshold: the lowest step of 1/50 at which labelled rows reach the precision, with least rows or more above it.

    Rows that are held out and those that the model has learned from take no
    part.  A language where no step does, or without labelled rows, gets the
    default; a null language is one of its own.
    """
    lab = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~_held_out(F.col("doc_id")))
    if learned:
        ids = scored.sparkSession.createDataFrame([(i,) for i in learned], "doc_id bigint")
        lab = lab.join(F.broadcast(ids), "doc_id", "left_anti")
    have = scored.select("doc_id", "lang", "score").join(lab, "doc_id").groupBy("lang", F.least(F.floor(F.col("score") * 50), F.lit(49)).alias("bin")).agg(F.sum("toxic").alias("hit"), F.count("*").alias("n"))
    steps = have.select("lang", "hit", "n", F.explode(F.sequence(F.lit(0), F.col("bin"))).alias("step")).groupBy("lang", "step").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n"))
    best = steps.where((F.col("hit") >= precision * F.col("n")) & (F.col("n") >= least)).groupBy("lang").agg((F.min("step") / 50).alias("threshold")).withColumnRenamed("lang", "__lang")
    langs = scored.select("lang").distinct()
    return langs.join(best, F.col("lang").eqNullSafe(F.col("__lang")), "left").select("lang", F.coalesce("threshold", F.lit(default)).alias("threshold"))


def report(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, lang_threshold, lang_predicted for every row.

    The model learns from labels of rows that are not held out only; score
    depends on the text alone, so rows with equal texts, null ones being
    empty, get equal scores.  predicted is the verdict at 0.3, lang_predicted
    that at the threshold calibrated for the row's language, on a quarter of
    the labelled rows that the model doesn't learn from.  Rows with a null
    doc_id are not held out.  Repeated rows stay; other columns, whatever
    their names, are ignored; an empty table gives no rows.  Without labels of
    both classes every score is the same.
    """
    model, learned = fit(docs, labels, rows)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    scored = score_documents(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), lang.alias("lang"), "text"), model).select("doc_id", "lang", "score")
    scored = common.materialize(scored, "toxicity-scores")
    limits = calibrate(scored, labels.where(_calibrating(F.col("doc_id"))), learned).withColumnRenamed("lang", "__lang")
    both = scored.join(limits, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    return both.select(
        "doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
        F.col("threshold").alias("lang_threshold"), (F.col("score") >= F.col("threshold")).cast("int").alias("lang_predicted"),
    )
