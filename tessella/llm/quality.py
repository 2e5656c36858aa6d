"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Words and word pairs are hashed into buckets; two multinomials, one of the
trusted documents and one of all documents, are counted over every text, equal
texts once.  The target is shrunk towards the raw corpus, so the ratio of a
bucket is as far from 1 as the target has evidence for, and one fixed
threshold serves targets of any size.  A document's score is the mean log
ratio of its n-grams, with its own text left out of both counts, so that
documents inside and outside the trusted set are measured alike.  Simple
counts of words, symbols, lines and repeats stand beside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U, Words, chunks, ngrams, space_lut_cased

#: Buckets that n-grams are hashed into; the model is two counts for each, whatever the corpus.
BUCKET_BITS = 16
#: Added to each bucket's count in the raw corpus; n-grams of the raw corpus that the target is taken to hold besides its own.
PRIOR, STRENGTH = 5.0, 327_680.0
#: A document whose mean log ratio is lower is rejected.
THRESHOLD = -0.08

NEW = {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "llr": "double", "base_failed": "boolean", "kept": "boolean"}
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def _buckets(h: np.ndarray) -> np.ndarray:
    both = np.concatenate([h, ngrams(h, 2)]) if len(h) > 1 else h
    return (both >> U(64 - BUCKET_BITS)).astype(np.int64)


def _counts(texts: DataFrame) -> DataFrame:
    """bucket, target, n: n-grams of a task's texts, at most one row a bucket, kind and task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BUCKET_BITS), dtype=np.int64)
        for batch in it:
            trusted = batch.column(1).to_pylist()
            for first, part in chunks(batch.column(0)):
                w = Words(part, space_lut_cased())
                found: tuple[list, list] = ([], [])
                for i, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True), first):
                    found[bool(trusted[i])].append(_buckets(w.hash[a:b]))
                for kind in (0, 1):
                    if found[kind]:
                        total[kind] += np.bincount(np.concatenate(found[kind]), minlength=1 << BUCKET_BITS)
        for kind in (0, 1):
            at = np.flatnonzero(total[kind])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), kind, dtype=np.int32)), pa.array(total[kind][at])], ["bucket", "target", "n"])

    return texts.mapInArrow(run, "bucket bigint, target int, n bigint").groupBy("bucket", "target").agg(F.sum("n").alias("n"))


def _marked(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """docs with booleans __trusted (whether a row of the same text is trusted) and __once (whether its text is counted by this row).

    Only rows whose text may occur again are shuffled.  Null texts are as
    empty ones; of equal texts the one of the smallest doc_id counts.
    """
    known = trusted.select(F.col("doc_id").alias("__id")).where("__id is not null").distinct().withColumn("__known", F.lit(True))
    if _small(known):
        known = F.broadcast(known)
    src = docs.withColumn("__th", F.xxhash64(F.coalesce("text", F.lit(""))))
    src = src.join(known, docs["doc_id"] == F.col("__id"), "left").drop("__id").withColumn("__known", F.coalesce("__known", F.lit(False)))
    order = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"))
    again = src.groupBy(F.col("__th").alias("__t")).agg(F.count("*").alias("__n"), F.min(order).alias("__first"), F.max("__known").alias("__any")).where("__n > 1").drop("__n")
    again = common.materialize(again, "quality-again")
    src = common.flag_match(src, "__th", again.select("__t"), "__may")
    alone = src.where("not __may").select(*docs.columns, F.col("__known").alias("__trusted"), F.lit(True).alias("__once"))
    both = src.where("__may").join(again, F.col("__th") == F.col("__t"), "left")
    twice = both.select(*docs.columns, F.coalesce("__any", "__known").alias("__trusted"), F.coalesce(F.col("doc_id").eqNullSafe(F.col("__first.id")), F.lit(True)).alias("__once"))
    return alone.union(twice)


def fit(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """Counts of each bucket: row 0 in all documents, row 1 in trusted ones.

    trusted: doc_id of the target documents.  Counts cover every whole text,
    equal texts once (repeated rows as often as they occur).
    """
    return _fit(_marked(docs.select("doc_id", "text").where("text is not null"), trusted))


def _fit(marked: DataFrame) -> np.ndarray:
    model = np.zeros((2, 1 << BUCKET_BITS))
    for r in _counts(marked.where("__once and text is not null").select("text", "__trusted")).collect():  # 2 x 2^BUCKET_BITS rows at most
        model[r.target, r.bucket] = r.n
    model[0] += model[1]
    return model


def log_ratio(model: np.ndarray, buckets: np.ndarray, trusted: bool) -> float:
    """Mean log ratio of the n-grams of a document, without the document itself in the counts."""
    if not len(buckets) or not model[1].any():
        return 0.0
    u, own = np.unique(buckets, return_counts=True)
    raw = (model[0, u] - own + PRIOR) / (model[0].sum() - len(buckets) + PRIOR * model.shape[1])
    target = (model[1, u] - own * trusted + STRENGTH * raw) / (model[1].sum() - len(buckets) * trusted + STRENGTH)
    return round(float((np.log(target / raw) * own).sum() / len(buckets)), 9)


def _small(ids: DataFrame, limit: int = 1_000_000) -> bool:
    """Whether the ids are few enough to broadcast: 16 MB at most."""
    return ids.limit(limit + 1).count() <= limit


def features(words: Words, i: int, n: int = 3) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of text i."""
    a, b = int(words.first[i]), int(words.first[i + 1])
    lo, hi = int(words.base[i]), int(words.base[i + 1]) - 1
    raw = words.buf[lo:hi]
    body = raw[(raw & 0xC0) != 0x80]
    spaces = int(((body == 32) | ((body >= 9) & (body <= 13))).sum())
    h = words.hash[a:b]
    repeat = 0
    if b - a >= n:
        g = ngrams(h, n)
        _, inv, count = np.unique(g, return_inverse=True, return_counts=True)
        again = count[inv] > 1
        if again.any():
            cover = np.zeros(b - a + 1, dtype=np.int64)
            cover[: len(g)] += again
            cover[n:] -= again[: b - a + 1 - n]
            repeat = int((np.cumsum(cover[:-1]) > 0).sum())
    dup = 0
    if (raw == 10).any():
        seen = set()
        for line in raw.tobytes().split(b"\n"):
            if line.strip(b" \t\n\r\x0b\x0c"):
                dup += line in seen
                seen.add(line)
    return b - a, len(body) - spaces, int(_SYMBOLS[raw].sum()), dup, repeat


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Scores every whole text and says which documents are kept.

    docs: doc_id, text and other columns; trusted: doc_id of target documents.
    Returns the input rows with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, llr (mean log ratio of words and word pairs, 0 without
    words), base_failed (under 50 words, or over half of the words in 3-word
    windows that repeat) and kept (not base_failed, and llr at least the
    threshold).  A null text has no words and is not kept.  Columns of these
    names are replaced.  Repeated rows get equal results; an empty table
    gives no rows; with no trusted documents the base rules alone decide.
    """
    kept = [c for c in docs.columns if c not in NEW]
    marked = _marked(docs.select(*kept), trusted)
    model = _fit(marked)
    load = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*kept).withColumns({c: F.lit(None).cast(t) for c, t in NEW.items()}).schema
    at = kept.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load.value
        for batch in it:
            flags = batch.column(len(kept)).to_pylist()
            for first, part in chunks(batch.column(at)):
                w = Words(part, space_lut_cased())
                rows = []
                for i in range(len(part)):
                    f = features(w, i)
                    b = _buckets(w.hash[w.first[i] : w.first[i + 1]])
                    llr = log_ratio(table, b, flags[first + i])
                    failed = f[0] < 50 or 100 * f[4] > 50 * f[0]
                    rows.append((*f, llr, failed, not failed and llr >= threshold))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*batch.slice(first, len(part)).columns[: len(kept)], *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.float64()), *(pa.array(c, pa.bool_()) for c in cols[6:])], [*kept, *NEW])

    return marked.select(*kept, "__trusted").mapInArrow(run, schema)
