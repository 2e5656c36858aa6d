"""Document fingerprints as invertible Bloom lookup tables of paragraphs.

A document is the multiset of its paragraphs: lines, long ones cut behind
words that a hash picks, so that cuts stay where they are when the text around
them changes.  Each paragraph's digest is added to three cells of a table; a
cell holds how many digests fell on it, their sum and the sum of their checks.
Tables of two versions subtract cell by cell, which leaves the digests that
only one of them has; cells with a single one give it away, and taking it out
of its other cells frees more, until nothing is left.  What doesn't come out
is tried again with twice the cells and other places.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U, mix

#: Cells of a fingerprint, a multiple of PLACES; places of a digest.
CELLS, PLACES = 24, 3
#: Words between two cuts of a long line, on average.
CUT = 8
#: Cells of many documents that are in memory at a time.
MANY = 1 << 20
#: Blocks of doc_ids that follow each other: at most so many bounds are worked out.
BLOCKS = 8192

AGAIN = U(0xD6E8FEB86659FD93)
CHECK = U(0xA24BAED4963EE407)


class Paragraphs(NamedTuple):
    """Digests of many documents; those of document i are keys[first[i]:first[i + 1]]."""

    keys: np.ndarray
    first: np.ndarray

    def of(self, rows: np.ndarray) -> Paragraphs:
        size = self.first[rows + 1] - self.first[rows]
        first = np.concatenate([[0], np.cumsum(size)])
        return Paragraphs(self.keys[np.arange(first[-1]) + np.repeat(self.first[rows] - first[:-1], size)], first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def paragraphs(texts: list[bytes]) -> Paragraphs:
    """Digests of the paragraphs of texts; equal ones of a text are told apart by their number.

    Words count as they are, the white space between them doesn't.
    """
    w = common.Words(texts, common.space_lut_cased())
    n = len(w.hash)
    if not n:
        return Paragraphs(w.hash, np.zeros(len(texts) + 1, dtype=np.int64))
    text = np.repeat(np.arange(len(texts)), np.diff(w.first))
    line = np.cumsum(w.buf == 10)[w.start]
    begins = np.ones(n, dtype=bool)
    begins[1:] = (text[1:] != text[:-1]) | (line[1:] != line[:-1]) | (w.hash[:-1] % U(CUT) == 0)
    at = np.flatnonzero(begins)
    size = np.diff(np.append(at, n))
    place = np.arange(n) - np.repeat(at, size)
    h = mix(np.add.reduceat(w.hash * common._powers(int(size.max()) + 1)[place], at) + U(11) * size.astype(U))
    owner = text[at]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    run = np.flatnonzero(new)
    number = np.arange(len(h)) - np.repeat(run, np.diff(np.append(run, len(h))))
    return Paragraphs(mix(h + AGAIN * number.astype(U)), np.searchsorted(owner, np.arange(len(texts) + 1)))


# ---------------------------------------------------------------- tables


class Tables(NamedTuple):
    """Lookup tables of many documents, a row each."""

    count: np.ndarray
    keys: np.ndarray
    check: np.ndarray

    def __sub__(self, other: Tables) -> Tables:
        return Tables(self.count - other.count, self.keys - other.keys, self.check - other.check)


def _check(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ CHECK)


def _places(keys: np.ndarray, cells: int, attempt: int) -> list[np.ndarray]:
    part = cells // PLACES
    return [j * part + (mix(keys + U((PLACES * attempt + j + 1) * int(common.BASE) % 2**64)) % U(part)).astype(np.int64) for j in range(PLACES)]


def _add(t: Tables, owner: np.ndarray, keys: np.ndarray, sign: np.ndarray, attempt: int) -> None:
    """Adds digests (sign 1) to tables, or takes them out (-1)."""
    cells = t.count.shape[1]
    s = sign.astype(np.int64).view(U)
    k, c = keys * s, _check(keys) * s
    for place in _places(keys, cells, attempt):
        i = owner * cells + place
        np.add.at(t.count.ravel(), i, sign)
        np.add.at(t.keys.ravel(), i, k)
        np.add.at(t.check.ravel(), i, c)


def tables(p: Paragraphs, cells: int = CELLS, attempt: int = 0) -> Tables:
    shape = (len(p.first) - 1, cells)
    t = Tables(np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=U), np.zeros(shape, dtype=U))
    _add(t, p.owner(), p.keys, np.ones(len(p.keys), dtype=np.int64), attempt)
    return t


def peel(t: Tables, attempt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """owner, key and sign of the digests that come out of tables, which this empties, and which tables are empty then."""
    cells = t.count.shape[1]
    found = []
    while True:
        one = np.flatnonzero(np.abs(t.count.ravel()) == 1)
        sign = t.count.ravel()[one]
        s = sign.view(U)
        keys = t.keys.ravel()[one] * s
        pure = t.check.ravel()[one] == _check(keys) * s
        owner, keys, sign = one[pure] // cells, keys[pure], sign[pure]
        if not len(keys):
            break
        # a digest may stand alone in several of its cells
        order = np.lexsort((keys, owner))
        owner, keys, sign = owner[order], keys[order], sign[order]
        first = np.ones(len(keys), dtype=bool)
        first[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        owner, keys, sign = owner[first], keys[first], sign[first]
        _add(t, owner, keys, -sign, attempt)
        found.append((owner, keys, sign))
    empty = ~(t.count.any(axis=1) | t.keys.any(axis=1) | t.check.any(axis=1))
    if not found:
        z = np.empty(0, dtype=np.int64)
        return z, z.view(U), z, empty
    return *(np.concatenate(x) for x in zip(*found, strict=True)), empty


def differences(a: Paragraphs, b: Paragraphs, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """owner, key and sign (1: only a has it, -1: only b) of all differing digests, and the cells that each pair took.

    Tables that don't come out are made anew with twice the cells; the number
    of cells has no bound, so every pair comes out.
    """
    todo, attempt = np.arange(len(a.first) - 1), 0
    took = np.zeros(len(todo), dtype=np.int64)
    out = []
    while len(todo):
        left = []
        step = max(1, MANY // cells)
        for rows in (todo[i : i + step] for i in range(0, len(todo), step)):
            owner, keys, sign, empty = peel(tables(a.of(rows), cells, attempt) - tables(b.of(rows), cells, attempt), attempt)
            took[rows[empty]] = cells
            keep = empty[owner]
            out.append((rows[owner[keep]], keys[keep], sign[keep]))
            left.append(rows[~empty])
        todo, attempt, cells = np.concatenate(left), attempt + 1, 2 * cells
    return *(np.concatenate(x) for x in zip(*out, strict=True)), took


def likeness(a: Paragraphs, b: Paragraphs) -> np.ndarray:
    """Paragraphs in common over all paragraphs of both, by what their tables give away; 1 for two without any."""
    owner, _, sign, _ = differences(a, b)
    na, nb = np.diff(a.first), np.diff(b.first)
    only_a = np.bincount(owner[sign > 0], minlength=len(na))
    only_b = np.bincount(owner[sign < 0], minlength=len(nb))
    whole = na + only_b
    return np.where(whole > 0, (na - only_a) / np.maximum(whole, 1), 1.0)


def written(p: Paragraphs) -> list[str]:
    """Fingerprints as text: number of paragraphs, `:`, and the cells in base64, 4 + 8 + 8 bytes each."""
    t = tables(p)
    cells = np.concatenate([t.count.astype("<u4")[..., None].view(np.uint8), t.keys.astype("<u8")[..., None].view(np.uint8), t.check.astype("<u8")[..., None].view(np.uint8)], axis=2)
    return [f"{n}:{base64.b64encode(row.tobytes()).decode()}" for n, row in zip(np.diff(p.first).tolist(), cells, strict=True)]


def read(fingerprints: list[str]) -> Tables:
    """The tables of written fingerprints."""
    raw = np.stack([np.frombuffer(base64.b64decode(f.split(":")[1]), dtype=np.uint8).reshape(CELLS, 20) for f in fingerprints])
    part = lambda lo, hi, kind: np.ascontiguousarray(raw[..., lo:hi]).view(kind)[..., 0]
    return Tables(part(0, 4, "<u4").astype(np.int64), part(4, 12, "<u8").astype(U), part(12, 20, "<u8").astype(U))


# ---------------------------------------------------------------- versions of documents


def edited(text: str, other: str) -> str:
    """text with the last half of its code points replaced by the first as many of another."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _rows(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Results of all texts but the last, each with the one behind it."""
    ids, new = ids[:-1], [edited(t, o) for t, o in zip(texts, texts[1:], strict=False)]
    new_bytes = [x.encode() for x in new]
    own, e = paragraphs([x.encode() for x in texts]), paragraphs(new_bytes)
    n = len(ids)
    this, following = own.of(np.arange(n)), own.of(np.arange(1, n + 1))
    cols = [ids, [len(t) for t in texts[:-1]], [sha256(x).hexdigest() for x in new_bytes], written(this), written(e), likeness(this, e), likeness(this, following)]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in order, block by block; behind a block stands the document that follows it."""
    ids: list = []
    texts: list[str] = []
    size, now, ended = 0, None, False
    for b in batches:
        for block, ahead, doc, text in zip(*(b.column(k).to_pylist() for k in ("block", "ahead", "doc_id", "text")), strict=True):
            if block != now:
                now, ended, ids, texts, size = block, False, [], [], 0
            if ended:
                continue
            ids.append(doc)
            texts.append(text)
            size += len(text)
            ended = ahead
            if len(ids) > 1 and (ahead or size >= common.CHUNK_BYTES):
                yield _rows(ids, texts)
                ids, texts, size = ids[-1:], texts[-1:], len(text)


def _count_up_to(bounds: list[int], x: Column) -> Column:
    """How many of the ascending bounds are at most x, by halving; none for null."""
    if not bounds:
        return F.lit(0)
    table = F.expr(f"array({','.join(f'{v}L' for v in bounds)})")
    top = len(bounds).bit_length() - 1
    steps = F.array(*(F.lit(1 << k) for k in range(top, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(table, at + s - 1) <= x, at + s).otherwise(at))


def versions(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text: the columns of SCHEMA.

    The edited text is the text with its last half replaced by the beginning
    of the next document's, in order of doc_id (null first, equal ones by
    text), behind the last the first.  near_edited and near_next compare the
    document with its edited text and with the next document.  Null texts are
    empty; an empty text has no paragraphs and likeness 1 with another;
    repeated rows are documents of their own; an empty table gives no rows;
    other columns are ignored.  Documents go once to blocks of doc_ids that
    follow each other, about four for each partition and at most BLOCKS; the
    first of a block is also sent to the block before.
    """
    parts = common.partitions(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = min(BLOCKS, 4 * parts)
    cuts = [k / blocks for k in range(1, blocks)]
    said = d.agg(F.percentile_approx("doc_id", cuts, 100 * blocks).alias("cuts"), F.min("doc_id").alias("low"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    bounds = sorted({x for x in said["cuts"] or () if x > said["low"]})
    block = _count_up_to(bounds, F.col("doc_id"))
    start = F.lit(None if said["nulls"] else said["low"]).cast("bigint")
    table = F.expr(f"array({','.join(f'{v}L' for v in bounds)})") if bounds else F.array().cast("array<bigint>")
    d = d.withColumn("own", block)
    leads = F.when(F.col("own") == 0, F.col("doc_id").eqNullSafe(start)).otherwise(F.col("doc_id") == F.get(table, F.col("own") - 1))
    before = F.when(F.col("own") == 0, F.lit(len(bounds))).otherwise(F.col("own") - 1)
    here = F.struct(F.col("own").alias("block"), F.lit(False).alias("ahead"))
    there = F.struct(before.alias("block"), F.lit(True).alias("ahead"))
    sent = d.select("doc_id", "text", F.explode(F.when(leads, F.array(here, there)).otherwise(F.array(here))).alias("to")).select("to.block", "to.ahead", "doc_id", "text")
    dealt = sent.repartition(parts, "block").sortWithinPartitions(F.col("block"), F.col("ahead"), F.col("doc_id").asc_nulls_first(), F.col("text"))
    return dealt.mapInArrow(_along, SCHEMA)
