"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, one scan of each text.

Texts and items are normalised alike (A-Z lowered, words of ASCII letters and
digits and of all other characters above 0x7F).  Each distinct item word is
spelled as a few Latin-1 digits, and an automaton holds the items cut into
consecutive pieces of half a window, of which every window of item words
contains one whole: it has at most that few nodes for each item word.  A text is scanned once; where a piece
occurs, the windows around it are looked up among those of the items, and
hits are mapped back to words and to code points of the original text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import U, alnum_lut, mix

#: Item words in one automaton, about 300 bytes each in a worker; more items make several automata, one at a time.
AUTOMATON_WORDS = 500_000
#: Bytes of item text broadcast at once; with more, the texts are passed once for each portion.
PORTION_BYTES = 64_000_000
#: Bytes of text scanned with one automaton before the next is built, where there are several.
GROUP_BYTES = 64_000_000

_lut = alnum_lut()
_TABLE = bytes(int(c) or 32 for c in _lut)
_MULTIPLY = np.random.default_rng(17).integers(1, 2**63, 4096, dtype=np.int64).astype(U) | U(1)
#: What a pattern of the automaton is, beside four times its words.
PIECE, SHORT = 1, 2
NEW = {"n_words": "bigint", "n_hit": "bigint", "items": "array<bigint>", "hits": "array<struct<start:bigint,end:bigint>>"}
STATE = {"__items": "array<bigint>", "__flags": "binary"}


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


def word_spans(raw: bytes) -> np.ndarray:
    """Byte range of each word."""
    inside = np.zeros(len(raw) + 2, dtype=bool)
    inside[1:-1] = _lut[np.frombuffer(raw, dtype=np.uint8)] != 0
    return np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)


class Scanner:
    """An automaton of items, given as (item id, words), and a table of their windows."""

    def __init__(self, items: list[tuple[int, list[bytes]]], size: int):
        self.size, self.piece = size, (size + 1) // 2
        known = dict.fromkeys(x for _, w in items for x in w)
        # a word is a number of some seven-bit digits; the first one has the eighth bit, so patterns begin at words only
        self.width = max(1, -(-len(known).bit_length() // 7))
        digits = lambda k: bytes([k >> 7 * j & 127 | 128 * (j == self.width - 1) for j in range(self.width - 1, -1, -1)]).decode("latin-1")
        self.symbol = {x: digits(k) for k, x in enumerate(known, 1)}
        self.unknown = digits(0)
        spelled = ["".join(map(self.symbol.__getitem__, w)) for _, w in items]
        self.flat = self._codes("".join(spelled))
        lens = np.array([len(w) for _, w in items], dtype=np.int64)
        base = np.cumsum(lens) - lens
        ids = np.array([i for i, _ in items], dtype=np.int64)
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.tables: dict[int, tuple[np.ndarray, ...]] = {}
        for n in np.unique(np.minimum(lens, size)).tolist():
            if not n:
                continue
            mine = np.flatnonzero(np.minimum(lens, size) == n)
            starts = np.concatenate([base[i] + np.arange(lens[i] - n + 1) for i in mine])
            who = np.repeat(ids[mine], lens[mine] - n + 1)
            h = self._hash(self.flat, starts, n)
            order = np.lexsort((who, h))
            h, who, starts = h[order], who[order], starts[order]
            heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            self.tables[n] = (h[heads], starts[heads], np.append(heads, len(h)), who)
            for i in mine.tolist():
                step = self.piece if n == size else n
                for a in range(0, int(lens[i]) - step + 1, step):
                    x = spelled[i][a * self.width : (a + step) * self.width]
                    self.auto.add_word(x, self.auto.get(x, 4 * step) | (PIECE if n == size else SHORT))
        self.any = len(self.auto) > 0
        if self.any:
            self.auto.make_automaton()

    def _codes(self, text: str) -> np.ndarray:
        """The numbers of the words of a spelled text."""
        d = np.frombuffer(text.encode("latin-1"), dtype=np.uint8).reshape(-1, self.width) & 127
        return d.astype(np.int64) @ (128 ** np.arange(self.width - 1, -1, -1))

    def _hash(self, codes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        h = np.full(len(starts), n, dtype=U)
        for k in range(n):
            h += codes[starts + k].astype(U) * _MULTIPLY[k % len(_MULTIPLY)]
            if k >= len(_MULTIPLY):
                h = mix(h)
        return mix(h)

    def scan(self, w: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Flags of the words that are hit, and the items found."""
        flags, items = np.zeros(len(w), dtype=bool), set()
        if not w or not self.any:
            return flags, items
        get = self.symbol.get
        text = "".join([get(x, self.unknown) for x in w])
        found = list(self.auto.iter(text))
        if not found:
            return flags, items
        codes, ends = self._codes(text), np.array(found, dtype=np.int64)
        ends, kind = ends[:, 0] // self.width, ends[:, 1]
        for n, (known, where, heads, who) in self.tables.items():
            if n == self.size:
                piece = ends[kind & PIECE > 0] - self.piece + 1
                starts = np.unique(piece[:, None] - np.arange(n - self.piece + 1))
                starts = starts[(starts >= 0) & (starts <= len(w) - n)]
            else:
                starts = ends[(kind & SHORT > 0) & (kind >> 2 == n)] - n + 1
            if not len(starts):
                continue
            h = self._hash(codes, starts, n)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            same = known[at] == h
            starts, at = starts[same], at[same]
            places = np.arange(n)
            same = (codes[starts[:, None] + places] == self.flat[where[at][:, None] + places]).all(axis=1)
            for s, k in zip(starts[same].tolist(), at[same].tolist(), strict=True):
                flags[s : s + n] = True
                items.update(who[heads[k] : heads[k + 1]].tolist())
        return flags, items


def automata(items: list[tuple[int, bytes]], size: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items as words, in lists of at most AUTOMATON_WORDS; a longer item is cut so that no window is lost."""
    most = max(AUTOMATON_WORDS, 2 * size)
    held, n = [], 0
    for i, raw in items:
        w = words(raw)
        for a in range(0, max(1, len(w) - size + 1), most - size + 1):
            part = w[a : a + most]
            if held and n + len(part) > most:
                yield held
                held, n = [], 0
            held.append((i, part))
            n += len(part)
    if held:
        yield held


def portions(items: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The items in portions of about PORTION_BYTES (or one item), by a hash of the id; one at least, maybe empty."""
    src = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // PORTION_BYTES) or 1
    for b in range(n):
        yield sorted((r.item_id, r.text.encode()) for r in src.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).collect())


_last: list = [None, None]


def _scanners(load: Broadcast, key: str, size: int) -> Iterator[Scanner]:
    """The automata of a portion one behind the other; a single one is kept for the next tasks of the worker."""
    if _last[0] == key:
        yield _last[1]
        return
    _last[:] = [None, None]
    parts = automata(load.value, size)
    now, more = next(parts, []), next(parts, None)
    if more is None:
        _last[:] = [key, Scanner(now, size)]
        yield _last[1]
        return
    while now is not None:
        yield Scanner(now, size)
        now, more = more, next(parts, None)


def _pass(docs: DataFrame, load: Broadcast, size: int, several: bool, last: bool) -> DataFrame:
    """Scans for a portion of items: adds __items (ids found) and __flags (a bit for each word) to those of earlier passes; the last makes the results of them."""
    kept = [c for c in docs.columns if c not in ("__items", "__flags")]
    at, before, key = kept.index("text"), len(kept) < len(docs.columns), uuid.uuid4().hex
    src = docs.select(*kept, *(["__items", "__flags"] if before else []))
    schema = src.select(*kept).withColumns({n: F.lit(None).cast(t) for n, t in (NEW if last else STATE).items()}).schema
    raws = lambda b: ((t.as_py() or "").encode() for t in b.column(at))

    def scanned(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = [[None] * b.num_rows for b in batches]
        items = [[set() for _ in range(b.num_rows)] for b in batches]
        if before:
            items = [[set(x) for x in b.column(len(kept)).to_pylist()] for b in batches]
            flags = [[None if f is None else np.unpackbits(np.frombuffer(f, dtype=np.uint8)).astype(bool) for f in b.column(len(kept) + 1).to_pylist()] for b in batches]
        for scan in _scanners(load, key, size):
            for b, mine, who in zip(batches, flags, items, strict=True):
                for i, raw in enumerate(raws(b)):
                    f, found = scan.scan(words(raw))
                    if found:
                        mine[i] = f if mine[i] is None else mine[i][: len(f)] | f
                        who[i] |= found
        for b, mine, who in zip(batches, flags, items, strict=True):
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], *(results(b, mine, who) if last else state(mine, who))], schema.names)

    def state(flags: list, items: list[set[int]]) -> list[pa.Array]:
        bits = [None if f is None else np.packbits(f).tobytes() for f in flags]
        return [pa.array([sorted(x) for x in items], pa.list_(pa.int64())), pa.array(bits, pa.binary())]

    def results(batch: pa.RecordBatch, flags: list, items: list[set[int]]) -> list[pa.Array]:
        total, hit, spans = [], [], []
        for raw, f in zip(raws(batch), flags, strict=True):
            total.append(len(words(raw)))
            if f is None:
                hit.append(0)
                spans.append([])
                continue
            f = f[: total[-1]]
            lead = np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)
            where = word_spans(raw)
            edge = np.flatnonzero(np.diff(np.concatenate([[False], f, [False]]).astype(np.int8))).reshape(-1, 2)
            hit.append(int(f.sum()))
            spans.append([{"start": int(lead[where[a][0]]) - 1, "end": int(lead[where[b - 1][1] - 1])} for a, b in edge])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return [pa.array(total, pa.int64()), pa.array(hit, pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.int64())), pa.array(spans, span)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_held = [], 0
        for batch in it:
            for lo in range(0, batch.num_rows, 1000):
                held.append(batch.slice(lo, 1000))
                size_held += held[-1].nbytes
                if not several or size_held > GROUP_BYTES:
                    yield from scanned(held)
                    held, size_held = [], 0
        if held:
            yield from scanned(held)

    return src.mapInArrow(run, schema)


def find_hits(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, and per text the hit words and items.

    Returns every input row (other columns kept) with n_words, n_hit, items
    (sorted ids with occurring windows) and hits (array of structs start, end:
    merged hit stretches in code points of the original text, end exclusive).
    Null text has no words.  An item shorter than a window is one window; an
    item without words, a null item or a null item_id finds nothing.  Rows
    are independent of each other, repeated ones stay, an empty table gives
    no rows; columns of the same names are replaced.  A worker holds one
    automaton of AUTOMATON_WORDS at a time, the driver one portion of items.
    """
    out = docs.select(*[c for c in docs.columns if c not in NEW])
    size_of = items.where("item_id is not null").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a word and its separator are two bytes or more
    several = size_of > 2 * AUTOMATON_WORDS
    count, made = 0, portions(items)
    now = next(made)
    while now is not None:
        more = next(made, None)
        step = _pass(out, docs.sparkSession.sparkContext.broadcast(now), size, several, more is None)
        if more is not None:
            old, out = out, common.materialize(step, "decontam")
            if count:
                common.drop_table(old)
        else:
            out = step
        now, count = more, count + 1
    return out


def report(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row; nulls, repeats, empty tables and clashing columns as in find_hits()."""
    found = find_hits(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), items, size)
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: The same by comparing every stretch of document words with every window.
REPORT_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), h AS (SELECT rid, i, n, item_id FROM dw JOIN win USING (n, s)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
it AS (SELECT rid, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS v FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)
"""
