"""Byte-level BPE encoding and decoding, exact and in linear time.

A piece of text (one match of the pattern) is mapped byte for byte to Latin-1,
and an Aho-Corasick automaton over the vocabulary finds every token at every
place.  The encoder takes the longest token at each place and steps back to
shorter ones where a token cannot follow its neighbour; each place is given up
at most once, so time is linear.  Whether two tokens may stand side by side is
decided once by merging their joint bytes, and remembered: a sequence whose
neighbours are all compatible is the one that merging by rank makes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces whose ids a task remembers, and pairs whose compatibility it remembers.
PIECE_MEMORY = 200_000
PAIR_MEMORY = 2_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank from a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """Plain merging, lowest rank first, leftmost on ties: the rule itself, for short inputs."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Encoder:
    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        self.token = {r: t for t, r in self.ranks.items()}
        self.auto = ahocorasick.Automaton()
        self.length = {}
        self.shorter: dict[int, int | None] = {}
        made = {}
        for t, r in self.ranks.items():
            if merge(self.ranks, t) == [r]:  # tokens that merging never makes match only as a whole piece
                self.auto.add_word(t.decode("latin-1"), r)
                self.length[r] = len(t)
                made[t] = r
        for t, r in made.items():
            self.shorter[r] = next((made[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in made), None)
        self.auto.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}

    def compatible(self, a: int, b: int) -> bool:
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) >= PAIR_MEMORY:
                self.pairs.clear()
            ok = self.pairs[a, b] = merge(self.ranks, self.token[a] + self.token[b]) == [a, b]
        return ok

    def encode_piece(self, raw: bytes) -> list[int]:
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        longest: list[int | None] = [None] * (n + 1)
        length = self.length
        for end, r in self.auto.iter(raw.decode("latin-1")):
            at = end + 1 - length[r]
            if longest[at] is None or length[longest[at]] < length[r]:
                longest[at] = r
        open_ = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, now = 0, longest[0]
        while at < n:
            end = at + length[now]
            if open_[end] and (not out or self.compatible(out[-1], now)):
                out.append(now)
                at, now = end, longest[end]
                continue
            now = self.shorter[now]
            while now is None:  # nothing fits here: give the place up and shorten the token before
                open_[at] = 0
                last = out.pop()
                at -= length[last]
                now = self.shorter[last]
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        memory, out = self.pieces, []
        for m in self.pattern.finditer(text) if len(text) > 1_000_000 else self.pattern.findall(text):
            piece = m if type(m) is str else m[0]
            ids = memory.get(piece)
            if ids is None:
                ids = np.array(self.encode_piece(piece.encode()), dtype="<u4").tobytes()
                if len(piece) <= 64:
                    if len(memory) >= PIECE_MEMORY:
                        memory.clear()
                    memory[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder a worker process."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds ids, an array of token ids of the whole text; other columns stay.

    A null text counts as empty, and an empty text gives an empty array.  A
    column already called ids is replaced.  Rows neither move nor depend on
    each other: repeated rows and empty tables need nothing special.
    """
    kept = [c for c in docs.columns if c != ids]
    schema = docs.select(*kept).withColumn(ids, F.array().cast("array<int>")).schema
    at = kept.index(text)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in it:
            for lo in range(0, max(1, batch.num_rows), 500):
                part = batch.slice(lo, 500)
                found = [np.frombuffer(enc.encode(t or ""), dtype="<u4").astype(np.int32) for t in part.column(at).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                flat = np.concatenate(found) if found else np.empty(0, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], [*kept, ids])

    return docs.select(*kept).mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds out, the bytes that the token ids stand for; null ids give null, no ids empty bytes."""
    kept = [c for c in docs.columns if c != out]
    schema = docs.select(*kept).withColumn(out, F.lit(None).cast("binary")).schema
    at = kept.index(ids)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in it:
            for lo in range(0, max(1, batch.num_rows), 500):
                part = batch.slice(lo, 500)
                raw = [None if not x.is_valid else enc.decode(x.values.to_numpy(zero_copy_only=False)) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], [*kept, out])

    return docs.select(*kept).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of whole texts: encode(), then decode(), then hashes.

    The digests are taken where the ids are made, so neither ids nor texts
    travel between processes.  Null text counts as empty.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in it:
            n, a, b = [], [], []
            for t in batch.column(1):
                raw = enc.encode(t.as_py() or "")
                ids = np.frombuffer(raw, dtype="<u4")
                n.append(len(ids))
                a.append(hashlib.sha256(raw).hexdigest())
                b.append(hashlib.sha256(enc.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)
