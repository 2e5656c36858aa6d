"""N-gram Jaccard join through prefix trees.

A document is the set of its word n-grams; two documents link when the
Jaccard similarity of their sets reaches the threshold.  The join finds the
classes of documents that links connect, in steps that all run on DataFrames
keyed by the hash of a whole set (equal sets are one node):

1. Sieve.  Of the first so many n-grams of a set in hash order, linked sets
   have a known number in common.  An index of those n-grams alone says how
   many of them another set has too; sets with fewer than any link needs go.
2. Global order.  An inverted index of all n-grams of the other sets, dealt
   out by n-gram, says how many sets hold each.  An n-gram becomes a 64-bit
   key whose first byte grows with that number, so keys sort rarest first, the
   same in every set.  n-grams of one set alone take part in no overlap and
   go; a set that keeps fewer n-grams than any link needs goes too.
3. Shards.  Linked sets share one of their first size - need + 1 keys.  Sets
   with a common key there are tied by star edges (never pairs), made first
   within a task; what these edges connect is a shard.
4. Trie join.  Inside a shard, cut into blocks of bounded size, the ordered
   sets are walked as a trie: a path keeps the overlap with every other set,
   sets with a common beginning share it, and a subtree is left as soon as no
   partner can reach the bound with what remains of the path.  Sets that are
   connected already aren't compared again.  Overlaps are counted in full, so
   links are exact.  Blocks are joined within themselves first, then with
   each other.
5. Components over these links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import U, Words, chunks, mix, ngrams, space_lut

#: n-grams in one block of a shard: bounds the memory of a task of the trie join.
BLOCK_NGRAMS = 400_000
#: n-grams gathered in a task before they are dealt out, and on average in one bucket: bounds its memory.
FLUSH = 1_000_000
#: An n-gram that so many of the sets of one flush hold is counted as frequent.
FREQUENT = 16
#: Sets in one flush at most, so that two bytes number them.
FLUSH_SETS = 65_000
#: Share of a set's n-grams that must be common to the sieved n-grams of linked sets.
HOLD = Fraction(3, 10)
#: First byte of the key of frequent n-grams.
LAST = 255
LOW = U((1 << 56) - 1)


def _sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    w = Words(texts, space_lut())
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        yield np.unique(ngrams(w.hash[a:b], n))


def _set_id(s: np.ndarray) -> int:
    if not len(s):
        return 0
    h = mix((mix(s + U(0x51ED27)) * common.BASE).sum(keepdims=True) + U(len(s)))
    return int(h.astype(np.int64)[0])


def _need(n, num: int, den: int):
    """Overlap that a set of n n-grams has with any set it links with."""
    return -(-num * n // den)


# ---------------------------------------------------------------- the global order


def profile(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_hash, set_id (0: empty set), n_shingles of every row; often and times are null there.

    Besides, rows with a null set_id: often and times list the n-grams that
    FREQUENT sets or more of one flush hold, and how many do.
    """
    names = ["doc_id", "text_hash", "set_id", "n_shingles", "often", "times"]
    lists = pa.list_(pa.int64())

    def tally(seen: dict[int, np.ndarray]) -> pa.RecordBatch:
        u, c = np.unique(np.concatenate(list(seen.values())), return_counts=True)
        u, c = u[c >= FREQUENT].astype(np.int64), c[c >= FREQUENT]
        none = pa.nulls(1, pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.array([u], lists), pa.array([c], lists)], names)

    def run(it):
        seen, held = {}, 0
        for batch in it:
            ids, sizes = [], []
            for _, part in chunks(batch.column(2)):
                for s in _sets(part, n):
                    k = _set_id(s)
                    ids.append(k)
                    sizes.append(len(s))
                    if len(s) and k not in seen:
                        seen[k] = s
                        held += len(s)
                    if held > FLUSH:
                        yield tally(seen)
                        seen, held = {}, 0
            rows = [batch.column(0), batch.column(1), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*rows, pa.nulls(len(ids), lists), pa.nulls(len(ids), lists)], names)
        if held:
            yield tally(seen)

    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    return src.mapInArrow(run, "doc_id bigint, text_hash bigint, set_id bigint, n_shingles bigint, often array<bigint>, times array<bigint>")


def frequent(prof: DataFrame, total: int) -> np.ndarray:
    """The n-grams counted as frequent, FREQUENT / FLUSH of all: at most FLUSH / FREQUENT, 0.5 MB, whatever the table.

    All n-grams of twice that share are among them.
    """
    pairs = prof.where("set_id is null").select(F.explode(F.arrays_zip("often", "times")).alias("x"))
    top = pairs.groupBy("x.often").agg(F.sum("x.times").alias("n")).where(F.col("n") * (FLUSH // FREQUENT) >= total).select("often")
    return np.sort(np.array([r[0] for r in top.collect()], dtype=np.int64).astype(U))


def _shrink(grams: np.ndarray) -> bytes:
    """The low seven bytes of each n-gram."""
    return np.ascontiguousarray(grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _widen(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 7, 8), dtype=np.uint8)
    out[:, :7] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 7)
    return out.view("<u8").ravel()


def _deal(where: np.ndarray, node: np.ndarray, item: np.ndarray, pack) -> pa.RecordBatch:
    """Rows (bucket, node, count, size, item): items sorted by place and node, each node named once in a row."""
    order = np.lexsort((node, where))
    where, node, item = where[order], node[order], item[order]
    heads = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (node[1:] != node[:-1])]))
    count = np.diff(np.append(heads, len(node))).astype(np.uint32)
    used, at = np.unique(where, return_index=True)
    at = np.append(at, len(where))
    run = np.searchsorted(heads, at)
    cols = [
        pa.array(used.astype(np.int32)),
        pa.array([node[heads[a:b]].tobytes() for a, b in zip(run, run[1:])], pa.binary()),
        pa.array([count[a:b].tobytes() for a, b in zip(run, run[1:])], pa.binary()),
        pa.nulls(len(used), pa.binary()),
        pa.array([pack(item[a:b]) for a, b in zip(at, at[1:])], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(cols, DEALT)


DEALT = ["bucket", "node", "count", "size", "item"]
DEALT_TYPE = "bucket int, node binary, count binary, size binary, item binary"


def _place(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U(32)) * U(buckets)) >> U(32)


def _runs(it: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[list[tuple]]:
    """Rows with equal first columns, from batches that are sorted by them."""
    now, rows = None, []
    for batch in it:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if r[:keys] != now and rows:
                yield rows
                rows = []
            now = r[:keys]
            rows.append(r)
    if rows:
        yield rows


def _hold(n: int) -> int:
    return max(1, -(-HOLD.numerator * n // HOLD.denominator))


def sieve(docs: DataFrame, n: int, num: int, den: int, often: np.ndarray, total: int) -> DataFrame:
    """set_id of the sets that may link with another; some copies of others pass too.

    Linked sets of a and b n-grams have min(_hold(a), _hold(b)) or more in
    common among their first size - need + _hold(size) n-grams in hash order.
    A posting is five bytes of the n-gram and two that number its set in the
    flush; counts go back to the flush, which has the names of its sets.
    """
    spark = docs.sparkSession
    parts = common.partitions(spark)
    buckets = max(parts, total // FLUSH)
    load = spark.sparkContext.broadcast(often)
    names = ["bucket", "flush", "node", "count", "item"]
    schema = "bucket int, flush bigint, node binary, count binary, item binary"

    def row(bucket, flush, node, count, item):
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(flush, pa.int64()), *(pa.array(x, pa.binary()) for x in (node, count, item))], names)

    def cut(it):
        known, seen, held = load.value, {}, 0

        def flush():
            node = np.fromiter(seen, dtype=np.int64, count=len(seen))
            size = np.array([len(s) for s in seen.values()], dtype=np.int64)
            # the same rows make the same flush again, should the task be repeated
            name = int(mix(node.astype(U) + np.arange(len(node), dtype=U) * common.BASE).sum(keepdims=True).astype(np.int64)[0])
            first = [s[: min(len(s), len(s) - _need(len(s), num, den) + _hold(len(s)))] for s in seen.values()]
            flat, owner = np.concatenate(first), np.repeat(np.arange(len(node)), [len(s) for s in first])
            top = np.isin(flat, known)
            least = np.array([_hold(int(_need(k, num, den))) for k in size.tolist()]) - np.bincount(owner[top], minlength=len(node))
            yield row([name % buckets], [name], [node.tobytes()], [least.astype(np.int32).tobytes()], [None])
            gram, owner = mix(flat[~top]), owner[~top].astype(np.uint16)
            where = _place(gram, buckets)
            order = np.argsort(where, kind="stable")
            where, gram, owner = where[order], gram[order], owner[order]
            used, at = np.unique(where, return_index=True)
            at = np.append(at, len(where))
            low = np.ascontiguousarray(gram.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
            yield row(used.astype(np.int32), [name] * len(used), [None] * len(used), [owner[a:b].tobytes() for a, b in zip(at, at[1:])], [low[a:b].tobytes() for a, b in zip(at, at[1:])])

        for batch in it:
            for _, part in chunks(batch.column(0)):
                for s in _sets(part, n):
                    k = _set_id(s)
                    if len(s) and k not in seen:
                        seen[k] = s
                        held += len(s)
                    if held > FLUSH or len(seen) >= FLUSH_SETS:
                        yield from flush()
                        seen, held = {}, 0
        if held:
            yield from flush()

    def count(it):
        for rows in _runs(it):
            back, dealt = [r for r in rows if r[2] is not None], [r for r in rows if r[2] is None]
            for _, name, node, least, _ in back:
                yield row([name % buckets], [name], [node], [least], [None])
            if dealt:
                raw = np.concatenate([np.frombuffer(r[4], dtype=np.uint8).reshape(-1, 5) for r in dealt])
                wide = np.zeros((len(raw), 8), dtype=np.uint8)
                wide[:, :5] = raw
                _, inv, times = np.unique(wide.view("<u8").ravel(), return_inverse=True, return_counts=True)
                shared, lo = times[inv] > 1, 0
                out: tuple[list, ...] = ([], [], [])
                for _, name, _, owner, _ in dealt:
                    owner = np.frombuffer(owner, dtype=np.uint16)
                    who, found = np.unique(owner[shared[lo : lo + len(owner)]], return_counts=True)
                    lo += len(owner)
                    if len(who):
                        for o, v in zip(out, (name, who.tobytes(), found.astype(np.uint32).tobytes()), strict=True):
                            o.append(v)
                if out[0]:
                    yield row([x % buckets for x in out[0]], out[0], [None] * len(out[0]), out[1], out[2])

    def gather(it):
        for rows in _runs(it, 2):
            heads = [r for r in rows if r[2] is not None]
            left = np.frombuffer(heads[0][3], dtype=np.int32).astype(np.int64)
            for _, _, node, who, found in rows:
                if node is None:
                    left[np.frombuffer(who, dtype=np.uint16)] -= np.frombuffer(found, dtype=np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(heads[0][2], dtype=np.int64)[left <= 0])], ["set_id"])

    index = docs.select("text").where("text is not null").mapInArrow(cut, schema)
    counted = index.repartition(min(parts, buckets), "bucket").sortWithinPartitions("bucket").mapInArrow(count, schema)
    return counted.repartition(min(parts, buckets), "bucket").sortWithinPartitions("bucket", "flush").mapInArrow(gather, "set_id bigint").distinct()


def ordered_sets(docs: DataFrame, n: int, num: int, den: int, often: np.ndarray, total: int) -> DataFrame:
    """set_id, n_shingles, keys: the sets that share enough n-grams with others to link with any, in the global order.

    keys are 64-bit numbers: a byte that grows with the number of sets that
    hold the n-gram, then the low 56 bits of its hash.  Frequent n-grams have
    LAST there and aren't counted, so that no task gathers all their holders.
    """
    spark = docs.sparkSession
    parts = common.partitions(spark)
    buckets = max(parts, total // FLUSH)
    load = spark.sparkContext.broadcast(often)

    def cut(it):
        known, seen, held = load.value, {}, 0

        def flush():
            node = np.fromiter(seen, dtype=np.int64, count=len(seen))
            size = np.array([len(s) for s in seen.values()], dtype=np.uint32)
            flat, owner = np.concatenate(list(seen.values())), np.repeat(np.arange(len(node)), size)
            top = np.isin(flat, known)
            # each set's size and its frequent n-grams pass by the index
            times = np.bincount(owner[top], minlength=len(node)).astype(np.uint32)
            keys = (flat[top] & LOW) | U(LAST << 56)
            yield pa.RecordBatch.from_arrays([pa.array([int(node[0]) % buckets], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (node, times, size, keys))], DEALT)
            if not top.all():
                flat, owner = flat[~top], owner[~top]
                yield _deal(_place(flat, buckets), node[owner], flat, _shrink)

        for batch in it:
            for _, part in chunks(batch.column(0)):
                for s in _sets(part, n):
                    k = _set_id(s)
                    if len(s) and k not in seen:
                        seen[k] = s
                        held += len(s)
                    if held > FLUSH:
                        yield from flush()
                        seen, held = {}, 0
        if held:
            yield from flush()

    def count(it):
        for rows in _runs(it):
            nodes, grams = [], []
            for _, node, times, size, item in rows:
                node, times = np.frombuffer(node, dtype=np.int64), np.frombuffer(times, dtype=np.uint32)
                if size is None:
                    nodes.append(np.repeat(node, times))
                    grams.append(_widen(item))
                    continue
                ends = np.concatenate([[0], np.cumsum(times, dtype=np.int64)])
                where, keys, size = _place(mix(node.astype(U)), buckets), np.frombuffer(item, dtype=U), np.frombuffer(size, dtype=np.uint32)
                for b in np.unique(where):
                    at = np.flatnonzero(where == b)
                    mine = np.concatenate([keys[ends[i] : ends[i + 1]] for i in at])
                    yield pa.RecordBatch.from_arrays([pa.array([int(b)], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (node[at], times[at], size[at], mine))], DEALT)
            if not grams:
                continue
            node, gram = np.concatenate(nodes), np.concatenate(grams)
            order = np.lexsort((node, gram))
            node, gram = node[order], gram[order]
            once = np.concatenate([[True], (node[1:] != node[:-1]) | (gram[1:] != gram[:-1])])
            node, gram = node[once], gram[once]
            heads = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            times = np.diff(np.append(heads, len(gram)))
            times = np.repeat(times, times)
            shared = times > 1
            if shared.any():
                rare = np.minimum(LAST - 1, 4 * np.log2(times[shared])).astype(U)
                node = node[shared]
                yield _deal(_place(mix(node.astype(U)), buckets), node, gram[shared] | (rare << U(56)), np.ndarray.tobytes)

    def gather(it):
        for rows in _runs(it):
            nodes, keys, sized, sizes = [], [], [], []
            for _, node, times, size, item in rows:
                node = np.frombuffer(node, dtype=np.int64)
                nodes.append(np.repeat(node, np.frombuffer(times, dtype=np.uint32)))
                keys.append(np.frombuffer(item, dtype=U))
                if size is not None:
                    sized.append(node)
                    sizes.append(np.frombuffer(size, dtype=np.uint32))
            node, key = np.concatenate(nodes), np.concatenate(keys)
            order = np.lexsort((key, node))
            node, key = node[order], key[order]
            once = np.ones(len(node), dtype=bool)
            once[1:] = (node[1:] != node[:-1]) | (key[1:] != key[:-1])
            node, key = node[once], key[once]
            who, at = np.unique(np.concatenate(sized), return_index=True)
            size = np.concatenate(sizes)[at].astype(np.int64)
            a, b = np.searchsorted(node, who, side="left"), np.searchsorted(node, who, side="right")
            good = np.flatnonzero(b - a >= _need(size, num, den)).tolist()
            for lo in range(0, len(good), 1000):
                part = good[lo : lo + 1000]
                yield pa.RecordBatch.from_arrays([pa.array(who[part]), pa.array(size[part]), pa.array([key[a[i] : b[i]].tobytes() for i in part], pa.binary())], ["set_id", "n_shingles", "keys"])

    index = docs.select("text").where("text is not null").mapInArrow(cut, DEALT_TYPE)
    counted = index.repartition(min(parts, buckets), "bucket").sortWithinPartitions("bucket").mapInArrow(count, DEALT_TYPE)
    return counted.repartition(min(parts, buckets), "bucket").sortWithinPartitions("bucket").mapInArrow(gather, "set_id bigint, n_shingles bigint, keys binary")


# ---------------------------------------------------------------- shards


def _star(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest node of each signature, and (node, smallest) edges; sorted by signature."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    head = np.ones(len(sig), dtype=bool)
    head[1:] = sig[1:] != sig[:-1]
    first = node[np.flatnonzero(head)][np.cumsum(head) - 1]
    other = node != first
    edges = np.unique(np.stack([node[other], first[other]], axis=1), axis=0) if other.any() else np.empty((0, 2), dtype=np.int64)
    return sig[head], node[head], edges


def candidates(sets: DataFrame, num: int, den: int) -> DataFrame:
    """u, v: star edges between sets that have a common key among their first ones."""
    schema = "bucket int, sig binary, node binary"
    buckets = common.partitions(sets.sparkSession)

    def rows(b, sig, node):
        return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(sig, pa.binary()), pa.array(node, pa.binary())], ["bucket", "sig", "node"])

    def flush(sigs, nodes):
        sig, node, edges = _star(mix(np.concatenate(sigs)), np.concatenate(nodes))
        used, at = np.unique(_place(sig, buckets), return_index=True)
        at = [*at.tolist(), len(sig)]
        yield rows(used.astype(np.int32).tolist(), [sig[a:b].tobytes() for a, b in zip(at, at[1:])], [node[a:b].tobytes() for a, b in zip(at, at[1:])])
        # finished edges travel along, spread over the buckets
        for k, e in enumerate(np.array_split(edges, max(1, len(edges) // 50_000))):
            if len(e):
                yield rows([(int(e[0, 0]) + k) % buckets], [None], [e.tobytes()])

    def cut(it):
        sigs, nodes, held = [], [], 0
        for batch in it:
            for node, n, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                keys = np.frombuffer(raw, dtype=U)
                keys = keys[: len(keys) - _need(n, num, den) + 1]
                sigs.append(keys)
                nodes.append(np.full(len(keys), node, dtype=np.int64))
                held += len(keys)
                if held > FLUSH:
                    yield from flush(sigs, nodes)
                    sigs, nodes, held = [], [], 0
        if held:
            yield from flush(sigs, nodes)

    def meet(it):
        def out(e):
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["u", "v"])

        for group in _runs(it):
            sigs = [np.frombuffer(s, dtype=U) for _, s, _ in group if s is not None]
            if sigs:
                yield out(_star(np.concatenate(sigs), np.concatenate([np.frombuffer(v, dtype=np.int64) for _, s, v in group if s is not None]))[2])
            for _, s, v in group:
                if s is None:
                    yield out(np.frombuffer(v, dtype=np.int64).reshape(-1, 2))

    dealt = sets.mapInArrow(cut, schema).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(meet, "u bigint, v bigint").distinct()


# ---------------------------------------------------------------- trie join


def trie_links(sets: list[np.ndarray], sizes: np.ndarray, cut: int, label: np.ndarray, num: int, den: int) -> np.ndarray:
    """Labels of the sets after all links between sets[:cut] and sets[cut:] (cut 0: among all) have joined theirs.

    sets: sorted keys; sizes: n-grams, keys or not; label: equal where sets
    are known to be connected.  Queries are walked in trie order with one
    vector of overlaps a path, kept where the path forks; partners with the
    query's own label don't count.
    """
    label = label.copy()
    index = np.arange(cut, len(sets))
    isize, ilabel = sizes[index], label[index]
    lens = np.array([len(sets[i]) for i in index])
    tokens, inv, count = np.unique(np.concatenate([sets[i] for i in index]), return_inverse=True, return_counts=True)
    posting = np.repeat(np.arange(len(index)), lens)[np.argsort(inv, kind="stable")]
    first = np.concatenate([[0], np.cumsum(count)])
    paths = []
    for q in range(cut or len(sets)):
        r = np.searchsorted(tokens, sets[q])
        r[r == len(tokens)] = 0
        r = r[(tokens[r] == sets[q]) & (count[r] > (1 if cut == 0 else 0))]
        if len(r) >= _need(int(sizes[q]), num, den):
            paths.append((r.astype(">u4").tobytes(), q, r))
    paths.sort(key=lambda x: x[0])
    spine, stack = np.empty(0, dtype=np.int64), []

    def common_start(a, b):
        m = min(len(a), len(b))
        d = np.flatnonzero(a[:m] != b[:m])
        return int(d[0]) if len(d) else m

    def add(vec, r):
        for step in range(0, len(r), 4096):
            t = r[step : step + 4096]
            n = count[t]
            at = np.repeat(first[t] - np.cumsum(n) + n, n) + np.arange(n.sum())
            vec = vec + np.bincount(posting[at], minlength=len(index))
        return vec

    for k, (_, q, r) in enumerate(paths):
        n = int(sizes[q])
        # overlap each partner needs; the path is left when what remains can't reach it
        need = -(-num * (n + isize) // (num + den))
        possible = (isize * den >= n * num) & (n * den >= isize * num) & (ilabel != label[q])
        if not possible.any():
            continue
        here = common_start(spine, r)
        while stack and stack[-1][0] > here:
            stack.pop()
        depth, vec = stack[-1] if stack else (0, np.zeros(len(index), dtype=np.int64))
        spine = r
        fork = common_start(r, paths[k + 1][2]) if k + 1 < len(paths) else 0
        # a partner must have shown itself at the second of these stops
        stops = sorted({x for x in (fork, len(r) - _need(n, num, den) + 1, len(r) // 2, len(r)) if depth < x <= len(r)})
        for x in stops:
            vec = add(vec, r[depth:x])
            depth = x
            if x == fork:
                stack.append((x, vec))
            if not (possible & (vec + (len(r) - x) >= need)).any():
                break
        else:
            for b in np.flatnonzero(possible & (vec >= need)).tolist():
                if ilabel[b] != label[q]:
                    old, new = max(ilabel[b], label[q]), min(ilabel[b], label[q])
                    label[label == old] = new
                    ilabel = label[index]
    return label


#: Width of a size class, in steps of the threshold's ratio; sets within one step of a border meet the next class too.
CLASS_WIDTH = 3


def _blocks(members: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Cuts shards into blocks: the members with comp, block and place; and which different blocks meet: comp, block, a, b, low, high.

    members: set_id, comp, n_shingles, keys.  A block is a size class of a
    shard, or a hashed part of one with about BLOCK_NGRAMS n-grams.  Sizes
    that can link are at most one step apart, so blocks of a class meet each
    other, and those of the next class with the sets at the border between
    them (place from low to high).
    """
    step = F.log("n_shingles") / F.lit(math.log(den / num) * 1.0001)
    m = members.withColumn("cls", F.floor(step / CLASS_WIDTH).cast("int")).withColumn("place", step - F.col("cls") * CLASS_WIDTH)
    parts = m.groupBy("comp", "cls").agg(F.ceil(F.sum("n_shingles") / F.lit(BLOCK_NGRAMS)).cast("int").alias("parts"))
    m = m.join(parts, ["comp", "cls"]).withColumn("block", F.col("cls") * F.lit(1 << 32) + F.pmod(F.xxhash64("set_id"), F.col("parts"))).drop("cls", "parts")
    blocks = parts.select("comp", "cls", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    x = blocks.select("comp", F.col("cls").alias("mine"), (F.col("cls") * F.lit(1 << 32) + F.col("part")).alias("a"), F.explode(F.array(F.col("cls"), F.col("cls") + 1)).alias("other"))
    y = blocks.select("comp", F.col("cls").alias("other"), (F.col("cls") * F.lit(1 << 32) + F.col("part")).alias("b"))
    meet = x.join(y, ["comp", "other"]).where("a < b")
    border = F.col("mine") != F.col("other")
    low, high = F.when(border, CLASS_WIDTH - 1).otherwise(0), F.when(border, 1).otherwise(CLASS_WIDTH)
    lower = F.struct(F.col("a").alias("block"), low.cast("double").alias("low"), F.lit(float(CLASS_WIDTH)).alias("high"))
    upper = F.struct(F.col("b").alias("block"), F.lit(0.0).alias("low"), high.cast("double").alias("high"))
    sides = meet.select("comp", "a", "b", F.explode(F.array(lower, upper)).alias("s")).select("comp", "a", "b", "s.*")
    return m, sides


def links(members: DataFrame, num: int, den: int) -> DataFrame:
    """u, v: edges that connect exactly the sets that links connect.  members: set_id, comp, n_shingles, keys."""

    def within(it):
        for rows in _runs(it, 2):
            yield _edges([(*r[2:], r[2]) for r in rows], 0)

    def between(it):
        for rows in _runs(it, 3):
            left, right = [r[4:] for r in rows if r[3] == r[1]], [r[4:] for r in rows if r[3] != r[1]]
            if left and right:
                yield _edges(left + right, len(left))

    def _edges(rows: list[tuple], cut: int) -> pa.RecordBatch:
        """From (set_id, size, keys, label) rows."""
        label = np.array([r[3] for r in rows], dtype=np.int64)
        found = trie_links([np.frombuffer(r[2], dtype=U) for r in rows], np.array([r[1] for r in rows], dtype=np.int64), cut, label, num, den)
        ids = label if cut else np.array([r[0] for r in rows], dtype=np.int64)
        moved = ids != found
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(found[moved])], ["u", "v"])

    edge = "u bigint, v bigint"
    parts = common.partitions(members.sparkSession)
    m, sides = _blocks(members, num, den)
    m = common.materialize(m, "jaccard-blocks")
    dealt = m.select("comp", "block", "set_id", "n_shingles", "keys").repartition(parts, "comp", "block").sortWithinPartitions("comp", "block")
    inner = common.materialize(dealt.mapInArrow(within, edge), "jaccard-inner")
    named = m.join(sides, ["comp", "block"]).where("place >= low and place <= high").join(inner.withColumnRenamed("u", "set_id"), "set_id", "left")
    dealt = named.select("comp", "a", "b", "block", "set_id", "n_shingles", "keys", F.coalesce("v", "set_id").alias("label")).repartition(parts, "comp", "a", "b").sortWithinPartitions("comp", "a", "b")
    found = common.materialize(inner.union(dealt.mapInArrow(between, edge)), "jaccard-found")
    for table in (m, inner):
        common.drop_table(table)
    return found


# ---------------------------------------------------------------- the join


def _classes(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The profile of all rows, and of each set: set_id, low (smallest doc_id), rep (its first row), root (null: no links)."""
    both = common.materialize(profile(docs, n), "jaccard-profile")
    prof = both.where("set_id is not null").drop("often", "times")
    total = prof.agg(F.sum("n_shingles")).first()[0] or 0
    sets = prof.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("low"), F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash")).alias("rep"), F.max("n_shingles").alias("n_shingles"))
    often = frequent(both, total)
    passed = common.materialize(sieve(docs, n, num, den, often, total), "jaccard-sieve")
    kept = common.materialize(sets.join(passed, "set_id").select("rep.text_hash", "n_shingles"), "jaccard-kept")
    left = kept.agg(F.sum("n_shingles")).first()[0] or 0
    src = common.might_match(docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("__th")), "__th", kept.select("text_hash"))
    ordered = common.materialize(ordered_sets(src.select("text"), n, num, den, often, left), "jaccard-ordered")
    near = common.components(candidates(ordered, num, den), "jaccard-near")
    found = links(ordered.join(near.select(F.col("node").alias("set_id"), F.col("root").alias("comp")), "set_id"), num, den)
    linked = common.components(found, "jaccard-links").select(F.col("node").alias("set_id"), "root")
    for table in (passed, kept, ordered, near, found):
        common.drop_table(table)
    return prof, sets.select("set_id", "low", "rep").join(linked, "set_id", "left")


def jaccard_join(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """Classes of documents linked by n-gram Jaccard similarity of num/den or more.

    docs: doc_id, text and any other columns (ignored).  Returns one row for
    each input row: doc_id, n_shingles (size of its set), component_id (the
    smallest doc_id reachable by links).  n-grams are those of lower-cased
    (A-Z) words between white space; a text with fewer words has one, the
    whole sequence; a null, empty or blank text has none, links with nothing
    and keeps its own doc_id.  Repeated rows come out as often as they went
    in.  A null doc_id counts for nothing in component_id, which is null only
    if no document of the class has an id.  An empty table gives no rows.
    Sets are told apart by 64-bit, n-grams by 56-bit hashes.
    """
    prof, sets = _classes(docs, n, num, den)
    best = sets.where("root is not null").groupBy("root").agg(F.min("low").alias("component_id"))
    own = sets.join(best, "root", "left").select("set_id", F.coalesce("component_id", "low").alias("component_id"))
    return prof.join(own, "set_id", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """The documents with one row of each class kept, the one of the smallest doc_id.

    All columns stay.  Documents without words are in no class and all stay;
    of repeated rows with words one stays; a null doc_id is kept only where
    no document of the class has an id.
    """
    prof, sets = _classes(docs, n, num, den)
    rows = prof.where("n_shingles > 0").groupBy("set_id").agg(F.count("*").alias("rows"))
    named = sets.join(rows, "set_id").withColumn("root", F.coalesce("root", "set_id"))
    crowds = named.groupBy("root").agg(F.sum("rows").alias("rows"), F.min("rep").alias("rep")).where("rows > 1")
    held = prof.where("n_shingles > 0").join(named.select("set_id", "root"), "set_id").join(crowds, "root")
    one = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("text_hash") == F.col("rep.text_hash"))
    # the rows of classes of several, and whether they are what stays of it; texts of other rows aren't shuffled
    held = common.materialize(held.select("doc_id", "text_hash", one.alias("first")).distinct(), "jaccard-held")
    keys = held.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("first").alias("__first"))
    src = common.flag_match(docs.withColumn("__th", F.xxhash64(F.coalesce("text", F.lit("")))), "__th", keys.select("__hash"), "__flag")
    alone = src.where("not __flag").select(*docs.columns)
    both = src.where("__flag").join(keys, F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__hash")), "left")
    alone = alone.union(both.where("__first is null").select(*docs.columns))
    first = both.where("__first").withColumn("__n", F.row_number().over(Window.partitionBy("__id", "__hash").orderBy("__first")))
    return alone.union(first.where("__n = 1").select(*docs.columns))


#: The join at 3 words and 90 % by comparing all pairs with a common n-gram, for tables with one row an id.
JOIN_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), g AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + least(len(w), 3) - 1], ' ')) AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM g x JOIN g y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o >= 90 * (p.n + q.n - o)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(b) AS component_id FROM r JOIN d ON r.a = doc_id LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
