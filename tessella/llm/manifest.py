"""Merkle manifest of a dataset with incremental witnesses.

Every row is a leaf; the leaves of a tree have places from 0.  Leaves that
follow each other fill aligned blocks of 2^BLOCK places, and a task appends
the leaves of a block one by one as they stream by: a new leaf is an open
subtree with an empty witness; as soon as its sibling subtree is complete,
both close into their parent, and the witnesses of all leaves below are
extended by the root of the other half.  The root of a block is known when
its last leaf has been appended; block roots are the leaves of the tree
above, appended in the same way, until each tree has one root.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: A block has 2^BLOCK places.
BLOCK = 12
#: Nodes that leave a task in one Arrow batch.
BATCH = 8192


# ---------------------------------------------------------------- leaves


def field(x: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value."""
    s = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """SHA-256 of the fields of a row, as hex text."""
    return F.sha2(F.concat(*(field(c) for c in columns)).cast("binary"), 256)


def numbered(nodes: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """nodes with pos, the place in its tree (a column without nulls) from 0, and n, the tree's size; written to the shared folder.

    Rows are dealt to ranges of tree and order, sorted there and numbered; the
    ranges of a tree follow each other, so no task holds a whole tree.
    """
    spark = nodes.sparkSession
    run = nodes.repartitionByRange(common.partitions(spark), tree, *order).sortWithinPartitions(tree, *order).withColumn("__id", F.monotonically_increasing_id())
    run = common.materialize(run, name)
    part = F.shiftright("__id", 33)
    counts = run.groupBy(F.col(tree).alias("__t"), part.alias("__p")).agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    whole = Window.partitionBy("__t")
    before = F.coalesce(F.sum("__n").over(whole.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__t", "__p", (F.col("__first") - before).alias("__base"), F.sum("__n").over(whole).alias("n"))
    out = run.join(counts, (run[tree] == F.col("__t")) & (part == F.col("__p")))
    return out.withColumn("pos", F.col("__id") - F.col("__base")).drop("__t", "__p", "__base", "__id")


# ---------------------------------------------------------------- appending


class Frontier:
    """The open subtrees of one block while leaves are appended.

    witness[i] has the siblings met so far on the way from leaf i to the root,
    sides[i] where each stood: L or R, or - where a node had none and was
    hashed alone.
    """

    def __init__(self):
        self.witness: list[list[str]] = []
        self.sides: list[list[str]] = []
        self.open: list[tuple[int, str, int]] = []  # level, root, first leaf; levels fall from left to right

    def append(self, leaf: str) -> None:
        self.open.append((0, leaf, len(self.witness)))
        self.witness.append([])
        self.sides.append([])
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self._close()

    def _close(self) -> None:
        level, right, middle = self.open.pop()
        _, left, first = self.open.pop()
        for i in range(first, middle):
            self.witness[i].append(right)
            self.sides[i].append("R")
        for i in range(middle, len(self.witness)):
            self.witness[i].append(left)
            self.sides[i].append("L")
        self.open.append((level + 1, sha256((left + right).encode()).hexdigest(), first))

    def finish(self, height: int | None) -> str:
        """The root of what was appended: at this height, or where one node remains."""
        while len(self.open) > 1 or (height is not None and self.open[0][0] < height):
            level, node, first = self.open.pop()
            for i in range(first, len(self.sides)):
                self.sides[i].append("-")
            self.open.append((level + 1, sha256(node.encode()).hexdigest(), first))
            while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
                self._close()
        return self.open[0][1]


def _append(batches: Iterator[pa.RecordBatch], size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Appends rows tree, pos, hash, n, sorted by tree and pos, block by block; a row with pos null tells a block's root."""
    names = ["tree", "block", "pos", "witness", "sides", "root"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.string()]
    out: list[list] = [[] for _ in names]

    def flush():
        batch = pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)
        for c in out:
            c.clear()
        return batch

    def block(key, first, n, state):
        root = state.finish(size if n > 1 << size else None)
        for i, (w, s) in enumerate(zip(state.witness, state.sides, strict=True)):
            for c, v in zip(out, (key[0], key[1], first + i, bytes.fromhex("".join(w)), "".join(s), None), strict=True):
                c.append(v)
        for c, v in zip(out, (key[0], key[1], None, None, None, root), strict=True):
            c.append(v)

    now, state, first, many = None, None, 0, 0
    for b in batches:
        for tree, pos, h, n in zip(*(b.column(k).to_pylist() for k in ("tree", "pos", "hash", "n")), strict=True):
            if (key := (tree, pos >> size)) != now:
                if now is not None:
                    block(now, first, many, state)
                now, state, first, many = key, Frontier(), pos, n
            state.append(h)
            if len(out[0]) >= BATCH:
                yield flush()
    if now is not None:
        block(now, first, many, state)
    if out[0]:
        yield flush()


def witnesses(nodes: DataFrame, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(tree, pos, witness, sides) of every node and (tree, root) of every tree.

    nodes: tree (string, not null), pos (gapless from 0 in its tree), hash
    (hex text), n (size of the tree).  Two nodes that follow each other become
    the digest of both, a last single one its own digest, until one is left; a
    tree of one node is that node.  witness has the siblings on the way up, 32
    bytes each, sides a character for each level: L, R, or - for none.
    """
    spark = nodes.sparkSession
    key = F.shiftright("pos", size)
    dealt = nodes.select("tree", "pos", "hash", "n", key.alias("block")).repartition(common.partitions(spark), "tree", "block").sortWithinPartitions("tree", "pos")
    done = dealt.mapInArrow(lambda it: _append(it, size), "tree string, block bigint, pos bigint, witness binary, sides string, root string")
    done = common.materialize(done, "manifest-blocks")
    leaves, blocks = done.where("pos is not null").drop("root"), done.where("pos is null").select("tree", "block", "root")
    if not blocks.where("block > 0").limit(1).count():
        return leaves.select("tree", "pos", "witness", "sides"), blocks.select("tree", "root")
    above = blocks.select("tree", F.col("block").alias("pos"), F.col("root").alias("hash")).join(blocks.groupBy("tree").agg(F.count("*").alias("n")), "tree")
    up, roots = witnesses(above, size)
    up = up.select("tree", F.col("pos").alias("block"), F.col("witness").alias("w"), F.col("sides").alias("s"))
    return leaves.join(up, ["tree", "block"]).select("tree", "pos", F.concat("witness", "w").alias("witness"), F.concat("sides", "s").alias("sides")), roots


def fold(start: Column, witness: Column, sides: Column) -> Column:
    """The root that a leaf and its witness lead to."""
    siblings = F.lower(F.hex(witness))

    def step(acc, i):
        side = sides.substr(i, F.lit(1))
        other = siblings.substr(acc["at"], F.lit(64))
        both = F.when(side == "L", F.concat(other, acc["h"])).when(side == "R", F.concat(acc["h"], other)).otherwise(acc["h"])
        return F.struct(F.sha2(both.cast("binary"), 256).alias("h"), (acc["at"] + F.when(side == "-", 0).otherwise(64)).alias("at"))

    steps = F.when(F.length(sides) > 0, F.sequence(F.lit(1), F.length(sides))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.struct(start.alias("h"), F.lit(1).alias("at")), step, lambda acc: acc["h"])


# ---------------------------------------------------------------- the manifest


def manifest(leaves: DataFrame, size: int = BLOCK) -> DataFrame:
    """The rows of leaves with subroot, root, witness and sides.

    leaves: group (string, null allowed), id, leaf (hex text), other columns.
    Leaves of a group stand by id (null first), equal ids by leaf; groups by
    their name, null first, bytewise.
    """
    # names sort by bytes; a null one stands before all
    rows = leaves.withColumn("tree", F.coalesce(F.concat(F.lit("="), "group"), F.lit("")))
    rows = numbered(rows, "tree", ["id", "leaf"], "manifest-leaves")
    own, subroots = witnesses(rows.select("tree", "pos", F.col("leaf").alias("hash"), "n"), size)
    subroots = common.materialize(subroots, "manifest-subroots")
    tops = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("hash")), "tree", ["name"], "manifest-groups")
    up, root = witnesses(tops.select("tree", "pos", "hash", "n"), size)
    # one row a group
    heads = tops.join(up, ["tree", "pos"]).join(root, "tree").select(F.col("name").alias("tree"), F.col("hash").alias("subroot"), "root", F.col("witness").alias("w"), F.col("sides").alias("s"))
    out = rows.join(own, ["tree", "pos"]).join(heads, "tree")
    return out.withColumn("witness", F.concat("witness", "w")).withColumn("sides", F.concat("sides", "s")).drop("tree", "w", "s", "n")


def tamper_proof(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """The manifest of documents and what it says after rows have been tampered with.

    Returns doc_id, leaf, subroot, root, proof_sha256 (of all siblings up to
    the root), folded_root (from the leaf as it is now and those siblings),
    verified, n_siblings.  Where 7 divides the CRC32 of doc_id, n_chars has
    grown by 1; a null doc_id or n_chars stays.  A group is a lang, null is
    one.  Repeated rows are leaves of their own that stand side by side; null
    columns and texts of any length are leaves like others; an empty table
    gives no rows; other columns are ignored.
    """
    row = lambda n: leaf(F.col("doc_id").cast("bigint"), F.col("source"), F.col("lang"), n, F.col("text"))
    n = F.col("n_chars").cast("bigint")
    struck = F.coalesce((F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary")) % 7 == 0) & n.isNotNull(), F.lit(False))
    leaves = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("lang").alias("group"), row(n).alias("leaf"), F.when(struck, row(n + 1)).alias("now"))
    m = manifest(leaves, size)
    m = m.withColumn("folded_root", fold(F.coalesce("now", "leaf"), F.col("witness"), F.col("sides")))
    return m.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.lower(F.hex("witness")).cast("binary"), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), (F.octet_length("witness") / 32).cast("bigint").alias("n_siblings"),
    )


#: The same by whole levels of every tree; CRC32 is worked out bit by bit.
MANIFEST_SQL = """
WITH RECURSIVE bits AS (SELECT b::BIGINT AS byte, b::BIGINT AS v, 0 AS k FROM range(256) t(b) UNION ALL SELECT byte, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT byte, v FROM bits WHERE k = 8),
ids AS (SELECT DISTINCT doc_id, doc_id::VARCHAR AS s FROM documents WHERE doc_id IS NOT NULL),
crc AS (SELECT doc_id, s, 4294967295::BIGINT AS v, 0 AS k FROM ids UNION ALL SELECT doc_id, s, xor(crc.v >> 8, t.v), k + 1 FROM crc JOIN crc_table t ON t.byte = xor(crc.v, ascii(s[k + 1])) & 255 WHERE k < length(s)),
struck AS (SELECT doc_id FROM crc WHERE k = length(s) AND xor(v, 4294967295) % 7 = 0),
f AS (SELECT doc_id, lang, n_chars, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents),
l AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
  CASE WHEN n_chars IS NOT NULL AND doc_id IN (SELECT doc_id FROM struck) THEN sha256(head || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) END AS now FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM l),
nodes AS (SELECT tree, 0 AS level, pos, n, leaf AS h FROM p UNION ALL SELECT tree, level + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 2),
sub AS (SELECT tree, h AS subroot FROM nodes WHERE n = 1), sp AS (SELECT *, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM sub),
tops AS (SELECT 0 AS level, pos, n, subroot AS h FROM sp UNION ALL SELECT level + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2),
walk AS (SELECT tree, pos AS leaf_pos, coalesce(now, leaf) AS h, 0 AS level, 0 AS tier, pos, n, '' AS proof FROM p
  UNION ALL SELECT w.tree, leaf_pos, CASE WHEN w.n = 1 THEN w.h ELSE sha256(CASE WHEN s.h IS NULL THEN w.h WHEN w.pos % 2 = 1 THEN s.h || w.h ELSE w.h || s.h END) END, CASE WHEN w.n = 1 THEN 0 ELSE w.level + 1 END, CASE WHEN w.n = 1 THEN 1 ELSE w.tier END,
    CASE WHEN w.n = 1 THEN sp.pos ELSE w.pos // 2 END, CASE WHEN w.n = 1 THEN sp.n ELSE (w.n + 1) // 2 END, proof || CASE WHEN w.n = 1 THEN '' ELSE coalesce(s.h, '') END
  FROM walk w JOIN sp ON sp.tree = w.tree LEFT JOIN (SELECT 0 AS tier, tree, level, pos, h FROM nodes UNION ALL SELECT 1, sp.tree, t.level, t.pos, t.h FROM tops t, sp) s ON s.tier = w.tier AND s.tree = w.tree AND s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.n > 1 OR w.tier = 0)
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, w.h AS folded_root, w.h = r.h AS verified, length(proof) // 64 AS n_siblings
FROM p JOIN walk w ON w.tree = p.tree AND w.leaf_pos = p.pos AND w.tier = 1 AND w.n = 1 JOIN sub ON sub.tree = p.tree, (SELECT h FROM tops WHERE n = 1) r
"""
