"""Prefix trie of conversations that share turns, from composable fingerprints.

A sequence of turns has the fingerprint sum of x_i * b^i modulo a prime, for
three primes, where x_i comes from the digest of turn i.  Pairs (fingerprint,
length) are a monoid: (f, m) and (g, n) make (f + b^m * g, m + n).  So prefixes
of a long conversation are put together from runs of turns, and a rebuilt
conversation - the head of one, the rest of another - from the fingerprints of
both, without a rebuilt text ever being written.  Equal fingerprints at equal
depth are a node.  Each member keeps a reference to the original turn that is
its last one; a node is only believed if all its members agree on the node
above and on the digest of the turn they refer to, else other bases are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: fixed values: primes below 2^31
PRIMES = (2147483647, 2147483629, 2147483587)
#: Turns that are numbered and summed together, and depths of a chain that are.
RUN = 4096
#: conv_ids that are joined to one piece of text.
IDS = 4096
#: Bits of a digest in one of the four numbers that stand for it.
DIGEST_BITS = 60
#: Most turns that a rebuilt conversation takes from another.
HEADS = 5

NO_TURN = -(2**63)


def _bases(primes: tuple[int, ...], attempt: int) -> list[int]:
    return [2 + int.from_bytes(sha256(f"base {attempt} {k}".encode()).digest()[:8], "big") % (p - 3) for k, p in enumerate(primes)]


def _power(base: int, prime: int, n: Column) -> Column:
    """base^n modulo prime for 0 <= n < 2^32, by four tables of 256 powers."""
    out = None
    for k in range(4):
        step, row = pow(base, 256**k, prime), [1]
        for _ in range(255):
            row.append(row[-1] * step % prime)
        x = F.get(F.expr(f"array({','.join(f'{v}L' for v in row)})"), F.shiftright(n.cast("bigint"), 8 * k).bitwiseAND(255).cast("int")).cast("bigint")
        out = x if out is None else out * x % prime
    return out


# ---------------------------------------------------------------- turns


def turns(messages: DataFrame) -> DataFrame:
    """conv_id, i (place from 0), chars (code points of the text), q (four numbers of the digest of role and text) of every turn.

    A conversation's turns stand by turn, null first, equal ones by role and
    text.  They are numbered in runs of RUN values of turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    q = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.conv(digest.substr(k * 15 + 1, F.lit(15)), 16, 10).cast("bigint"))
    # the beginning of a text orders nearly all ties; digests decide between texts that begin alike
    m = messages.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.coalesce(F.col("turn").cast("bigint"), F.lit(NO_TURN)).alias("t"),
        role.alias("role"), F.substring(text, 1, 64).alias("begin"), F.char_length(text).cast("bigint").alias("chars"), q.alias("q"),
    ).withColumn("run", F.when(F.col("t") == NO_TURN, F.col("t")).otherwise(F.floor(F.col("t") / RUN)))
    own = m.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "run").orderBy("t", "role", "begin", "q")) - 1).drop("t", "role", "begin")
    return common.materialize(own, "trie-turns")


def prefixes(own: DataFrame, primes: tuple[int, ...], bases: list[int]) -> DataFrame:
    """conv_id, i, chars, q, and for each prime f (of the turns up to this one) and g (of those before it).

    Sums run inside a run; runs are composed by the monoid.
    """
    k = range(len(primes))
    here = Window.partitionBy("conv_id", "run").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    x = own.select("*", *((F.get("q", F.lit(j)) % primes[j] * _power(bases[j], primes[j], F.col("k")) % primes[j]).alias(f"x{j}") for j in k))
    x = x.select("*", *((F.sum(f"x{j}").over(here) % primes[j]).alias(f"s{j}") for j in k))
    total = x.groupBy("conv_id", "run").agg(F.count("*").alias("n"), *(F.sum(f"x{j}").alias(f"x{j}") for j in k))
    past = Window.partitionBy("conv_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    total = total.withColumn("at", F.coalesce(F.sum("n").over(past), F.lit(0)))
    moved = total.select("conv_id", "run", "at", *((F.col(f"x{j}") % primes[j] * _power(bases[j], primes[j], F.col("at")) % primes[j]).alias(f"y{j}") for j in k))
    before = moved.select("conv_id", "run", "at", *((F.coalesce(F.sum(f"y{j}").over(past), F.lit(0)) % primes[j]).alias(f"o{j}") for j in k))
    out = x.join(before, ["conv_id", "run"])
    up = lambda j, c: (F.col(f"o{j}") + c * _power(bases[j], primes[j], F.col("at"))) % primes[j]
    return out.select(
        "conv_id", (F.col("at") + F.col("k")).cast("bigint").alias("i"), "chars", "q",
        *(up(j, F.col(f"s{j}")).alias(f"f{j}") for j in k), *(up(j, (F.col(f"s{j}") - F.col(f"x{j}") + primes[j]) % primes[j]).alias(f"g{j}") for j in k),
    )


# ---------------------------------------------------------------- rebuilt conversations


def members(pre: DataFrame, primes: tuple[int, ...], bases: list[int]) -> DataFrame:
    """Every prefix of every rebuilt conversation: c, d (depth), f (its fingerprints), g (of one turn less), q, chars, of, at (reference to the original turn), ended.

    Conversation c is the first h turns of conversation c - c % 100, then its
    own behind its first h; h = CRC32(c) % 6.
    """
    k = range(len(primes))
    heads = pre.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("i") < HEADS, F.struct("i", "chars", "q", *(f"f{j}" for j in k), *(f"g{j}" for j in k))))).alias("head"))
    heads = common.materialize(heads, "trie-heads")
    c = heads.withColumnRenamed("conv_id", "c").withColumn("base", F.col("c") - F.col("c") % 100).withColumn("h", (F.crc32(F.col("c").cast("string").cast("binary")) % 6).cast("int"))
    b = heads.select(F.col("conv_id").alias("base"), F.col("head").alias("base_head"))
    c = c.join(b, "base", "left").withColumn("base_head", F.slice(F.coalesce("base_head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h")))
    size = F.size("base_head")
    cut = F.get("head", F.least(F.col("h"), F.size("head")) - 1)
    c = c.select("c", "base", "h", "base_head", size.alias("hb"), (size + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("bigint").alias("len"), *(F.coalesce(F.get("base_head", size - 1)[f"f{j}"], F.lit(0)).alias(f"b{j}") for j in k), *(F.coalesce(cut[f"f{j}"], F.lit(0)).alias(f"c{j}") for j in k))
    c = common.materialize(c, "trie-conversations")
    # the part of others: bounded arrays
    x = F.col("x")
    taken = c.select("c", "base", "len", F.explode("base_head").alias("x")).select(
        "c", (x["i"] + 1).alias("d"), *(x[f"f{j}"].alias(f"f{j}") for j in k), *(x[f"g{j}"].alias(f"g{j}") for j in k), x["q"].alias("q"), x["chars"].alias("chars"), F.col("base").alias("of"), x["i"].alias("at"), "len"
    )
    # the own part: what was before the cut is taken off, and the rest moved behind the head
    inverse = [[pow(bases[j], -s, primes[j]) for s in range(HEADS + 1)] for j in k]
    shift = F.col("h") - F.col("hb")

    def moved(j, f):
        off = (f - F.col(f"c{j}") + primes[j]) % primes[j]
        return (F.col(f"b{j}") + off * F.get(F.array(*map(F.lit, inverse[j])), shift).cast("bigint")) % primes[j]

    own = pre.join(c.drop("base", "base_head"), pre["conv_id"] == c["c"]).where("i >= h")
    own = own.select("c", (F.col("i") - shift + 1).cast("bigint").alias("d"), *(moved(j, F.col(f"f{j}")).alias(f"f{j}") for j in k), *(moved(j, F.col(f"g{j}")).alias(f"g{j}") for j in k), "q", "chars", F.col("conv_id").alias("of"), F.col("i").alias("at"), "len")
    zero = F.lit(0).cast("bigint")
    root = c.select("c", zero.alias("d"), *(zero.alias(f"{a}{j}") for a in "fg" for j in k), F.array(*[zero] * 4).alias("q"), zero.alias("chars"), F.lit(None).cast("bigint").alias("of"), F.lit(None).cast("bigint").alias("at"), "len")
    out = root.unionByName(taken).unionByName(own)
    return out.select("c", "d", *(f"{a}{j}" for a in "fg" for j in k), *(F.get("q", F.lit(j)).alias(f"q{j}") for j in range(4)), "chars", "of", "at", (F.col("d") == F.col("len")).alias("ended"))


def group(rows: DataFrame, n: int) -> DataFrame:
    """The nodes: d, f, g, c (smallest member), chars, n_convs, and whether the members agree."""
    same = [f"g{j}" for j in range(n)] + [f"q{j}" for j in range(4)]
    g = rows.groupBy("d", *(f"f{j}" for j in range(n))).agg(F.min("c").alias("c"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), *(F.min(x).alias(x) for x in same), *(F.max(x).alias(f"{x}_") for x in same))
    agree = F.lit(True)
    for x in same:
        agree = agree & (F.col(x) == F.col(f"{x}_"))
    return g.select("d", *(f"{a}{j}" for a in "fg" for j in range(n)), "c", "n_convs", "chars", agree.alias("agree"))


def nodes(messages: DataFrame, primes: tuple[int, ...] = PRIMES, attempts: int = 16) -> tuple[DataFrame, DataFrame]:
    """(nodes, members) with fingerprints that no two different sequences share."""
    own = turns(messages)
    for attempt in range(attempts):
        bases = _bases(primes, attempt)
        rows = common.materialize(members(prefixes(own, primes, bases), primes, bases), "trie-members")
        found = common.materialize(group(rows, len(primes)), "trie-nodes")
        if not found.where("not agree").limit(1).count():
            return found.drop("agree"), rows
        common.drop_table(rows)
        common.drop_table(found)
    raise RuntimeError("too few different fingerprints: take larger primes")


# ---------------------------------------------------------------- sums over subtrees


def _suffix_sums(values: DataFrame, names: list[str]) -> DataFrame:
    """c, d and each name summed over the deeper nodes of the chain, itself included; in runs of RUN depths."""
    v = values.withColumn("run", F.floor(F.col("d") / RUN))
    later = Window.partitionBy("c").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    total = v.groupBy("c", "run").agg(*(F.sum(x).alias(x) for x in names)).select("c", "run", *(F.coalesce(F.sum(x).over(later), F.lit(0)).alias(f"{x}_") for x in names))
    here = Window.partitionBy("c", "run").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    return v.select("c", "d", "run", *(F.sum(x).over(here).alias(x) for x in names)).join(total, ["c", "run"]).select("c", "d", *((F.col(x) + F.col(f"{x}_")).alias(x) for x in names))


def subtree_sums(values: DataFrame, hangs: DataFrame, names: list[str]) -> DataFrame:
    """c, d and each name summed over the subtree of a node.

    Nodes with the same smallest member c are a chain, one below the other.
    values: c, d, names; hangs: c, pc, pd - the node that the chain of c hangs
    from, null for the root's.  The sum of a chain and of all that hangs from
    it takes as many rounds as the logarithm of the longest line of chains.
    """
    t = values.groupBy("c").agg(*(F.sum(x).alias(x) for x in names)).join(hangs.select("c", F.col("pc").alias("up")), "c")
    t = common.materialize(t, "trie-chains")
    while t.where("up is not null").limit(1).count():
        add = t.where("up is not null").groupBy(F.col("up").alias("c")).agg(*(F.sum(x).alias(f"{x}_") for x in names))
        above = t.select(F.col("c").alias("up"), F.col("up").alias("up2"))
        nxt = t.join(add, "c", "left").join(above, "up", "left").select("c", F.col("up2").alias("up"), *((F.col(x) + F.coalesce(f"{x}_", F.lit(0))).alias(x) for x in names))
        nxt = common.materialize(nxt, "trie-chains")
        common.drop_table(t)
        t = nxt
    below = t.drop("up").join(hangs, "c").where("pc is not null").groupBy(F.col("pc").alias("c"), F.col("pd").alias("d")).agg(*(F.sum(x).alias(f"{x}_") for x in names))
    return _suffix_sums(values.join(below, ["c", "d"], "left").select("c", "d", *((F.col(x) + F.coalesce(f"{x}_", F.lit(0))).alias(x) for x in names)), names)


# ---------------------------------------------------------------- ends


def _hash_lists(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined pieces of each key; rows come by key and in order, and no list is ever whole in memory."""
    out: list[list] = [[] for _ in range(len(keys) + 1)]
    names, types = [*keys, "ends_sha256"], [pa.int64()] * len(keys) + [pa.string()]
    now, state = None, sha256()

    def close():
        for c, v in zip(out, (*now, state.hexdigest()), strict=True):
            c.append(v)

    for b in batches:
        cols = [b.column(k).to_pylist() for k in keys]
        for *key, piece in zip(*cols, b.column("piece").to_pylist(), strict=True):
            if key != now:
                if now is not None:
                    close()
                now, state = key, sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if len(out[0]) >= 10_000:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)
            out = [[] for _ in out]
    if now is not None:
        close()
    if out[0]:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)


def ends(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ends_sha256: digest of the ascending list of the conversations that end there, joined in pieces first."""
    piece = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",")
    pieces = rows.where("ended").groupBy(*keys, F.floor(F.col("c") / IDS).alias("part")).agg(piece.alias("piece"))
    dealt = pieces.repartition(common.partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, "part")
    return dealt.mapInArrow(lambda it: _hash_lists(it, keys), ", ".join(f"{k} bigint" for k in keys) + ", ends_sha256 string")


# ---------------------------------------------------------------- the trie


def prefix_trie(messages: DataFrame, primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """The trie of all rebuilt conversations, one row a node.

    messages: conv_id, turn, role, text.  Returns conv_id (smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and turn_conv_id and turn_index, the original turn that is
    the node's last one (null for the root).  Null roles and texts are empty,
    null turns come first, rows without conv_id belong to no conversation;
    repeated rows are turns of their own, equal turns stand by role and text
    (texts that share 64 characters by digest).  Other columns are ignored;
    an empty table gives no rows.
    """
    found, rows = nodes(messages, primes)
    n = len(primes)
    f, g = [f"f{j}" for j in range(n)], [f"g{j}" for j in range(n)]
    children = found.where("d > 0").groupBy((F.col("d") - 1).alias("d"), *(F.col(a).alias(b) for a, b in zip(g, f, strict=True))).agg(F.count("*").alias("n_children"))
    found = found.join(children, ["d", *f], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    found = common.materialize(found.join(ends(rows, ["d", *f]), ["d", *f], "left"), "trie-found")
    # a chain hangs from the node above its first one; only there a parent must be looked up
    tops = found.groupBy("c").agg(F.min(F.struct("d", *g)).alias("top")).select("c", "top.*")
    first = found.where("d = 0").select(F.col("c").alias("pc")).limit(1)
    low = tops.where("d = 1").crossJoin(F.broadcast(first)).select("c", "pc", F.lit(0).cast("bigint").alias("pd"))
    above = found.select(F.col("c").alias("pc"), F.col("d").alias("pd"), *(F.col(a).alias(b) for a, b in zip(f, g, strict=True)))
    deep = tops.where("d > 1").withColumn("pd", F.col("d") - 1).join(above, ["pd", *g]).select("c", "pc", "pd")
    none = F.lit(None).cast("bigint")
    hangs = common.materialize(low.union(deep).union(tops.where("d = 0").select("c", none, none)), "trie-hangs")
    values = found.select("c", "d", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    sums = subtree_sums(values, hangs, ["n_leaves", "saved_tokens"])
    refs = rows.select("c", "d", F.col("of").alias("turn_conv_id"), F.col("at").alias("turn_index"))
    out = found.join(sums, ["c", "d"]).join(hangs.select("c", (F.col("pd") + 1).alias("d"), "pc"), ["c", "d"], "left").join(refs, ["c", "d"])
    return out.select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") > 0, F.coalesce("pc", "c")).alias("parent_conv_id"), "n_convs", F.col("n_children").cast("bigint").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"), "turn_conv_id", "turn_index",
    )


#: The same by comparing whole rebuilt sequences; CRC32 is worked out bit by bit.
TRIE_SQL = """
WITH RECURSIVE bits AS (SELECT b::BIGINT AS byte, b::BIGINT AS v, 0 AS k FROM range(256) t(b) UNION ALL SELECT byte, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc_table AS (SELECT byte, v FROM bits WHERE k = 8),
ids AS (SELECT DISTINCT conv_id AS c, conv_id::VARCHAR AS s FROM conversations WHERE conv_id IS NOT NULL),
crc AS (SELECT c, s, 4294967295::BIGINT AS v, 0 AS k FROM ids UNION ALL SELECT c, s, xor(crc.v >> 8, t.v), k + 1 FROM crc JOIN crc_table t ON t.byte = xor(crc.v, ascii(s[k + 1])) & 255 WHERE k < length(s)),
h AS (SELECT c, c - c % 100 AS base, xor(v, 4294967295) % 6 AS h FROM crc WHERE k = length(s)),
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i, strlen(coalesce(role, '')) || ':' || coalesce(role, '') || strlen(coalesce(text, '')) || ':' || coalesce(text, '') AS x, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
hb AS (SELECT h.c, any_value(h.h) AS h, any_value(h.base) AS base, count(t.i) AS hb FROM h LEFT JOIN t ON t.c = h.base AND t.i < h.h GROUP BY 1),
r AS (SELECT hb.c, t.i + 1 AS d, t.x, t.chars, t.c AS o, t.i FROM hb JOIN t ON t.c = hb.base AND t.i < hb.h UNION ALL SELECT hb.c, hb.hb + t.i - hb.h + 1, t.x, t.chars, t.c, t.i FROM hb JOIN t ON t.c = hb.c AND t.i >= hb.h),
m AS (SELECT c, d, string_agg(x, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS p, chars, o, i FROM r UNION ALL SELECT c, 0, '', 0, NULL, NULL FROM hb),
n AS (SELECT d, p, min(c) AS c, count(*) AS n_convs, any_value(chars) AS chars, arg_min(o, c) AS turn_conv_id, arg_min(i, c) AS turn_index FROM m GROUP BY d, p),
e AS (SELECT m.c, max(m.d) AS d FROM m GROUP BY 1),
x AS (SELECT m.d, m.p, sha256(string_agg(m.c::VARCHAR, ',' ORDER BY m.c)) AS ends FROM m JOIN e USING (c, d) GROUP BY 1, 2),
up AS (SELECT n.d, n.p, q.c AS parent, q.p AS pp FROM n JOIN m ON m.c = n.c AND m.d = n.d - 1 JOIN n q ON q.d = m.d AND q.p = m.p),
k AS (SELECT d - 1 AS d, pp AS p, count(*) AS n_children FROM up GROUP BY 1, 2),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (d, p)),
s AS (SELECT m.d, m.p, sum((v.n_children = 0)::INT)::BIGINT AS n_leaves, sum((v.n_convs - 1) * v.chars)::BIGINT AS saved_tokens FROM v JOIN m ON m.c = v.c AND m.d <= v.d GROUP BY 1, 2)
SELECT v.c AS conv_id, v.d AS depth, up.parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, coalesce(ends, sha256('')) AS ends_sha256, turn_conv_id, turn_index
FROM v JOIN s USING (d, p) LEFT JOIN up USING (d, p) LEFT JOIN x USING (d, p)
"""
