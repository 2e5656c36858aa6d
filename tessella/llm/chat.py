"""Chat formatting by quotation linking.

Lines that begin with > are quotations, as deep as they have marks;
consecutive lines of one level are a passage.  Quoted passages are normalised
- white space, case and the way lines are wrapped don't count - cut into
sentences and lines, hashed, and joined to the messages whose own text holds
them: first within the conversation, then anywhere.  A message answers the
one that most of its first-level quotations come from; conversations are put
together in the order of replies, without the quotations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Shorter sentences are too common to tell a message of another conversation by.
MIN_CHARS = 10
#: Thread roots numbered together when positions are dealt.
SPAN = 1000
#: Between paragraphs of a passage while it is one string.
PAGE = "\x1e"


def _plain(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def _units(bodies: Column) -> Column:
    """Sentences and lines of a passage (array of its lines), normalised: distinct, none empty."""
    text = F.array_join(F.transform(bodies, lambda x: F.when(F.trim(x) == "", F.lit(PAGE)).otherwise(x)), " ")
    parts = F.split(F.regexp_replace(text, r"(?<=[.!?])\s", PAGE), PAGE)
    return F.filter(F.array_distinct(F.concat(F.transform(parts, _plain), F.transform(bodies, _plain))), lambda x: x != "")


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, ck, tk, th (keys without nulls), lines (array of level, body), passages (array of level, units)."""
    mark = lambda x: F.regexp_extract(x, r"^>[> \t]*+", 0)
    cut = F.transform(
        F.split(F.coalesce("text", F.lit("")), "\n", -1),
        lambda x: common.let(mark(x), lambda m: F.struct(F.length(F.regexp_replace(m, "[^>]", "")).alias("level"), x.substr(F.length(m) + 1, F.length(x)).alias("body"))),
    )

    def runs(lines):
        heads = F.filter(F.transform(lines, lambda x, i: F.when((i == 0) | (F.get(lines, i - 1)["level"] != x["level"]), i + 1)), lambda i: i.isNotNull())
        one = lambda h: lambda at, k: F.slice(lines, at, F.coalesce(F.get(h, k + 1), F.size(lines) + 1) - at)
        return common.let(heads, lambda h: F.transform(F.transform(h, one(h)), lambda r: F.struct(F.get(r, F.lit(0))["level"].alias("level"), _units(F.transform(r, lambda x: x["body"])).alias("units"))))

    src = messages.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role",
        F.coalesce(F.col("conv_id").cast("bigint"), F.lit(-(2**63))).alias("ck"), F.coalesce(F.col("turn").cast("bigint"), F.lit(-1)).alias("tk"),
        F.xxhash64(F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))).alias("th"), cut.alias("lines"),
    )
    return src.withColumn("passages", common.let(F.col("lines"), runs))


def _links(parsed: DataFrame) -> DataFrame:
    """ck, tk, th, pc, pt, n_links: the message that each quoting message answers, and its quoted passages with a known source."""
    unit = parsed.select("ck", "tk", "th", F.posexplode("passages").alias("p", "x")).select("ck", "tk", "th", "p", "x.level", F.explode("x.units").alias("u"))
    unit = unit.select("ck", "tk", "th", "p", "level", F.xxhash64("u").alias("hash"), (F.length("u") >= MIN_CHARS).alias("long"))
    quoted = unit.where("level > 0")
    # the indexes hold one row for each hash and conversation, and two for each hash, pre-aggregated
    local = unit.where("level = 0").join(quoted.select("hash").distinct(), "hash", "left_semi").groupBy("ck", "hash").agg(F.min("tk").alias("lt"))
    local = common.materialize(local, "chat-local")
    first = common.materialize(local.groupBy("hash").agg(F.min(F.struct("ck", "lt")).alias("g")), "chat-first")
    second = local.join(first, "hash").where(F.col("ck") != F.col("g.ck")).groupBy("hash").agg(F.min(F.struct("ck", "lt")).alias("g2"))
    q = quoted.join(local, ["ck", "hash"], "left").withColumn("lt", F.when(F.col("lt") < F.col("tk"), F.col("lt")))
    q = q.join(first.join(second, "hash", "left"), "hash", "left")
    other = F.when(F.col("g.ck") != F.col("ck"), F.col("g")).otherwise(F.col("g2"))
    q = q.withColumn("far", F.when(F.col("lt").isNull() & F.col("long"), other))
    q = q.select("ck", "tk", "th", "p", "level", F.when(F.col("lt").isNotNull(), F.col("ck")).otherwise(F.col("far.ck")).alias("pc"), F.coalesce("lt", "far.lt").alias("pt")).where("pt is not null")
    # a passage comes from the message that most of its units are from; a message answers the one most first-level units are from
    votes = q.groupBy("ck", "tk", "th", "pc", "pt").agg(F.sum((F.col("level") == 1).cast("int")).alias("v"))
    known = q.groupBy("ck", "tk", "th").agg(F.countDistinct("p").alias("n_links"))
    best = F.max(F.struct("v", (F.col("pc") == F.col("ck")).alias("near"), "pt", "pc"))
    top = votes.groupBy("ck", "tk", "th").agg(best.alias("b")).join(known, ["ck", "tk", "th"])
    return top.select("ck", "tk", "th", F.when(F.col("b.v") > 0, F.col("b.pc")).alias("pc"), F.when(F.col("b.v") > 0, F.col("b.pt")).alias("pt"), "n_links")


def _roots(links: DataFrame) -> DataFrame:
    """ck, tk, root, path (turns from the root to the parent) of messages that answer one of their own conversation, by pointer jumping.

    Each round halves the way to the root; replies point back in time, so
    there are no cycles.  A path is as long as its message is deep.
    """
    up = links.where("pc = ck").groupBy("ck", "tk").agg(F.max("pt").alias("root")).withColumn("path", F.array("root"))
    up = common.materialize(up, "chat-up")
    while True:
        above = up.select("ck", F.col("tk").alias("root"), F.col("root").alias("r2"), F.col("path").alias("p2"))
        nxt = up.join(above, ["ck", "root"], "left")
        nxt = common.materialize(nxt.select("ck", "tk", F.coalesce("r2", "root").alias("root"), F.when(F.col("p2").isNull(), F.col("path")).otherwise(F.concat("p2", "path")).alias("path"), F.col("r2").isNotNull().alias("moved")), "chat-up")
        more = nxt.where("moved").limit(1).count()
        common.drop_table(up)
        up = nxt.drop("moved")
        if not more:
            return up


def _positions(df: DataFrame) -> DataFrame:
    """Adds position: gapless from 0 in a conversation, each message behind the one it answers and its earlier replies; numbered in spans of roots that follow each other."""
    df = df.withColumn("span", F.floor(F.col("root") / SPAN))
    counts = df.groupBy("ck", "span").agg(F.count("*").alias("n"))
    before = counts.select("ck", "span", F.coalesce(F.sum("n").over(Window.partitionBy("ck").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = df.withColumn("row", F.row_number().over(Window.partitionBy("ck", "span").orderBy("path", "th")))
    return own.join(before, ["ck", "span"]).withColumn("position", (F.col("row") - 1 + F.col("before")).cast("bigint"))


def link_quotations(messages: DataFrame) -> DataFrame:
    """Conversations in the order of replies, without quotations.

    messages: conv_id, turn, role, text.  Returns one row a message: conv_id,
    turn, role, body (its own lines), n_quoted (quoted lines), max_level,
    n_links (quoted passages with a known source), parent_conv and parent_turn
    (the message it answers, null if it quotes nothing known; of equal votes
    the later turn), depth (steps to the root of its thread), root_turn,
    position (gapless from 0 in its conversation: threads by the turn of their
    root, each message followed by its replies by turn and theirs).  A
    sentence or line counts as quoted from the earliest earlier turn of the
    conversation that has it in its own text, else, if it has MIN_CHARS, from
    the first message of another conversation.  Null texts are empty; null conv_ids are one conversation, null turns come
    first; repeated rows stay and get places of their own; other columns are
    ignored; an empty table gives no rows.
    """
    parsed = common.materialize(parse(messages), "chat-lines")
    links = common.materialize(_links(parsed), "chat-links")
    roots = _roots(links)
    own = F.filter("lines", lambda x: x["level"] == 0)
    body = F.array_join(F.transform(own, lambda x: x["body"]), "\n")
    m = parsed.select("conv_id", "turn", "role", "ck", "tk", "th", F.trim(body).alias("body"), F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("bigint").alias("n_quoted"), F.array_max(F.transform("lines", lambda x: x["level"])).cast("bigint").alias("max_level"))
    m = m.join(links, ["ck", "tk", "th"], "left").join(roots, ["ck", "tk"], "left")
    m = m.withColumn("depth", F.coalesce(F.size("path"), F.lit(0)).cast("bigint")).withColumn("depth", F.greatest("depth", F.lit(0).cast("bigint")))
    m = m.withColumn("path", F.concat(F.coalesce("path", F.array().cast("array<bigint>")), F.array("tk"))).withColumn("root", F.coalesce("root", "tk"))
    null_key = lambda c, low: F.when(F.col(c) != F.lit(low), F.col(c))
    return _positions(m).select(
        "conv_id", "turn", "role", "body", "n_quoted", "max_level", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        null_key("pc", -(2**63)).alias("parent_conv"), null_key("pt", -1).alias("parent_turn"), "depth", null_key("root", -1).alias("root_turn"), "position",
    )

