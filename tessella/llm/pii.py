"""Personal data: fixed patterns, then bootstrapped contextual extraction, in DataFrame functions only.

Fixed patterns find e-mail addresses, IP addresses, card and phone numbers.
These entities are the seeds of the bootstrap: the two words before a seed are
a lexical pattern if seeds are a fair share of what follows it, and every word
that follows such a pattern anywhere is an instance of it.  Scores flow from
seeds to patterns and back over the graph of patterns and instances for a few
rounds, as joins and grouped sums; patterns of high confidence mark the unseen
identifiers that follow them, and these are seeds of further patterns, pass by
pass.

Regular expressions are written so that Java matches them without recursion
or backtracking over long runs; each finds what its plain form in the comments
finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# Plain forms:
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+      ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+                                  phone \+[0-9][\x20().0-9-]+[0-9]
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: On a text in which single separators between digits are \x01; shorter runs can't hold 12 digits.
CARD = "(?<![0-9\x01])[0-9][0-9\x01]{11,}+"
IP_PARTS = r"^(?:0*+(?:(?<=0)|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
#: Signs around a word that belong to the sentence.
BEFORE, BEHIND = r"^[^\p{L}\p{N}]*+", r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$"
#: First character of a seed in the marked text, and white space within it.
MARK, GLUE = "\x02", "\x03"

KINDS = ["email", "ip", "card", "phone", "ident"]
SPANS = "array<struct<s:int,e:int>>"
#: Rounds of scoring; a pattern counts if so many different seeds follow it and seeds are this share of what follows it, and is used if this share of its weight speaks for it.
ROUNDS, SUPPORT, SHARE, CONFIDENCE = 3, 5, 0.2, 0.8
#: Score of an instance over all patterns it follows, from which a good pattern marks it.
PLAUSIBLE = 0.5
#: Passes of the bootstrap at most: patterns, instances behind them, patterns of these instances, and so on.
PASSES = 4


def _found(text: Column, pattern: str, when: Column) -> Column:
    """Array of (s, e, m): code points of each match, and the match."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    size = lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))
    start = lambda y: y["before"] + F.length(y["x"]["p"])
    found = F.transform(F.flatten(common.running(both, size, lambda a, b: a + b, 0)), lambda y: F.struct(start(y).alias("s"), (start(y) + F.length(y["x"]["m"])).alias("e"), y["x"]["m"].alias("m")))
    out = "array<struct<s:int,e:int,m:string>>"
    return F.when(when & text.rlike(pattern), F.filter(found, lambda x: x["m"].isNotNull()).cast(out)).otherwise(F.array().cast(out))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    n = F.length(d)

    def add(acc, i):
        v = d.substr(i, F.lit(1)).cast("int")
        twice = (n - i) % 2 == 1
        return acc + F.when(twice & (v > 4), 2 * v - 9).when(twice, 2 * v).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """The checked matches of each kind in a text (not null)."""
    joined = F.regexp_replace(F.translate(text, "\x01", "\x02"), r"(?<=[0-9])[ -](?=[0-9])", "\x01")
    found = {
        "email": _found(text, EMAIL, F.contains(text, F.lit("@"))),
        "ip": F.filter(_found(text, IP, F.lit(True)), lambda x: x["m"].rlike(IP_PARTS)),
        "card": F.filter(_found(joined, CARD, F.lit(True)), lambda x: F.length(_digits(x["m"])).between(12, 19) & _luhn(_digits(x["m"]))),
        "phone": F.filter(_found(text, PHONE, F.contains(text, F.lit("+"))), lambda x: F.length(_digits(x["m"])).between(9, 15)),
    }
    return {k: F.transform(v, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for k, v in found.items()}


def _sorted(kinds: list[str]) -> Column:
    def tag(i: int):
        return lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e"))

    tagged = [F.transform(k, tag(i)) for i, k in enumerate(KINDS) if k in kinds]
    return F.array_sort(F.concat(*tagged))


def _replaced(text: Column, spans: Column, new) -> Column:
    """The text with new(span, its text) in the place of each span; of spans that overlap the first counts, the others go.

    spans: sorted array of s, k, e.  The text is cut once for each part of
    some spans and the piece cut again, so long texts with many spans take
    about linear time.
    """

    def piece(part, text):
        start = F.get(part, F.lit(0))["before"]
        end = F.greatest(F.element_at(part, -1)["before"], F.element_at(part, -1)["x"]["e"])

        def one(cut):
            sub = lambda a, b: cut.substr(a - start + 1, b - a)
            return F.transform(part, lambda y: F.when(y["x"]["s"] >= y["before"], F.concat(sub(y["before"], y["x"]["s"]), new(y["x"], sub(y["x"]["s"], y["x"]["e"])))).otherwise(F.lit("")))

        return common.let(text.substr(start + 1, end - start), lambda cut: F.array_join(one(cut), ""))

    end = F.coalesce(F.array_max(F.transform(spans, lambda x: x["e"])), F.lit(0))
    parts = common.running(spans, lambda x: x["e"], F.greatest, 0)
    return common.let(text, lambda t: F.concat(F.coalesce(F.array_join(F.transform(parts, lambda p: piece(p, t)), ""), F.lit("")), t.substr(end + 1, F.length(t))))


def _key(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")]


def first_pass(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, arrays of the base spans of each kind, and marked.

    marked is the text, character for character, but that a base span begins
    with MARK and has GLUE for white space, so it is one word or part of one.
    """
    clean = F.translate("text", MARK + GLUE, "\x04\x04")
    src = docs.select(*_key(docs), F.coalesce("text", F.lit("")).alias("t"))
    src = src.select("*", *(v.alias(k) for k, v in base_spans(F.col("t")).items()))
    src = src.select("*", _sorted(KINDS[:4]).alias("spans")).withColumn("text", F.col("t"))
    glued = lambda x, m: F.concat(F.lit(MARK), F.regexp_replace(m.substr(F.lit(2), F.length(m)), r"\s", GLUE))
    marked = F.when(F.size("spans") > 0, _replaced(clean, F.col("spans"), glued)).otherwise(clean)
    return src.select("doc_id", "text_hash", *KINDS[:4], marked.alias("marked"))


def follows(marked: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """pattern, word, i and the other columns of marked: every word, the hash of the two before it, and its place.

    only: hashes; rows of other patterns go, all but a few, before anything is shuffled.
    """
    low = F.lower
    words = F.regexp_extract_all("marked", F.lit(r"\S+"), F.lit(0))
    one = lambda w: F.filter(F.transform(w, lambda x, i: F.when(i >= 2, F.struct(F.xxhash64(low(F.get(w, i - 2)), low(F.get(w, i - 1))).alias("pattern"), x.alias("word"), i.alias("i")))), lambda x: x.isNotNull())
    rest = [c for c in marked.columns if c != "marked"]
    rows = marked.select(*rest, F.explode(common.let(words, one)).alias("x")).select(*rest, "x.pattern", "x.word", "x.i")
    return rows if only is None else common.might_match(rows, "pattern", only)


def _core(word: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(word, BEHIND, ""), BEFORE, "")


def score_patterns(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Scores of lexical patterns and of instances by mutual reinforcement.

    edges: pattern, instance, seed, n.  A seed scores 1; a pattern scores the
    mean of its instances, weighted by their counts and shrunk by one unseen
    instance; another instance passes on the mean of its patterns, shrunk by
    one unseen pattern, so that a pattern can't raise itself by instances of
    its own.  Returns pattern, score, support (instances with a score over
    1/2); and instance, seed, score (the mean of its patterns, 1 for seeds).
    """
    inst = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("fixed"))
    e = edges.groupBy("pattern", "instance").agg(F.sum("n").alias("n")).join(inst, "instance")
    e, last = e.withColumn("score", F.col("fixed")), None
    for k in range(rounds):
        pat = e.groupBy("pattern").agg((F.sum(F.col("n") * F.col("score")) / (F.sum("n") + 1)).alias("p"), F.sum((F.col("score") > 0.5).cast("int")).alias("support"))
        met = e.join(pat, "pattern").groupBy("instance").agg((F.sum(F.col("n") * F.col("p")) / F.sum("n")).alias("q"), F.max("fixed").alias("own"), F.count("*").alias("patterns"))
        if k == rounds - 1:
            return pat.select("pattern", F.col("p").alias("score"), "support"), met.select("instance", (F.col("own") == 1).alias("seed"), F.greatest("own", "q").alias("score"))
        up = met.select("instance", F.greatest("own", F.col("q") * F.col("patterns") / (F.col("patterns") + 1)).alias("score"))
        e = common.materialize(e.drop("score").join(up, "instance"), "pii-scores")
        if last is not None:
            common.drop_table(last)
        last = e


def _instance(word: Column) -> Column:
    return F.lower(_core(word))


def _uses(marked: DataFrame, instances: DataFrame) -> DataFrame:
    """pattern, instance, n: how often each of the instances follows each pair of words."""
    keys = instances.select(F.xxhash64("instance").alias("h"))
    rows = follows(marked).where(~F.contains("word", F.lit(MARK))).withColumn("instance", _instance(F.col("word")))
    rows = common.might_match(rows.withColumn("__h", F.xxhash64("instance")), "__h", keys)
    return rows.join(instances, "instance", "left_semi").groupBy("pattern", "instance").agg(F.count("*").alias("n"))


def _promote(edges: DataFrame, promoted: DataFrame) -> DataFrame:
    """edges (pattern, instance, seed, n) in which promoted instances count as seeds."""
    flagged = edges.join(promoted.withColumn("__p", F.lit(True)), "instance", "left")
    return flagged.select("pattern", "instance", (F.col("seed") | F.coalesce("__p", F.lit(False))).alias("seed"), "n")


def _induced(marked: DataFrame, seeds: DataFrame, tried: DataFrame | None, promoted: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Patterns that enough seeds follow and that weren't tried, and the edges (pattern, instance, seed, n) of those with a fair share of seeds."""
    known = seeds.groupBy("pattern").agg(F.countDistinct("instance").alias("n")).where(F.col("n") >= SUPPORT).select("pattern")
    if tried is not None:
        known = known.join(tried, "pattern", "left_anti")
    known = common.materialize(known, "pii-known")
    if tried is not None and known.isEmpty():
        return known, None
    words = follows(marked, known.select("pattern")).groupBy("pattern", "word").agg(F.count("*").alias("n"))
    seen = words.select("pattern", _instance(F.col("word")).alias("instance"), F.contains("word", F.lit(MARK)).alias("seed"), "n")
    seen = common.materialize(seen if promoted is None else _promote(seen, promoted), "pii-seen")
    shares = seen.groupBy("pattern").agg((F.sum(F.when(F.col("seed"), F.col("n")).otherwise(0)) / F.sum("n")).alias("share"))
    # summed before they meet what is known: rows that the bit filter let pass go with their pattern
    fair = common.materialize(shares.where(F.col("share") >= SHARE).select("pattern").join(known, "pattern", "left_semi"), "pii-fair")
    edges = seen.where("instance <> ''").join(fair, "pattern")
    edges = common.materialize(edges.groupBy("pattern", "instance", "seed").agg(F.sum("n").alias("n")), "pii-edges")
    for table in (seen, fair):
        common.drop_table(table)
    return known, edges


def bootstrap(marked: DataFrame, passes: int = PASSES) -> tuple[DataFrame, DataFrame]:
    """Good patterns (pattern), and the identifiers (instance) that they may mark, of texts with marked seeds.

    A pass induces patterns from the seeds, scores them, and takes the
    plausible instances behind those of high confidence.  Of these, the ones
    that follow good patterns in a share SHARE of all their places become
    seeds of the next pass; a common word that stands behind a pattern now and
    then doesn't.  Passes end when no instance becomes a seed, when no new
    pattern is followed by enough seeds, or after so many of them.
    """
    base = follows(marked.where(F.contains("marked", F.lit(MARK)))).where(F.contains("word", F.lit(MARK)))
    base = base.select("pattern", _instance(F.col("word")).alias("instance"))
    seeds, tried, edges, good, fit, promoted, old = base, None, None, None, None, None, []
    for k in range(passes):
        known, found = _induced(marked, seeds, tried, promoted)
        old.append(known)
        if found is None:
            break
        old.append(found)
        tried = known if tried is None else tried.union(known)
        edges = found if edges is None else common.materialize(_promote(edges, promoted).union(found), "pii-edges")
        old.append(edges)
        patterns, instances = score_patterns(edges)
        strong = patterns.where((F.col("score") >= CONFIDENCE) & (F.col("support") >= SUPPORT)).select("pattern")
        good = common.materialize(strong if good is None else strong.union(good).distinct(), "pii-good")
        plausible = instances.where(~F.col("seed") & (F.col("score") >= PLAUSIBLE)).select("instance")
        new = edges.join(good, "pattern", "left_semi").select("instance").distinct().join(plausible, "instance", "left_semi")
        fit = common.materialize(new if fit is None else new.union(fit).distinct(), "pii-fit")
        old += [good, fit]
        common.drop_table(instances)
        if k == passes - 1 or fit.isEmpty():
            break
        uses = common.materialize(_uses(marked, fit), "pii-uses")
        behind = uses.join(good.withColumn("__g", F.lit(1)), "pattern", "left")
        shares = behind.groupBy("instance").agg((F.sum(F.col("n") * F.coalesce("__g", F.lit(0))) / F.sum("n")).alias("share"))
        now = shares.where(F.col("share") >= SHARE).select("instance")
        now = common.materialize(now if promoted is None else now.union(promoted).distinct(), "pii-seeds")
        old += [uses, now]
        if now.count() == (0 if promoted is None else promoted.count()):
            break
        promoted = now
        seeds = base.union(uses.join(promoted, "instance", "left_semi").select("pattern", "instance"))
    for table in old:
        if table is not good and table is not fit:
            common.drop_table(table)
    return good, fit


def find_pii(docs: DataFrame) -> DataFrame:
    """Personal data in every whole text.

    Returns one row an input row: doc_id, text_hash (xxhash64 of the text), and
    email, ip, card, phone, ident: arrays of (s, e), code points, end
    exclusive, each in order.  ident are words, without the punctuation around
    them, that follow a pattern of high confidence, are plausible by all
    patterns they follow, and overlap none of the others; see bootstrap().  A
    null text counts as empty and has no spans.  Equal texts get equal spans;
    repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    one = common.materialize(first_pass(docs), "pii-spans")
    good, fit = bootstrap(one.select("marked"))
    hit = follows(one.select("doc_id", "text_hash", "marked"), good.select("pattern")).where(~F.contains("word", F.lit(MARK)))
    hit = hit.join(good, "pattern", "left_semi").withColumn("instance", _instance(F.col("word"))).join(fit, "instance", "left_semi")
    places = common.materialize(hit.groupBy("doc_id", "text_hash").agg(F.collect_set("i").alias("places")), "pii-places")
    for table in (good, fit):
        common.drop_table(table)
    o, m = one.alias("o"), places.alias("m")
    both = o.join(m, F.col("o.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("o.text_hash") == F.col("m.text_hash")), "left").select("o.*", "places")

    def pick(words):
        cut = F.transform(F.array_sort("places"), lambda i: F.get(words, i))
        cut = F.transform(cut, lambda x: F.struct((x["s"] + F.length(F.regexp_extract(x["m"], BEFORE, 0))).alias("s"), (x["e"] - F.length(F.regexp_extract(x["m"], BEHIND, 0))).alias("e")))
        return common.let(F.concat(*KINDS[:4]), lambda base: F.filter(cut, lambda x: ~F.exists(base, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))))

    ident = F.when(F.col("places").isNotNull(), common.let(_found(F.col("marked"), r"\S++", F.lit(True)), pick)).otherwise(F.array().cast(SPANS))
    return both.select("doc_id", "text_hash", *KINDS[:4], ident.cast(SPANS).alias("ident"))


def _spelled(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of each base kind, a digest of the base spans, all spans spelled out, n_ident.

    One row an input row, also for repeated ones, which get equal results; a
    null text counts as empty; other columns, whatever their names, are
    ignored; an empty table gives no rows.
    """
    found = find_pii(docs)
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(_spelled(_sorted(KINDS[:4])), 256).alias("base_sha256"), _spelled(_sorted(KINDS)).alias("spans"), F.size("ident").cast("bigint").alias("n_ident"))


def mask(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; overlapping spans become one.

    All rows and columns stay, repeated rows too; null texts stay null; an
    empty table gives no rows.  Columns named like the kinds or beginning with
    two underscores don't clash but for __th, __id, __hash and __spans.
    """
    found = find_pii(docs)
    per = found.where(F.size(F.concat(*KINDS)) > 0).groupBy("doc_id", "text_hash").agg(*(F.first(k).alias(k) for k in KINDS))
    spans = per.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), _sorted(KINDS).alias("__spans"))
    src = docs.withColumn("__th", F.xxhash64(F.coalesce("text", F.lit(""))))
    both = src.join(spans, src["doc_id"].cast("bigint").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__hash")), "left")
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    masked = _replaced(F.col("text"), F.col("__spans"), lambda x, m: F.element_at(names, x["k"] + 1))
    return both.select(*(F.when(F.col("__spans").isNull(), F.col("text")).otherwise(masked).alias("text") if c == "text" else F.col(c) for c in docs.columns))
