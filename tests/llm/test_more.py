"""PII, quotation linking, passages, archive audit and toxicity against brute force or planted cases."""

import hashlib
import random
import re
import textwrap
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import chat, pii, substring, toxicity, warc

SF = "/root/testdata/sf0.001"


def luhn(d):
    v = [int(c) for c in d][::-1]
    return (sum(v[0::2]) + sum(2 * x - 9 * (x > 4) for x in v[1::2])) % 10 == 0


def base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def texts():
    r = random.Random(4)
    out = ["", None, "a@b.c_d@e.f x@y a@b..c @b.c a@b.c%d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 0.0.0.0 1.2.3.0255", "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111111 4111  1111 1111 1111",
           "+1 (234) 567-8901 +49 30 123456 +1.2 +12345678901234567890", "\x014111111111111111 é中😀a@b.co 😀1.2.3.4", "9" * 3000, "a" * 20000 + "@", "1 2 " * 4000, "1.2." * 3000]
    for n in range(600):
        out.append("".join(r.choice("0123456789" * 2 + ".@ -+ab()_\n") for _ in range(r.randint(1, 120))))
        d = "".join(r.choice("0123456789") for _ in range(r.randint(10, 18)))
        c = next(x for x in "0123456789" if luhn(d + x))
        out.append("x " + r.choice([" ", "-", ""]).join((d + c)[i : i + 4] for i in range(0, len(d) + 1, 4)) + r.choice(["", " 7", "-", "x"]))
    return out


def test_pii_base(spark):
    rows = [(i if i % 50 else None, t, "clash") for i, t in enumerate(texts())] + [(3, texts()[3], "again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, email string").repartition(4)
    want = Counter()
    for d, t, _ in rows:
        b = base(t or "")
        n = Counter(k for _, k, _ in b)
        want[d, n[0], n[1], n[2], n[3], hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in b).encode()).hexdigest()] += 1
    got = pii.report(df).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    assert pii.report(df.limit(0)).count() == 0
    masked = {(r.doc_id, r.text) for r in pii.mask(df.where("doc_id = 6")).collect()}
    assert masked == {(6, "\x01<CARD> é中😀<EMAIL> 😀<IP>")}


def test_pii_long_labels_and_many_matches(spark):
    """Neither deep recursion in a long address nor time that grows with the square of the matches."""
    label = "a@b" + ".c" * 50_000
    many = "u1@x.org 10.0.0.1 " * 16_000
    df = spark.createDataFrame([(1, label + " end"), (2, many), (3, "no data " * 100_000)], "doc_id bigint, text string")
    start = time.time()
    got = {r.doc_id: r for r in pii.report(df).collect()}
    assert (got[1].n_email, got[1].spans) == (1, f"email:0:{len(label)}")
    assert (got[2].n_email, got[2].n_ip, got[3].n_email) == (16_000, 16_000, 0)
    assert got[2].base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base(many)).encode()).hexdigest()
    assert {r.doc_id: r.text for r in pii.mask(df).collect()} == {1: "<EMAIL> end", 2: "<EMAIL> <IP> " * 16_000, 3: "no data " * 100_000}
    assert time.time() - start < 90


def test_pii_bootstrap(spark):
    """E-mail addresses without digits and phone numbers with spaces seed patterns; names without digits are found."""
    r = random.Random(2)
    name = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    rows = []
    for i in range(60):
        rows.append((i, f"hello please write to member account <{name(6)}@mail.example.com> soon"))
        rows.append((100 + i, f"you can call the number\n+49 (30) 12{i:02d} {r.randint(100, 999)} at noon"))
    for i in range(60, 70):
        rows.append((i, f"\U0001f600 hello we saw member account (j.{name(5)}), in the list, and lot {r.randint(10000, 99999)} of rice"))
    rows += [(200 + i, f"the number of lot {r.randint(10000, 99999)} is the number " + r.choice(["one", "two"])) for i in range(40)]
    rows += [(90, None), (None, ""), (60, rows[120][1])]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id bigint, text string, ident string").repartition(3)
    assert dict(rows)[60] == rows[120][1]
    out = pii.find_pii(df).collect()
    got = {x.doc_id: x for x in out}
    assert len(out) == len(rows)
    for i, t in rows[120:130]:
        assert [t[s.s : s.e] for s in got[i].ident] == [re.search(r"j\.\w+", t)[0]]
    assert all(not x.ident for x in out if x.doc_id is None or x.doc_id not in range(60, 70))
    masked = {x.doc_id: x.text for x in pii.mask(df).collect()}
    assert re.sub(r"\d+", "", masked[61]) == "\U0001f600 hello we saw member account (<IDENT>), in the list, and lot  of rice"
    assert masked[100] == "you can call the number\n<PHONE> at noon" and masked[90] is None


def bootstrapped(texts, passes):
    """Brute force: (text, place) of the words that the bootstrap marks, and the pass that found each word."""
    core = lambda w: re.sub(r"^[\W_]+|[\W_]+$", "", w).lower()
    at = [(" ".join(t[i - 2 : i]).lower(), core(t[i]), "@" in t[i], d, i) for d, t in enumerate(x.split() for x in texts) for i in range(2, len(t))]
    promoted, tried, edges, good, fit, first = set(), set(), Counter(), set(), set(), {}
    for k in range(passes):
        seed = lambda w, s: s or w in promoted
        behind = {}
        for p, w, s, *_ in at:
            if seed(w, s):
                behind.setdefault(p, set()).add(w)
        known = {p for p, v in behind.items() if len(v) >= pii.SUPPORT} - tried
        if k and not known:
            break
        tried |= known
        for p in known:
            rows = [(w, s) for q, w, s, *_ in at if q == p]
            if sum(seed(*x) for x in rows) >= pii.SHARE * len(rows):
                edges.update((p, w, s) for w, s in rows if w)
        by = Counter()
        for (p, w, _), n in edges.items():
            by[p, w] += n
        fixed = {w: 0.0 for _, w, _ in edges} | {w: 1.0 for _, w, s in edges if seed(w, s)}
        score = dict(fixed)
        for _ in range(pii.ROUNDS):
            pat = {q: sum(n * score[w] for (p, w), n in by.items() if p == q) / (sum(n for (p, _), n in by.items() if p == q) + 1) for q in {p for p, _ in by}}
            support = Counter(p for p, w in by if score[w] > 0.5)
            mean = {w: sum(n * pat[p] for (p, v), n in by.items() if v == w) / sum(n for (_, v), n in by.items() if v == w) for w in fixed}
            deg = Counter(w for _, w in by)
            score = {w: max(fixed[w], mean[w] * deg[w] / (deg[w] + 1)) for w in fixed}
        good |= {p for p in pat if pat[p] >= pii.CONFIDENCE and support[p] >= pii.SUPPORT}
        new = {w for p, w in by if p in good and not fixed[w] and mean[w] >= pii.PLAUSIBLE}
        first |= {w: k for w in new}
        fit |= new
        places = Counter((w, p in good) for p, w, s, *_ in at if not s and w in fit)
        now = {w for w in fit if places[w, True] >= pii.SHARE * (places[w, True] + places[w, False])} | promoted
        if now == promoted:
            break
        promoted = now
    return {(d, i) for p, w, s, d, i in at if not s and p in good and w in fit}, first


def test_pii_bootstrap_in_passes(spark):
    """Words found behind a pattern seed another one; a common word that stands there now and then doesn't."""
    r = random.Random(4)
    name = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    users, far, last = [name(7) for _ in range(8)], [name(8) for _ in range(2)], name(9)
    rows = [f"please mail user account {name(6)}@mail.example.com today" for _ in range(60)]
    rows += [f"the user account {u}, is open" for u in users for _ in range(2)] + ["the user account is open"] * 2
    rows += [f"he did login as ({u}) again" for u in users for _ in range(3)] + [f"she did login as {u}" for u in far]
    rows += [f"message sent by {u} {'.' * (i % 3)}" for i in range(2) for u in users + far] + [f"message sent by {last}"]
    rows += [f"what is said of it is not {name(4)}" for _ in range(80)]
    r.shuffle(rows)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(3)
    got = set()
    for x in pii.find_pii(df).collect():
        places = [m.start() for m in re.finditer(r"\S+", rows[x.doc_id])]
        got |= {(x.doc_id, max(i for i, p in enumerate(places) if p <= s.s)) for s in x.ident}
    want, first = bootstrapped(rows, pii.PASSES)
    assert got == want
    assert {first[u] for u in users} == {0} and {first[u] for u in far} == {1} and first[last] == 1
    assert all("said of" not in rows[d] for d, _ in got)
    once = bootstrapped(rows, 1)[0]
    assert once < want


def test_pii_scores_by_hand(spark):
    e = spark.createDataFrame([("p", "s1", True, 3), ("p", "x", False, 1), ("q", "x", False, 1), ("q", "y", False, 4)], "pattern string, instance string, seed boolean, n bigint")
    fixed = {"s1": 1.0, "x": 0.0, "y": 0.0}
    edges = [("p", "s1", 3), ("p", "x", 1), ("q", "x", 1), ("q", "y", 4)]
    score = dict(fixed)
    for _ in range(3):
        pat = {p: sum(n * score[i] for a, i, n in edges if a == p) / (sum(n for a, _, n in edges if a == p) + 1) for p in "pq"}
        mean = {i: sum(n * pat[a] for a, j, n in edges if j == i) / sum(n for _, j, n in edges if j == i) for i in fixed}
        score = {i: max(fixed[i], mean[i] * (m := sum(j == i for _, j, _ in edges)) / (m + 1)) for i in fixed}
    patterns, instances = pii.score_patterns(e, 3)
    assert {r.pattern: r.score for r in patterns.collect()} == pytest.approx(pat)
    assert {r.instance: r.score for r in instances.collect()} == pytest.approx({i: max(fixed[i], mean[i]) for i in fixed})


def test_passages(spark):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(4000)]
    words = lambda n: [r.choice(vocab) for _ in range(n)]
    p1, p2 = words(60), words(120)
    fuzzy = list(p2)
    for i in (20, 47, 48, 90):
        fuzzy[i] = "changed"
    del fuzzy[70]
    docs = {i: words(200) for i in range(30)}
    where = {5: (p1, 10), 9: (p1, 150), 12: (p1, 0), 6: (p2, 30), 20: (fuzzy, 77)}
    for d, (p, at) in where.items():
        docs[d][at:at] = p
    docs[25] = list(docs[3])
    docs[26] = []
    rows = [(d, " ".join(w), 1) for d, w in docs.items()] + [(27, None, 2), (None, "a b c", 3), (25, " ".join(docs[25]), 4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, uid int").repartition(3)
    got = defaultdict(list)
    for x in substring.repeated_passages(df).collect():
        got[x.doc_id].append(x)
    assert sum(map(len, got.values())) == len(rows) and len(got[25]) == 2
    for d, src in ((9, 5), (12, 5), (20, 6)):
        p, at = where[d]
        (s,) = got[d][0].spans
        assert abs(s.start - at) <= 3 and abs(s.end - at - len(p)) <= 3 and got[d][0].sources == [src]
    assert got[25][0].n_dup_words == 200 and got[25][0].sources == [3]
    assert got[5][0].n_dup_words == 0 and got[5][0].n_copies == 2 and got[5][0].shares
    assert {d for d, x in got.items() if x[0].shares} == {3, 5, 6, 9, 12, 20, 25}
    assert substring.repeated_passages(df.limit(0)).count() == 0


def test_passages_with_other_text_between(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(4000)]
    words = lambda n: [r.choice(vocab) for _ in range(n)]
    body = words(60)
    changed = body[:27] + words(7) + body[34:]  # neither part is long enough by itself
    rows = []
    for i, gap in enumerate((20, 50, 200)):
        h, f = words(60), words(100)
        rows += [(2 * i, words(30) + h + words(gap) + f + words(9)), (2 * i + 1, words(11) + h + words(gap) + f + words(40))]
    rows += [(10, words(20) + body + words(20)), (11, words(30) + changed + words(20))]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id bigint, text string")
    got = {x.doc_id: x for x in substring.repeated_passages(df).collect()}
    for i, gap in enumerate((20, 50, 200)):
        want = [(11, 71), (71 + gap, 171 + gap)]
        assert [(s.start, s.end) for s in got[2 * i + 1].spans] == want and got[2 * i].n_copies == 2
    (s,) = got[11].spans
    assert (s.start, s.end) == (30, 90) and got[11].sources == [10] and got[10].n_copies == 1


def shared_words(rows, size):
    """Places of each text in a stretch of size words that a text of a smaller id holds exactly."""
    out, seen = {}, {}
    for d, t in sorted(rows):
        w = t.split()
        hit = set()
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            if seen.setdefault(k, d) != d:
                hit.update(range(i, i + size))
        out[d] = hit
    return out


def test_passages_behind_earlier_pieces(spark):
    """Against brute force over all pairs: short pieces of a passage that come first don't hide the documents that hold it whole."""
    r = random.Random(12)
    words = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    rows, whole = [], []
    for k in range(30):
        p = words(r.choice((80, 100, 140)))
        for at in range(0, len(p) - 44, 15):
            rows.append((len(rows), " ".join(words(30) + p[at : at + 45] + words(25))))
        for _ in range(3):
            whole.append((len(rows), len(p)))
            rows.append((len(rows), " ".join(words(r.randrange(5, 60)) + p + words(20))))
    rows.append((len(rows), "again " * 3000))
    rows.append((len(rows), "again " * 3000))
    df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id bigint, text string").repartition(5)
    got = {x.doc_id: x for x in substring.repeated_passages(df).collect()}
    want = shared_words(rows, substring.MIN_WORDS)
    found = total = extra = 0
    for d, hit in want.items():
        mine = {i for s in got[d].spans for i in range(s.start, s.end)}
        total += len(hit)
        found += len(hit & mine)
        extra += len(mine - hit) if len(mine) < 3000 else 0
    assert total > 5000 and found >= 0.99 * total and extra <= 0.02 * total
    assert got[len(rows) - 1].n_dup_words >= 2900 and got[len(rows) - 1].sources == [len(rows) - 2]


@pytest.mark.parametrize("size", [50, 55, 60])
def test_no_link_is_lost_behind_earlier_pieces(spark, size):
    """Short exact passages that earlier pieces of them hide from the seeds: every word and every class as brute force has them."""
    r = random.Random(size)
    words = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    rows = []
    for k in range(40):
        p = words(size)
        for at in range(0, size - 44, 5):
            rows.append((len(rows), words(30) + p[at : at + 45] + words(25)))
        rows += [(len(rows), words(20) + p + words(20)), (len(rows) + 1, words(35) + p + words(10) + p)]
    rows = [(d, " ".join(t)) for d, t in rows]
    got = {x.doc_id: x for x in substring.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    want = shared_words(rows, substring.MIN_WORDS)
    for d, hit in want.items():
        assert not hit - {i for s in got[d].spans for i in range(s.start, s.end)}
    linked = sorted(d for d, hit in want.items() if hit)
    assert len(linked) == 40 and all(got[d].class_id == d - 1 == got[d - 1].class_id and got[d].sources == [d - 1] for d in linked)
    assert all(x.class_id == d for d, x in got.items() if not x.shares)


@pytest.mark.parametrize(("every", "least"), [(40, 0.99), (20, 0.95), (12, 0.8)])
def test_passages_with_changed_words(spark, every, least):
    """Recall of passages of 60 to 150 words in which one word in some is another."""
    r = random.Random(every)
    words = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    rows = []
    for k in range(100):
        p = words(r.randrange(60, 150))
        v = [f"z{r.randrange(10**6)}" if r.randrange(every) == 0 else x for x in p]
        rows += [(2 * k, " ".join(words(40) + p + words(30))), (2 * k + 1, " ".join(words(25) + v + words(50)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x.doc_id: x for x in substring.repeated_passages(df).collect()}
    assert sum(got[2 * k + 1].sources == [2 * k] for k in range(100)) >= 100 * least
    assert all(got[2 * k].n_dup_words == 0 for k in range(100))


def test_chain_equals_quadratic_search():
    r = np.random.default_rng(0)
    for _ in range(40):
        n = int(r.integers(1, 40))
        p, q = r.integers(0, 300, n), r.integers(0, 300, n)
        order = np.lexsort((q, p))
        best = {}
        for i in order:
            best[i] = substring.SEED
            for j in order:
                if p[j] < p[i] and q[j] < q[i] and j in best:
                    best[i] = max(best[i], substring.SEED + best[j] - substring.GAP * (p[i] - p[j] + q[i] - q[j]))
        found = substring.chain(p, q)
        assert sorted(np.concatenate(found).tolist()) == list(range(n))
        c = found[0]
        got = substring.SEED * len(c) - substring.GAP * sum(p[c[1:]] - p[c[:-1]] + q[c[1:]] - q[c[:-1]])
        assert got == pytest.approx(max(best.values()))


def test_quotation_linking(spark):
    rows = [
        (1, 0, "user", "How do I bake a good loaf of bread?\nThanks"),
        (1, 1, "assistant", "Use strong flour and a hot oven.\nLet it rest for a long time."),
        (1, 2, "user", "> Use strong flour and a hot oven.\nWhich flour exactly?"),
        (1, 3, "assistant", ">> Use strong  FLOUR and a hot oven.\n> Which flour exactly?\nAny bread flour."),
        (1, 4, "user", ">   How do I bake a good loaf of bread?\nMy first question again."),
        (2, 0, "user", "> Let it rest for a long time.\nFrom another thread."),
        (2, 1, "assistant", None), (None, 0, "user", "alone in the null conversation"), (2, 1, "assistant", None),
    ]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "conv_id bigint, turn bigint, role string, text string, body string")
    got = {(x.conv_id, x.turn): x for x in chat.link_quotations(df).collect()}
    assert chat.link_quotations(df).count() == len(rows)
    assert [(got[1, t].parent_turn, got[1, t].depth, got[1, t].root_turn, got[1, t].position) for t in range(5)] == [(None, 0, 0, 0), (None, 0, 1, 2), (1, 1, 1, 3), (2, 2, 1, 4), (0, 1, 0, 1)]
    assert got[1, 3].max_level == 2 and got[1, 3].n_links == 2 and got[1, 3].body == "Any bread flour."
    assert (got[2, 0].parent_conv, got[2, 0].parent_turn, got[2, 0].position) == (1, 1, 0)
    assert got[2, 1].body == "" and got[None, 0].position == 0
    assert chat.link_quotations(df.limit(0)).count() == 0


def test_quotation_of_wrapped_passages_and_reply_order(spark):
    """Random reply trees: answers quote sentences of what they answer, wrapped anew, some with nested quotations; the tree comes out whole."""
    r = random.Random(21)
    sentence = lambda: " ".join(f"v{r.randrange(3000)}" for _ in range(r.randrange(1, 14))).capitalize() + r.choice(".!?")
    wrap = lambda text, mark: "\n".join(mark + x for x in textwrap.wrap(text, r.randrange(18, 60)))
    rows, parent, body = [], {}, {}
    for conv in range(12):
        own = {}
        for turn in range(25):
            own[turn] = [sentence() for _ in range(r.randrange(2, 6))]
            up = r.randrange(turn) if turn and r.random() < 0.85 else None
            text = wrap(" ".join(own[turn]), "")
            if up is not None:
                k = r.randrange(len(own[up]))
                quote = wrap(" ".join(own[up][k : k + 2]), r.choice(["> ", ">"]))
                if (conv, up) in parent and r.random() < 0.5:
                    quote = wrap(own[parent[conv, up]][0], ">> ") + "\n" + quote
                text = quote + "\n" + text
                parent[conv, turn] = up
            body[conv, turn] = " ".join(own[turn]).lower()
            rows.append((conv, turn, "user", text))
    rows.append((50, 0, "user", "> " + body[3, 0].split(".")[0].split("!")[0].split("?")[0] + "\n" + "word " * 60_000))
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    got = {(x.conv_id, x.turn): x for x in chat.link_quotations(df).collect()}
    found = sum(got[k].parent_turn == v and got[k].parent_conv == k[0] for k, v in parent.items())
    assert found >= 0.98 * len(parent)  # very short sentences may occur twice
    assert all(got[k].parent_turn is None for k in body if k not in parent)
    assert all(re.sub(r"\s+", " ", got[k].body).lower() == t for k, t in body.items())
    for conv in range(12):
        kids = defaultdict(list)
        for turn in range(25):
            kids[got[conv, turn].parent_turn].append(turn)
        order, stack = [], kids[None][::-1]
        while stack:
            t = stack.pop()
            order.append(t)
            stack += kids[t][::-1]
        assert [got[conv, t].position for t in order] == list(range(25))
        for t in order:
            up = got[conv, t].parent_turn
            assert got[conv, t].depth == (0 if up is None else got[conv, up].depth + 1)


def test_short_quotations_and_other_conversations(spark):
    rows = [(1, 0, "Thanks\n\nSee you tomorrow then"), (1, 1, "> Thanks\nYou are welcome"), (2, 0, "> Thanks\nFor what"), (2, 1, "> See you tomorrow then\nWhere"), (0, 5, "> You are welcome\nYou are welcome"), (0, 6, "> You are welcome")]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id bigint, turn bigint, role string, text string")
    got = {(x.conv_id, x.turn): (x.parent_conv, x.parent_turn) for x in chat.link_quotations(df).collect()}
    # short ones count within the conversation only; the first holder may be the quoting message itself, then the next conversation counts
    assert got == {(1, 0): (None, None), (1, 1): (1, 0), (2, 0): (None, None), (2, 1): (1, 0), (0, 5): (1, 1), (0, 6): (0, 5)}


def test_fixity(spark, tmp_path):
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://x/"), "id").alias("url"), F.repeat(F.concat(F.lit("<p>é"), "id"), 40).alias("html"))
    odd = spark.createDataFrame([(None, None, None), (7, None, ""), (7, None, ""), (8, "long", "y" * 300_000)], "page_id bigint, url string, html string")
    rows = warc.fixity(pages.union(odd).withColumn("file", F.lit("clash"))).collect()
    tag = lambda p: "ff" if p is None else hashlib.md5(str(p).encode()).hexdigest()
    got = [x for x in rows if x.status != "extra"]
    assert len(got) == 3004
    at = grown = 0
    for x in sorted(got, key=lambda x: x.offset):
        assert x.offset == at
        at += x.length
        t = tag(x.page_id)
        # behind the first record that has grown, or has another behind it, all others are found elsewhere
        assert x.status == ("missing" if t[:2] == "01" else "corrupt" if t[:2] == "00" or t[:3] in ("020", "021") else "moved" if grown else "ok"), (x, grown)
        grown += t[:3] in ("020", "021", "022", "023")
    extra = sorted(x.page_id for x in rows if x.status == "extra")
    assert grown and extra == sorted(-x.page_id - 1 for x in got if tag(x.page_id)[:3] in ("022", "023"))
    got = {x.page_id: x for x in got}.values()
    recs = warc.records(pages.limit(50))
    warc.write_archive(recs, warc.manifest(recs), str(tmp_path / "w"))
    raw = b"".join(f.read_bytes() for f in sorted((tmp_path / "w").rglob("part-*")))
    assert raw.count(b"WARC/1.1\r\n") == 50 and hashlib.sha256(raw[: raw.index(b"WARC/1.1", 5)]).hexdigest() == next(x.sha256 for x in got if x.page_id == 0)
    assert warc.fixity(pages.limit(0)).count() == 0


def test_audit_descends_to_what_differs(spark):
    """Two replicas with equal roots, and one with a byte inserted, a record moved, one gone and one of its own."""
    schema = "page_id bigint, file bigint, offset bigint, length bigint, sha256 string"
    ours = [(k, k % 2, 10 * (k // 2), 10, f"h{k}") for k in range(40_000)] + [(None, 0, 200_000, 10, "n"), (None, 0, 200_010, 10, "n")]
    df = spark.createDataFrame(ours, schema)
    assert warc.audit(df, df).where("status <> 'ok'").count() == 0
    theirs = [r for r in ours if r[0] not in (10, 20_001)]
    theirs = [(*r[:4], "other") if r[0] == 5000 else r for r in theirs]
    theirs = [(r[0], r[1], 300_000, 10, r[4]) if r[0] == 31_000 else r for r in theirs] + [(77_777, 1, 400_000, 5, "own")]
    got = {(r.page_id, r.status) for r in warc.audit(df, spark.createDataFrame(theirs, schema)).where("status <> 'ok'").collect()}
    assert got == {(10, "missing"), (20_001, "missing"), (5000, "corrupt"), (31_000, "moved"), (77_777, "extra")}
    none = df.limit(0)
    assert {r.status for r in warc.audit(df.limit(5), none).collect()} == {"missing"} and warc.audit(none, df.limit(5)).where("status = 'extra'").count() == 5


def test_archive_of_nulls_and_repeats(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "one"), (None, "n", "first"), (None, None, "second"), (None, None, None), (2, "v", "two é"), (2, "v", "two é"), (2, "v", "two é"), (2, "w", "other"), (None, "n", "first"), (3, None, "end")], "page_id bigint, url string, html string").repartition(3)
    recs = warc.records(pages)
    files = warc.manifest(recs)
    warc.write_archive(recs, files, str(tmp_path / "w"))
    raw = b"".join(f.read_bytes() for f in sorted((tmp_path / "w").rglob("part-*")))
    rows = files.collect()
    assert len(rows) == 10 and {x.file for x in rows} == {0} and len(raw) == sum(x.length for x in rows)
    assert all(hashlib.sha256(raw[x.offset : x.offset + x.length]).hexdigest() == x.sha256 for x in rows)


def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    known = docs.join(labels, "doc_id").select("doc_id", "text", "lang").limit(3000)
    extra = spark.createDataFrame([(None, None, "en"), (5, "", "en"), (6, "x" * 30000, "en")], known.schema)
    out = toxicity.report(known.union(extra), labels).join(labels, "doc_id", "left").toPandas()
    held = out[out.held_out & out.toxic.notna()]
    pos, neg = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    auc = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert auc > 0.9 and (neg >= 0.3).mean() < 0.02 and (pos >= 0.3).mean() > 0.75
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all()
    assert len(out) == 3003
    flat = toxicity.report(known.limit(20), labels.limit(0)).toPandas()
    assert flat.score.nunique() == 1
    # the thresholds of a trained model: one a language, and verdicts by them hold on rows that neither training nor calibration saw
    lang = {r.doc_id: r.lang for r in known.collect()}
    out["lang"] = out.doc_id.map(lang)
    assert set(out.lang.dropna()) == {"en", "fr", "de", "es"} and (out.groupby("lang").lang_threshold.nunique() == 1).all()
    assert (out.lang_predicted == (out.score >= out.lang_threshold)).all()
    # learned, not the default: labels are kept for calibration at any size
    assert (out.dropna(subset=["lang"]).groupby("lang").lang_threshold.first() != 0.3).sum() >= 3
    held = out[out.held_out & out.toxic.notna()]
    assert held[held.lang_predicted == 1].toxic.mean() > 0.8 and held[held.toxic == 1].lang_predicted.mean() > 0.6


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, "bad words here", None, 9.0), (1, "bad words here", None, 9.0), (None, None, "en", 1.0), (4, "", "en", 1.0), (1, "another text", "en", 1.0)], "doc_id bigint, text string, lang string, score double")
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (3, None)], "doc_id bigint, toxic int")
    got = toxicity.report(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.lang_threshold == 0.3 for r in got)
    assert len({r.score for r in got if r.doc_id == 4 or r.doc_id is None}) == 1
    assert toxicity.report(docs.limit(0), labels).count() == 0
    assert toxicity.report(docs.drop("lang"), labels.limit(0)).count() == 5


def test_calibration_by_hand(spark):
    rows = [(k, "en", s) for k, s in enumerate([0.95, 0.93, 0.91, 0.9, 0.88, 0.5, 0.41, 0.4, 0.1])] + [(20, None, 0.9), (21, "fr", 1.0)]
    truth = {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 0, 6: 1, 7: 0, 8: 0, 20: 1, 21: 1}
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    scored = spark.createDataFrame([(ids[k], lang, s) for k, lang, s in rows], "doc_id bigint, lang string, score double")
    labels = spark.createDataFrame([(ids[k], y) for k, y in truth.items()], "doc_id bigint, toxic int")
    got = {r.lang: r.threshold for r in toxicity.calibrate(scored, labels).collect()}
    assert got == {"en": 0.52, None: 0.3, "fr": 0.3}  # above 0.5 all are toxic; the others have too few rows
    assert {r.lang: r.threshold for r in toxicity.calibrate(scored, labels, [ids[0]]).collect()}["en"] == 0.3


def _probed(spark, kind, seed):
    """How many of 60 passages with changed words name their source, how many pieces link, and the rows: every n-th word changed, or one in n behind earlier pieces of the passage."""
    r = random.Random(seed)
    words = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    rows, pairs = [], []
    for _ in range(60):
        p = words(r.randrange(60, 150))
        if kind == "hidden":
            for at in range(0, len(p) - 44, 15):
                rows.append((len(rows), " ".join(words(30) + p[at : at + 45] + words(25))))
            v = [f"z{r.randrange(10**6)}" if r.randrange(20) == 0 else x for x in p]
        else:
            v = [f"z{r.randrange(10**6)}" if i % kind == kind - 1 else x for i, x in enumerate(p)]
        pairs.append((len(rows), len(rows) + 1))
        rows += [(len(rows), " ".join(words(40) + p + words(30))), (len(rows) + 1, " ".join(words(25) + v + words(50)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {x.doc_id: x for x in substring.repeated_passages(df).collect()}
    found = sum(a in got[b].sources and got[b].class_id == got[a].class_id for a, b in pairs)
    return found, sum(x.shares for d, x in got.items() if not any(d in p for p in pairs))


@pytest.mark.parametrize("kind", [8, 6, 5, "hidden"])
def test_changed_passages_without_long_runs_or_behind_pieces(spark, kind):
    """Every 8th, 6th or 5th word of a passage is another, so no 8 words in a row are left; or one in 20, and documents before it hold pieces of 45 words."""
    found, pieces = _probed(spark, kind, 77)
    assert found >= 54 and not pieces
