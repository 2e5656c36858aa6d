"""Draws are the smallest tickets of all items, though only small ones are sorted."""

from collections import defaultdict
from hashlib import md5

import pytest

from tessella.functions import draws as tickets
from tessella.operators import resample


@pytest.mark.parametrize("cut", [False, True])
def test_draws_are_the_smallest_tickets(spark, monkeypatch, cut):
    items = [("a", i) for i in range(900)] + [("b", i) for i in range(5)] + [(None, i) for i in range(300)]
    df = spark.createDataFrame(items + items[:50], "k string, item bigint")
    if cut:  # hardly a ticket is under the share: most rounds are drawn from all items
        monkeypatch.setattr(resample.F, "lpad", lambda c, n, p: resample.F.lit("01000000"))
    got = defaultdict(set)
    rows = resample.draws(df, ["k"], "item", 20, 7).select("k", "draw", "item").collect()
    for k, draw, item in rows:
        got[k, draw].add(item)
    for k in ("a", "b", None):
        for draw in range(20):
            order = sorted((md5(f"{i}|{draw}|0".encode()).hexdigest(), i) for key, i in items if key == k)
            assert got[k, draw] == {i for _, i in order[:7]}
    assert len(rows) == 20 * (7 + 5 + 7) and tickets.share(1) == "g"
