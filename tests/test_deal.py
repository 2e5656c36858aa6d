"""Shuffles have more tasks where tables have more rows, never fewer than the session names."""

from tessella.plans import bindings


def test_shuffles_grow_with_the_rows(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    try:
        assert bindings.deal(spark.range(100), 1000).count() == 100 and spark.conf.get(name) == before
        bindings.deal(spark.range(10001), 1000)
        assert spark.conf.get(name) == "11"
        bindings.deal(spark.range(10), 1000)
        assert spark.conf.get(name) == "11"
    finally:
        spark.conf.set(name, before)
