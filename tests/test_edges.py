"""Edges are dealt over the tasks that are asked for."""

from tessella.operators import neighbors


def test_edges_in_so_many_tasks(spark):
    df = spark.createDataFrame([(i % 30, i % 7) for i in range(400)], "src bigint, dst bigint")
    e = neighbors.edges(df, 9)
    a = neighbors.adjacency(e, 11)
    assert sorted(e.collect()) == sorted(neighbors.edges(df).collect()) and sorted(a.collect()) == sorted(neighbors.adjacency(neighbors.edges(df)).collect())
    assert e.rdd.getNumPartitions() == 9 and a.rdd.getNumPartitions() == 11
