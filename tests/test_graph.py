"""The closure of a link table: depths, cycles, nulls and empty tables."""

from millrace.operators.graph import closure


def test_closure(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 3), (1, 3), (9, 1), (3, None), (None, 4)], "src int, dst int")
    seeds = spark.createDataFrame([(1,), (1,), (None,)], "node int")
    assert sorted(map(tuple, closure(links, seeds).collect())) == [(1, 0), (2, 1), (3, 1)]
    assert closure(links, seeds.limit(0)).collect() == []
    assert sorted(map(tuple, closure(links.limit(0), seeds).collect())) == [(1, 0)]
