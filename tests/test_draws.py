"""Weighted draws against a plain search, over bucket sizes and crowds."""

import hashlib
from bisect import bisect_right
from itertools import accumulate

import pytest

from millrace.operators import draws


def plain(items, wanted):
    weights = {}
    for k, w in items:
        if k is not None and w is not None and w > 0:
            weights[k] = weights.get(k, 0) + w
    keys = sorted(weights, key=lambda k: (hashlib.md5(str(k).encode()).hexdigest(), k))
    ends = list(accumulate(weights[k] for k in keys))
    return sorted((d, keys[bisect_right(ends, u % ends[-1])]) for d, u in wanted if u is not None)


@pytest.mark.parametrize("size, crowd", [(4096, 1 << 16), (3, 5), (1, 1)])
def test_draws(spark, size, crowd):
    # one key has a third of all weight, one is repeated
    items = [(k, 1 + k % 5) for k in range(120)] + [(500, 180), (7, 20), (7, 3), (None, 9), (901, 0), (902, None), (903, -4)]
    wanted = [(i, i * 7919 - 50) for i in range(900)] + [(5, 3), (5, 3), (77, None)]
    frames = spark.createDataFrame(items, "k long, w int"), spark.createDataFrame(wanted, "draw int, u long")
    got = draws.weighted_draws(frames[0], "k", "w", frames[1], size, crowd)
    assert sorted(map(tuple, got.collect())) == plain(items, wanted)


def test_no_items_and_no_draws(spark):
    items, wanted = spark.createDataFrame([("a", 1)], "k string, w int"), spark.createDataFrame([(1, 2)], "draw long, u long")
    assert draws.weighted_draws(items.limit(0), "k", "w", wanted).collect() == []
    assert draws.weighted_draws(items, "k", "w", wanted.limit(0)).collect() == []
    assert draws.weighted_draws(items, "k", "w", wanted).collect() == [(1, "a")]


def test_the_plan_has_no_nested_loop(spark):
    items, wanted = spark.range(50).selectExpr("id AS k", "id + 1 AS w"), spark.range(50).selectExpr("id AS draw", "id AS u")
    plan = draws.weighted_draws(items, "k", "w", wanted)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_buckets_grow_with_the_items():
    assert [draws.bits_for(n) for n in (0, 1, 4096, 4097, 8192, 10**6, 10**12)] == [0, 0, 0, 1, 1, 8, 20]
