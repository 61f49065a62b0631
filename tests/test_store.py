"""Bucketed stores: changes, snapshots, conflicts, and what is rewritten."""

import random

import pytest

from millrace.sources.store import Conflict, Store

ROW = "k long, v string, n int"


def rows(spark, *some):
    return spark.createDataFrame(list(some), ROW)


def all_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rounds_of_changes_against_a_dictionary(spark, tmp_path):
    rng, want, store = random.Random(4), {}, Store(spark, str(tmp_path / "s"), ROW, "k", 7)
    seen = [{}]
    for turn in range(5):
        change = {rng.choice([None, *range(60)]): (f"t{turn}", rng.randint(0, 9)) for _ in range(20)}
        store.upsert(rows(spark, *[(k, *v) for k, v in change.items()]))
        want |= change
        seen.append(dict(want))
        if turn == 2:
            gone = [k for k in list(want)[:4]]
            store.remove(spark.createDataFrame([(k,) for k in [*gone, 999]], "k long"))
            want = {k: v for k, v in want.items() if k not in gone}
            seen.append(dict(want))
    again = Store(spark, str(tmp_path / "s"))
    assert again.numbers() == list(range(len(seen)))
    for number, told in enumerate(seen):
        assert all_of(again.read(number)) == sorted(((k, *v) for k, v in told.items()), key=repr)
    assert again.vacuum(keep=2) > 0 and all_of(again.read()) == sorted(((k, *v) for k, v in want.items()), key=repr)
    assert again.numbers() == [0, len(seen) - 2, len(seen) - 1] and all_of(again.read(len(seen) - 2))


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), ROW, "k", 16)
    store.upsert(spark.range(500).selectExpr("id AS k", "'a' AS v", "1 AS n"))
    before = store._told(1)["folders"]
    store.upsert(rows(spark, (3, "b", 2), (4, "b", 2)))
    after = store._told(2)["folders"]
    changed = [b for b in after if after[b] != before[b]]
    assert len(before) == 16 and 1 <= len(changed) <= 2 and store.read().count() == 500
    assert store.upsert(rows(spark)) == 2 and store.numbers() == [0, 1, 2]


def test_two_writers_conflict(spark, tmp_path):
    one, two = (Store(spark, str(tmp_path / "s"), ROW, "k", 4) for _ in range(2))
    base = one.numbers()[-1]
    one.upsert(rows(spark, (1, "one", 1)), on=base)
    with pytest.raises(Conflict):
        two.upsert(rows(spark, (1, "two", 2)), on=base)
    assert all_of(two.read()) == [(1, "one", 1)] and len(list((tmp_path / "s/data").iterdir())) == 1 and not list((tmp_path / "s/drafts").glob("[0-9a-f]*"))
    two.upsert(rows(spark, (1, "two", 2)))
    assert all_of(one.read()) == [(1, "two", 2)]


def test_keys_that_occur_twice(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), ROW, "k", 4)
    with pytest.raises(Exception, match="occurs twice in the change: 1"):
        store.upsert(rows(spark, (1, "a", 1), (1, "b", 2)))
    assert store.numbers() == [0] and not list((tmp_path / "s/data").iterdir()) and store.read().count() == 0
    store.upsert(rows(spark, (1, "a", 1), (1, "b", 2), (1, "c", None), (None, "z", 0)), latest="n")
    assert all_of(store.read()) == [(1, "b", 2), (None, "z", 0)]
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path / "none"))


def test_a_reader_keeps_its_snapshot(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), ROW, "k", 2)
    store.upsert(rows(spark, (1, "a", 1)))
    open_one = store.read()
    store.upsert(rows(spark, (1, "b", 1), (2, "b", 1)))
    assert all_of(open_one) == [(1, "a", 1)]
