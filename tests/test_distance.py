"""The bit-parallel edit distance against the table of rows."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import distance


def table(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def pairs():
    rng = random.Random(1)
    out = [("", ""), ("", "abc"), ("abc", ""), ("same", "same"), ("a", "b"), ("ab" * 200, "ba" * 200), ("x" * 64, "x" * 65), ("漢" * 130, "漢" * 20 + "字" * 110)]
    for _ in range(400):
        a = "".join(rng.choice("abcdᚁ😀") for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 127, 128, 129, 200])))
        b = list(a)
        for _ in range(rng.randint(0, 20)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "ab"])
        out.append((a, "".join(b)) if rng.random() < 0.7 else (a, "".join(rng.choice("abcd") for _ in range(rng.randint(0, 150)))))
    return out


@pytest.mark.parametrize("pays", [1, 10**6])
def test_against_the_table(monkeypatch, pays):
    monkeypatch.setattr(distance, "PAYS", pays)
    monkeypatch.setattr(distance, "MASKS", 5000)
    got = distance.of_texts(*map(list, zip(*pairs())))
    assert got == [table(a, b) for a, b in pairs()]


def test_nulls_lists_and_long_texts(spark):
    assert distance.of_texts([None, "a", None], ["a", None, None]) == [None, None, None]
    assert distance.of_lists([["the", "cat", None], [], None], [["the", None], ["x"], ["x"]]) == [1, 1, None]
    long = "abcdefghij" * 3000
    assert distance.of_texts([long], [long[:9000] + "X" + long[9001:20_000] + long[20_007:]]) == [8]
    rows = spark.createDataFrame([(1, "kitten", "sitting"), (2, None, "x"), (3, "", "")], "id int, a string, b string")
    got = rows.select("id", distance.edit_distance(F.col("a"), F.col("b")).alias("d"), distance.word_distance(F.split("a", ""), F.split("b", "")).alias("w")).collect()
    assert {r.id: r.d for r in got} == {1: 3, 2: None, 3: 0}
    distance.register(spark)
    assert spark.sql("SELECT edit_distance('ab', 'b') AS d, word_distance(split('a b', ' '), split('b', ' ')) AS w").first() == (1, 1)
