"""Catalogue fields on small texts."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import extract as X


def one(spark, column, *texts):
    names = "abc"[: len(texts)]
    return spark.createDataFrame([texts], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Mid sixth century (linguistic)", (525, 575)),
        ("first half of the sixth century", (500, 550)),
        ("late 5th century", (450, 500)),
        ("5th-6th century", (400, 600)),
        ("fifth to sixth century", (500, 600)),
        ("seventh century", (600, 700)),
        ("no date", None),
        (None, None),
    ],
)
def test_years(spark, text, want):
    got = one(spark, X.year_range(F.col("a")), text)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    "column, text, want",
    [
        (lambda: X.corpus_number(F.col("a")), "see ciic 12.", 12),
        (lambda: X.corpus_number(F.col("a")), "CIIC no. 12", None),
        (lambda: X.corpus_number(F.col("a"), loose=True), "CIIC no. 12", 12),
        (lambda: X.county(F.col("a")), "at Co. West Meath, x", "West Meath"),
        (lambda: X.townland(F.col("a")), "Findspot: Bally More (x), Co. Cork", "Bally More"),
        (lambda: X.stone_name(F.col("a")), "Baile | Bally | More (12)", "Bally | More"),
        (lambda: X.height_cm(F.col("a")), "H 2.00 x W 1.10 × D 0.60 m", 200.0),
        (lambda: X.weathering(F.col("a")), "", None),
        (lambda: X.weathering(F.col("a")), "fair", "moderate"),
        (lambda: X.weathering(F.col("a")), "unweathered", "moderate"),
        (lambda: X.view_angle(F.col("a")), "x/1-B.JPG", "back"),
        (lambda: X.region(F.col("a")), "in scotland and wales", "Scotland"),
        (lambda: X.title_id(F.col("a")), "File:Ogham Stone Ballycrovane.jpg", "BALLYCROVANE"),
        (lambda: X.title_id(F.col("a")), "File:nothing.png", None),
        (lambda: X.plain_answer(F.col("a")), 'Transcription: " ᚋᚐ x"', "ᚋᚐ"),
        (lambda: X.glyphs(F.col("a")), "ᚋᚐᚕ x", 2),
        (lambda: X.difficulty(F.col("a"), ("ᚋᚐ",)), "", 0.0),
    ],
)
def test_fields(spark, column, text, want):
    assert one(spark, column(), text) == want


def test_difficulty(spark):
    got = one(spark, X.difficulty(F.col("a"), ("ᚋᚐ",)), "ᚋᚐᚎ")
    assert got == pytest.approx(3 / 30 * 0.4 + 1 / 3 * 0.3 + 0.25)


def test_kind(spark):
    assert one(spark, X.image_kind(F.col("a"), F.col("b")), "a.jpg", "A Rubbing") == "rubbing"
