"""Records, draws, ordinal joins and script helpers on small literals."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import extract, script
from millrace.operators import draws, records


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_coercion(spark):
    df = spark.createDataFrame([("a",), (None,)], "k string")
    assert [r.x for r in df.select(records.coerced(F.col("k"), ("a", "b"), "b").alias("x")).collect()] == ["a", "b"]
    with pytest.raises(Exception, match="unknown value: z"):
        spark.createDataFrame([("z",)], "k string").select(records.coerced(F.col("k"), ("a",), "a")).collect()


def test_least_confidence(spark):
    df = spark.createDataFrame([("verified",), ("probable",), ("uncertain",), (None,)], "c string")
    for least, n in (("verified", 1), ("probable", 2), ("uncertain", 4)):
        assert df.filter(records.sure_enough(F.col("c"), least)).count() == n
    with pytest.raises(Exception, match="unknown value"):
        spark.createDataFrame([("sure",)], "c string").filter(records.sure_enough(F.col("c"), "probable")).collect()


def test_ordinal_join(spark):
    p = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "idx int, prediction string")
    r = spark.createDataFrame([(0, "a"), (1, "x")], "idx int, reference string")
    with pytest.raises(Exception, match="differ in length"):
        records.by_ordinal(p, r).collect()
    assert records.by_ordinal(p, r, strict=False).count() == 2
    assert sorted(map(tuple, records.by_ordinal(p.filter("idx < 2"), r).collect())) == [(0, "a", "a"), (1, "b", "x")]


def test_ratios_and_collation():
    records.check_ratios(0.7, 0.15, 0.15)
    records.check_ratios(0.7, 0.2, 0.1005)
    with pytest.raises(AssertionError):
        records.check_ratios(0.7, 0.2, 0.2)
    assert records.on_first([{"a": 1}, {"a": 2, "b": 3}]) == {"a": [1, 2]} and records.on_first([]) == {}


def test_requested_rows(spark):
    df = spark.createDataFrame([(i,) for i in (5, 3, 9, 1)], "id int")
    got = lambda **o: [r.id for r in records.requested(df, "id", **o).collect()]
    assert got(ids=[9, 3, 7]) == [9, 3] or sorted(got(ids=[9, 3, 7])) == [3, 9]
    assert got(limit=2) == [1, 3] and len(got(ids=[], limit=0)) == 4


def test_weighted_draws_follow_the_weights(spark):
    items = spark.createDataFrame([(1, 3), (2, 0), (3, 7), (4, None)], "k int, w int")
    wanted = spark.range(1000).selectExpr("id AS draw", "id AS u")
    got = {r.k: r.n for r in draws.weighted_draws(items, "k", "w", wanted).groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 300, 3: 700}


def test_character_info(spark):
    got = one(spark, script.character_info(F.lit("ᚐ")))
    assert got.asDict() == {"character": "ᚐ", "codepoint": "U+1690", "latin": "A", "group": "Aicme Ailme (Vowels)", "is_vowel": True, "is_forfeda": False, "frequency": 0.15}
    assert one(spark, script.character_info(F.lit("A"))) is None
    assert one(spark, script.character_info(F.lit("ᚕ"))).is_forfeda and one(spark, script.character_info(F.lit("ᚕ"))).frequency == 0.0
    assert one(spark, script.character_info(F.lit("᚛"))).group == "Punctuation" and one(spark, script.character_info(F.lit(" "))).group == "Space"


@pytest.mark.parametrize("char,block,letter", [("ᚐ", True, True), ("᚛", True, True), (" ", True, False), ("A", False, False), ("", False, False), ("ᚐᚐ", False, False)])
def test_character_classes(spark, char, block, letter):
    assert (one(spark, script.is_block_char(F.lit(char))), one(spark, script.is_letter(F.lit(char)))) == (block, letter)


def test_words_and_direction(spark):
    assert one(spark, script.words(F.lit("ᚁ  ᚂ "))) == ["ᚁ", "ᚂ", ""]
    assert one(spark, script.reading_direction(F.lit("᚛ᚁ᚜"))) == "left_to_right" and one(spark, script.reading_direction(F.lit("ᚁ"))) == "bottom_to_top"
    assert one(spark, script.plain_spaces(F.lit("ᚁ ᚂ"))) == "ᚁ ᚂ"


def test_difficulty(spark):
    assert one(spark, extract.difficulty(F.lit(""))) == 0.0
    easy, hard = one(spark, extract.difficulty(F.lit("ᚋᚐᚊᚔ"))), one(spark, extract.difficulty(F.lit("ᚕᚖᚗᚘᚙᚎᚍ" * 5)))
    assert easy == pytest.approx(4 / 30 * 0.4 + 0.25) and hard == 1.0


def test_annotation_form(spark):
    form = lambda s, l, v: one(spark, script.annotation(F.lit(s), F.lit(l), F.lit(v)))
    assert tuple(form("", "maqi", 2)) == ("ᚋᚐᚊᚔ", 3, None) and tuple(form("ᚁ", "x", None)) == ("ᚁ", 1, None)
    assert form("", "", 1).error == "empty" and form("abc", "maqi", 1).error == "invalid"


def test_licences_and_ids(spark):
    lic = lambda a, b: one(spark, extract.licence(F.lit(a), F.lit(b)))
    assert (lic("CC BY 4.0", ""), lic("cc-by-4.0", None), lic("", "x/CC-Zero"), lic("cc-by-sa-4.0", "")) == ("CC-BY-SA", "CC-BY", "CC0", "CC-BY-SA")
    assert one(spark, extract.is_project_id(F.lit("I-COR-L01"))) and not one(spark, extract.is_project_id(F.lit("I-COR-1")))
    assert one(spark, extract.is_stone_image(F.lit("/Images/IRE/x.jpg"))) and not one(spark, extract.is_stone_image(F.lit("I-COR-L01.jpg")))
    assert one(spark, extract.is_catalogue_page(F.lit("<b>Findspot"))) and not one(spark, extract.is_catalogue_page(F.lit("findspot")))
    assert one(spark, extract.category_region(F.lit("Stones in Wales"))) == "Wales" and one(spark, extract.category_region(F.lit("wales"))) == "unknown"
