"""Reports on a tokenizer agree with the tokenizer; vectors of new letters are means of those of their Latin letters."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import vocabulary

public = pytest.importorskip("public_tokenizers")


def test_reports_agree_with_the_tokenizer(spark):
    from tokenizers import Tokenizer

    path = vocabulary.public()
    plain, texts = Tokenizer.from_file(path), ["ᚁ", "a", "hello world", "", None, "ᚁᚂ ᚃ", "é", "漢", "  x "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for r in vocabulary.reports(rows, "text", path).collect():
        want = None if texts[r.id] is None else plain.encode(texts[r.id], add_special_tokens=False).ids
        assert r.token_ids == want and r.single_token == (None if want is None else len(want) == 1) and r.round_trip == (None if want is None else True)
    new = vocabulary.missing(path)
    assert "ᚁ" in new and "a" not in new and len(new) == 28
    got = {r.text: r for r in vocabulary.reports(rows, "text", path, new).collect()}
    assert got["ᚁ"].single_token and got["ᚁ"].token_ids[0] >= 50257 and len(got["ᚁᚂ ᚃ"].token_ids) == 4 and got["ᚁᚂ ᚃ"].decoded == "ᚁᚂ ᚃ"


def test_the_vocabulary_is_the_files(spark):
    rows = vocabulary.vocabulary(spark, vocabulary.public())
    assert rows.count() == 50257 and rows.filter("token = 'A'").first()["id"] == 32 and rows.select(F.countDistinct("id")).first()[0] == 50257


def test_first_vectors(spark):
    table = spark.createDataFrame([(i, [float(i), float(i * i)]) for i in range(30, 60)], "id int, v array<float>")
    at = {r.letter: r for r in vocabulary.first_vectors(table, "id", "v", vocabulary.public()).collect()}
    assert at["ᚁ"].vector == [33.0, 33.0**2] and at["ᚁ"].parts == 1  # B
    assert at["ᚍ"].vector == [(45 + 38) / 2, (45**2 + 38**2) / 2] and at["ᚍ"].parts == 2  # N and G
    assert "᚛" not in at  # the bracket's vector isn't there
    assert {tuple(r.vector) for r in vocabulary.first_vectors(table, "id", "v", vocabulary.public(), "zero").collect()} == {(0.0, 0.0)}
    with pytest.raises(ValueError):
        vocabulary.first_vectors(table, "id", "v", vocabulary.public(), "none")
