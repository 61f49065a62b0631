"""Very long texts in every operator, repeated ids in the samples, and twins of singular terms."""

import random

import pytest

from millrace.llm import compressed, decontam, fim, langid, licenses, lmscore, simhash, toxicity, whitening
from test_operators import frame

WORDS = ["".join(random.Random(i).choice("abcdefgh") for _ in range(2 + i % 7)) for i in range(300)]


@pytest.fixture(scope="module")
def long():
    """A text of fifty thousand words beside short ones."""
    rng = random.Random(8)
    short = [(i, " ".join(rng.choice(WORDS) for _ in range(30)), "en") for i in range(12)]
    return [*short, (100, " ".join(rng.choice(WORDS) for _ in range(50_000)), "en"), (101, "x" * 5_000, "en"), (102, " ".join(["same"] * 20_000), "de")]


def test_decontamination_of_a_long_text(spark, long):
    words = long[12][1].split()
    items = [(1, " ".join(words[40_000:40_012])), (2, " ".join(words[-10:])), (3, "none of these words is there at all in any text")]
    got = {r.doc_id: r for r in decontam.report(frame(spark, long), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got[100].n_words == 50_000 and got[100].n_items == 2 and 22 <= got[100].n_hit <= 30 and got[101].n_words == 1 and got[102].n_hit == 0


def test_fingerprints_of_long_texts(spark, long):
    copy = (103, long[12][1].upper(), "en")
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, [*long, copy])).collect()}
    assert got[103].component_id == got[100].component_id == 100 and got[103].fingerprint == got[100].fingerprint and len(got) == 16


def test_licences_of_long_texts(spark, long):
    lines = "\n".join([*(["plain words here"] * 50_000), "Licensed under the MIT License.", "no licence at all"])
    got = {r.doc_id: r for r in licenses.scan(frame(spark, [*long, (104, lines, "en")])).collect()}
    assert got[104].line_licenses == "MIT" and got[104].license_id is None and got[100].line_licenses == ""


def test_scores_of_long_texts(spark, long):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)] + [(100, 1, 0), (101, 0, 1)], "doc_id long, quality int, toxic int")
    docs = frame(spark, long)
    for out in (toxicity.score(docs, labels), compressed.score(docs, labels), lmscore.pseudo_likelihood(docs), langid.identify(docs)):
        assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, _, _ in long)
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}[102] in ("de", "en")


def test_long_texts_come_back_from_fill_in_middle(spark, long):
    out = fim.transform(frame(spark, long).drop("fp"), fim=100)
    for r in out.collect():
        assert r.fim.prefix + r.fim.middle + r.fim.suffix == r.text


def test_repeated_ids_in_samples(spark):
    """An id that many rows have is learned from, and every one of its rows gets its score."""
    rows = [(i % 40, ("plain words of text " if i % 2 else "idiot moron text ") * 5 + str(i), "en" if i % 2 else "de") for i in range(400)]
    rows += [(7, "plain words of text again", "en")] * 300
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(40)] * 3, "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    toxic = toxicity.score(docs, labels, sample=10).collect()
    assert len(toxic) == 700 and len({r.score for r in toxic if r.doc_id == 7}) <= 11
    assert sum(r.predicted == 1 - r.doc_id % 2 for r in toxic) > 0.95 * 700
    assert compressed.score(docs, labels, sample=10, most=50).count() == 700
    found = langid.identify(docs).collect()
    assert len(found) == 700 and sum(r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in found) > 0.95 * 700


def test_terms_of_one_person(spark):
    assert {"a", "man"} in toxicity.twins({"a", "woman"}) and {"ein", "muslim"} != {"ein"}
    assert any("jewish" in x for x in toxicity.twins({"muslim"})) and any("mujer" in x for x in toxicity.twins({"hombre"})) and any("juif" in x for x in toxicity.twins({"chrétien"}))
    assert all(toxicity.PLACE[w][0][toxicity.PLACE[w][1]] == w for w in toxicity.PLACE)


def test_rows_of_one_vector_and_one_id(spark):
    rows = [(1, [1.0, 2.0])] * 50 + [(1, [3.0, 1.0]), (1, [0.0, 0.0])]
    out = whitening.report(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(out) == 52 * 2 and {r.n for r in out} == {3}
