"""The corpus pipeline as a whole: nulls, repeats, an empty table, extra columns, and what each stage has to do."""

import random

import pytest

import corpus_pipeline
from millrace.llm import common, decontam, packing, quality, simhash, substr


def made(spark, folder, rows):
    kind = "doc_id long, text string, lang string, source string, n_chars long, score string, extra array<int>"
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", [1]) for i, t in rows], kind).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 9))) for _ in range(900)]

    def lines(n):
        return "\n".join(" ".join(rng.choice(words) for _ in range(12)) + "." for _ in range(n))

    shared, item = lines(5), " ".join(rng.choice(words) for _ in range(14))
    rows = [(i, lines(rng.randint(3, 9))) for i in range(30)]
    rows += [(40, rows[3][1]), (3, rows[3][1]), (41, lines(4) + "\n" + shared + "\n" + lines(4)), (42, lines(4) + "\n" + shared + "\n" + lines(4))]
    rows += [(43, lines(4) + "\nHome | News | About | Help\n" + lines(2)), (44, lines(3) + " " + item + "\n" + lines(3)), (45, None), (46, ""), (47, "few words"), (None, lines(5)), (48, lines(400))]
    return rows, item


def test_pipeline_result(spark, corpus, tmp_path):
    rows, item = corpus
    folder = made(spark, str(tmp_path), rows)
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in got}
    assert ids == (set(range(30)) | {41, 42, 43, 44, 48, None})
    # the same by the operators one after the other, the packing by its own rules
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    kept = decontam.clean(substr.clean(simhash.keep_first(quality.filter_documents(docs))), bench)
    assert kept.columns == docs.columns
    text = {r.doc_id: r.text for r in kept.collect()}
    assert "News" not in text[43] and item not in text[44] and len(text[41]) < 0.75 * len(dict(rows)[41]) and text[5] == dict(rows)[5]
    code = packing.coder(__import__("public_tokenizers").path("byte_bpe_50k.json"))
    for i in ids:
        mine = [r for r in got if r.doc_id == i]
        assert sum(r.length for r in mine) == len(code.encode([text[i]])[0]) + 1
    assert len({r.sequence_id for r in got}) <= 1.02 * sum(r.length for r in got) / 1024 + 1


def test_pipeline_of_an_empty_table(spark, tmp_path):
    folder = made(spark, str(tmp_path), [])
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_stages_keep_the_columns(spark, corpus, tmp_path):
    rows, item = corpus
    folder = made(spark, str(tmp_path), rows)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.filter("score <> 'x'").count() == 0


def test_scratch_goes(spark, tmp_path):
    import os

    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    with common.scratch_freed():
        simhash.keep_first(docs).collect()
        left = [s.base for s in common._live]
        assert os.path.isdir(left[-1])
    assert not os.path.isdir(left[-1])
