"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import compressed, decontam, fim, htmltext, langid, licenses, lmscore, packing, quality, simhash, substr, toxicity, whitening
from millrace.llm.common import table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op3_substr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substr.report(table(spark, sf_dir, "documents"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(table(spark, sf_dir, "documents"))


def op12_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_langid, op2_lmscore, op3_substr, op4_pack, op5_decontam, op6_htmltext, op7_toxicity, op8_quality, op9_simhash, op10_license,
        op11_fim, op12_compressed, op13_whitening,
    )
}
SQL = {"op5_decontam": decontam.ORACLE, "op8_quality": quality.ORACLE, "op10_license": licenses.ORACLE, "op11_fim": fim.ORACLE}
