from pyspark.sql import functions as F

from millrace.functions import script


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_transliteration(spark):
    assert one(spark, script.latin_to_script, "MAQI") == "ᚋᚐᚊᚔ"
    assert "ᚍ" in one(spark, script.latin_to_script, "NGETAL")
    assert one(spark, lambda c: script.script_to_latin(script.latin_to_script(c)), "MAQI") == "MAQI"
    assert one(spark, script.script_to_latin, "ᚋ ?") == "M??"
    assert one(spark, script.latin_to_script, "") == ""


def test_validation_and_normalising(spark):
    assert one(spark, script.is_valid, "ᚋᚐᚊᚔ") and not one(spark, script.is_valid, "ᚋᚐᚊᚔX") and not one(spark, script.is_valid, "")
    assert one(spark, script.normalize, "᚛ᚋᚐᚊᚔ᚜") == "ᚋᚐᚊᚔ"
    assert one(spark, script.clean_transcription, "1. ᚋ[..]ᚐ?  ᚊ x") == "ᚋᚐ\u1680ᚊ"
    assert not one(spark, script.phonotactic, "ᚐᚐᚐᚐ") and one(spark, script.phonotactic, "ᚐᚁᚐᚁ")
