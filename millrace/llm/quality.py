"""Line-first quality rules, in DataFrame functions only.

Each line is judged alone (separator runs as in navigation bars, symbol and
exclamation noise, boilerplate phrases, short lines that end without punctuation);
failing lines are taken out, and a document that loses more than half of its line
characters is rejected. Before that, a base check rejects documents of fewer than
MIN_WORDS words and those whose words lie mostly in repeated 8-word windows.

Null and empty texts have no words, so they fail the base check. Rows are judged one
by one: repeated rows get equal results, other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BOILERPLATE = (
    r"(?i)(cookie|privacy policy|terms of (use|service)|all rights reserved|subscribe|"
    r"sign (in|up)|log ?in|enable javascript|click here|read more|back to top|skip to)"
)
ENDS = r"[.!?:;\x22'\)\]\x{201D}\x{00BB}\x{2026}]\s*$"


def let(value, body):
    """Binds value to a lambda variable, so that body can use it often at the cost of one evaluation."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words):
    """Words that lie in an 8-word window found twice or more in the text."""
    keys = F.when(
        F.size(words) >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))

    def starts(keys):
        """Starts of the windows whose key is there twice, ascending."""
        return let(
            F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))),
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        s,
                        lambda x, j: F.coalesce(F.get(s, j - 1)["k"] == x["k"], F.lit(False))
                        | F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False)),
                    ),
                    lambda x: x["i"],
                )
            ),
        )

    def covered(at):
        """The windows' words, each counted once: a start adds what lies before the next start."""
        return F.aggregate(
            F.transform(at, lambda x, j: F.least(F.coalesce(F.get(at, j + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
            F.lit(0),
            lambda a, x: a + x,
        )

    return let(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(let(starts(k), covered)))


def line_passes(line):
    n_chars = F.length(line)
    spaces = n_chars - F.length(F.translate(line, " \t", ""))
    bars = n_chars - F.length(F.translate(line, "|›»•", ""))
    symbols = n_chars - F.length(F.translate(line, SYMBOLS, ""))
    shouts = n_chars - F.length(F.translate(line, "!", ""))
    words = spaces + 1
    navigation = (bars >= 3) & (bars * 4 >= words)
    noise = (symbols * 10 > n_chars) | (shouts * 3 > words)
    boilerplate = (words <= 12) & line.rlike(BOILERPLATE)
    stub = (words <= 3) & ~line.rlike(ENDS)
    return ~(navigation | noise | boilerplate | stub | ~line.rlike(r"\p{L}"))


def judge(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the base figures, base_failed, the lost and all line characters, kept; and a struct __keep of the columns named in keep, text and n_chars being those of the lines that pass."""
    t = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select(
        *([F.struct(*[F.col(c) for c in keep]).alias("__keep")] if keep else []),
        "doc_id",
        t.alias("__t"),
        F.filter(F.split(t, SPACE), lambda w: w != "").alias("__w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
    )
    lines, length, lost = "__lines", F.length, lambda x: F.when(line_passes(x), 0).otherwise(F.length(x))
    if keep:
        # each line is judged once, for the verdict and for the text
        step = step.withColumn("__judged", F.transform("__lines", lambda x: F.struct(x.alias("x"), line_passes(x).alias("ok"))))
        lines, length, lost = "__judged", lambda x: F.length(x["x"]), lambda x: F.when(x["ok"], 0).otherwise(F.length(x["x"]))
    step = step.select(
        "*",
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.translate("__t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("__w")).cast("long").alias("n_repeat_words"),
        F.aggregate(
            lines,
            F.struct(F.lit(0).cast("long").alias("all"), F.lit(0).cast("long").alias("lost")),
            lambda a, x: F.struct(
                (a["all"] + length(x)).alias("all"),
                (a["lost"] + lost(x)).alias("lost"),
            ),
        ).alias("__c"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    step = step.withColumn("base_failed", failed)
    if keep:
        # a text that loses no line stays as it is, blank lines included
        whole, passed = F.col("__c.lost") == 0, F.array_join(F.transform(F.filter("__judged", lambda x: x["ok"]), lambda x: x["x"]), "\n")
        cleaned = {"text": F.when(whole, F.col("__keep.text")).otherwise(passed)}
        if "n_chars" in keep:
            cleaned["n_chars"] = F.when(whole, F.col("__keep.n_chars")).otherwise(F.length(passed).cast(docs.schema["n_chars"].dataType))
        step = step.withColumn("__keep", F.struct(*[cleaned.get(c, F.col("__keep").getField(c)).alias(c) for c in keep]))
    return step.select(
        *(["__keep"] if keep else []), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("__c.all").alias("line_chars"),
        F.col("__c.lost").alias("lost_chars"),
        (~F.col("base_failed") & (2 * F.col("__c.lost") <= F.col("__c.all"))).alias("kept"),
    )


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns of docs; failing lines are gone from text, and n_chars counts what is left."""
    verdicts = judge(docs, keep=tuple(docs.columns))
    # a filter would be pushed below the steps of judge, which would then be evaluated many times over
    return verdicts.select(F.inline(F.filter(F.array("__keep"), lambda _: F.col("kept"))))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
s AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM k) WHERE n >= 2),
r AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM s) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(lines) AS x FROM w),
m AS (SELECT doc_id, length(x) AS n, x,
  length(x) - length(translate(x, ' ' || chr(9), '')) + 1 AS words,
  length(x) - length(translate(x, '|' || chr(8250) || chr(187) || chr(8226), '')) AS bars,
  length(x) - length(translate(x, '#*$%&|<>', '')) AS symbols,
  length(x) - length(translate(x, '!', '')) AS shouts FROM l),
c AS (SELECT doc_id, sum(n)::BIGINT AS line_chars, sum(CASE WHEN (bars >= 3 AND bars * 4 >= words)
   OR symbols * 10 > n OR shouts * 3 > words
   OR (words <= 12 AND regexp_matches(x, '(?i)(cookie|privacy policy|terms of (use|service)|all rights reserved|subscribe|sign (in|up)|log ?in|enable javascript|click here|read more|back to top|skip to)'))
   OR (words <= 3 AND NOT regexp_matches(x, '[.!?:;\x22''\)\]\x{201D}\x{00BB}\x{2026}]\s*$'))
   OR NOT regexp_matches(x, '\p{L}') THEN n ELSE 0 END)::BIGINT AS lost_chars FROM m GROUP BY doc_id),
b AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
  (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words,
  coalesce(line_chars, 0)::BIGINT AS line_chars, coalesce(lost_chars, 0)::BIGINT AS lost_chars
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id LEFT JOIN c ON w.doc_id = c.doc_id)
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 2 * lost_chars <= line_chars AS kept FROM b
"""
