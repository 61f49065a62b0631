"""Fill-in-middle transformation by escaped marker injection, in DataFrame functions only.

A text is a run of units: runs of the letters A-Z and a-z, and every other code point by
itself. The delimiter is escaped in the text, one is put after every unit (regexp_replace),
their number is the number of units, and prefix, middle and suffix are ranges of units that
substring_index cuts out; taking the delimiters out and the escapes back gives the parts.

Two cuts and the form of each document come from a digest of its doc_id, so a rerun, a lost
task or another partitioning gives the same output. A text that is empty or holds one of the
markers stays plain, as does a share of the others.

A null text counts as empty. A null doc_id is drawn as an empty id, so all such rows are cut
by the same numbers; rows of one id likewise, each by its own length. There are no ties: equal
cuts give an empty middle. Texts may be of any length; a text is cut within its own row, no
row meets another, and nothing is shuffled. An empty table gives an empty result. Columns that
are not read are carried along by transform(); report() reads doc_id and text only, whatever
else there is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 1
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Hundredths: documents that are transformed, and those among them that put the suffix first.
FIM, SPM = 90, 20
MARK, ESCAPE = "\x01", "\x02"
#: The escape with its code is one unit, as the code point that it stands for was.
UNIT = f"{ESCAPE}[01]|[A-Za-z]+|[^A-Za-z]"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}0")), F.lit(MARK), F.lit(f"{ESCAPE}1"))


def unescaped(part: Column) -> Column:
    plain = F.replace(part, F.lit(MARK), F.lit(""))
    return F.replace(F.replace(plain, F.lit(f"{ESCAPE}1"), F.lit(MARK)), F.lit(f"{ESCAPE}0"), F.lit(ESCAPE))


def cut(marked: Column, count: Column) -> Column:
    """The first count units, or the last ones of a negative count; none for 0."""
    return F.call_function("substring_index", marked, F.lit(MARK), count.cast("int"))


def drawn(doc_id: Column, seed: int, k: int) -> Column:
    """The k-th number of a document: eight hexadecimal digits of the digest of its id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: int = SEED, fim: int = FIM, spm: int = SPM, name: str = "fim") -> DataFrame:
    """docs with a struct column of the given name: n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain), output.

    fim and spm are hundredths: of the documents, and of the transformed ones that are spm.
    """
    text = F.coalesce("text", F.lit(""))
    t = docs.withColumn(name, F.struct(text.alias("text"), escaped(text).alias("escaped")))
    at = lambda field: F.col(f"`{name}`.`{field}`")

    def step(**more: Column) -> None:
        nonlocal t
        have = [f.name for f in t.schema[name].dataType.fields]
        t = t.withColumn(name, F.struct(*(at(k).alias(k) for k in have if k not in more), *(c.alias(k) for k, c in more.items())))

    step(marked=F.regexp_replace(at("escaped"), f"({UNIT})", f"$1{MARK}"))
    # each unit has one delimiter, which nothing else in the marked text is
    step(n=F.length(at("marked")) - F.length(at("escaped")))
    a, b = (F.pmod(drawn(F.col("doc_id"), seed, k), at("n") + 1) for k in (1, 2))
    held = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains(at("text"), F.lit(marker))
    plain = (at("text") == "") | held | (F.pmod(drawn(F.col("doc_id"), seed, 3), F.lit(100)) >= fim)
    form = F.when(plain, "plain").when(F.pmod(drawn(F.col("doc_id"), seed, 4), F.lit(100)) < spm, "spm").otherwise("psm")
    step(a=F.least(a, b), b=F.greatest(a, b), form=form)
    cuts = at("form") != "plain"
    step(
        prefix=F.when(cuts, unescaped(cut(at("marked"), at("a")))),
        middle=F.when(cuts, unescaped(cut(cut(at("marked"), at("b")), at("a") - at("b")))),
        suffix=F.when(cuts, unescaped(cut(at("marked"), at("b") - at("n") - 1))),
    )
    psm = F.concat(F.lit(PREFIX), at("prefix"), F.lit(SUFFIX), at("suffix"), F.lit(MIDDLE), at("middle"))
    spm_text = F.concat(F.lit(SUFFIX), at("suffix"), F.lit(PREFIX), at("prefix"), F.lit(MIDDLE), at("middle"))
    step(output=F.when(at("form") == "plain", at("text")).when(at("form") == "spm", spm_text).otherwise(psm))
    kept = ("n", "form", "prefix", "middle", "suffix", "output")
    return t.withColumn(name, F.struct(at("n").cast("long").alias("n"), *(at(k).alias(k) for k in kept[1:])))


def restored(output: Column, form: Column) -> Column:
    """The text, from a transformed one and its form alone. Parts hold no marker, so the first of each is the one that was put in."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.call_function("substring", output, F.lit(len(first) + 1))
        head = F.substring_index(body, second, 1)
        rest = F.call_function("substring", body, F.length(head) + len(second) + 1)
        return head, F.substring_index(rest, MIDDLE, 1), F.substring_index(rest, MIDDLE, -1)

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    late, early, inner = parts(SUFFIX, PREFIX)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(early, inner, late))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, lengths of prefix and middle, digests of the output and of the text that comes back from it."""
    t = transform(docs.select("doc_id", "text"))
    t = t.select("doc_id", "fim.n", "fim.form", F.length("fim.prefix").cast("long").alias("prefix_chars"), F.length("fim.middle").cast("long").alias("middle_chars"), "fim.output")
    back = restored(F.col("output"), F.col("form"))
    return t.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


#: By lists of units instead of markers; the text itself is what must come back.
ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u FROM d),
c AS (SELECT doc_id, t, u, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS y,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= {FIM} THEN 'plain'
  WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:least(x, y)], '') AS pre, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS mid, array_to_string(u[greatest(x, y) + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid ELSE '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""
