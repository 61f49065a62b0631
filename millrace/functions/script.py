"""Script text as Column expressions: transliteration both ways, normalising, validating, cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.registry import Group, spread

# The letters of the Unicode block U+1680 and their Latin equivalents.
LATIN = "B L F S N H D T C Q M G NG Z R A O U E I EA OI UI IA AE".split()
LETTERS = "ᚁᚂᚃᚄᚅᚆᚇᚈᚉᚊᚋᚌᚍᚎᚏᚐᚑᚒᚓᚔᚕᚖᚗᚘᚙ"
SPACE, FEATHERS = " ", "᚛᚜"
DIGRAPHS = "NG|EA|OI|UI|IA|AE"


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


TO_SCRIPT = dict(zip(LATIN, LETTERS)) | {"V": "ᚃ", " ": SPACE}
TO_LATIN = dict(zip(LETTERS, LATIN)) | {SPACE: " ", FEATHERS[0]: "", FEATHERS[1]: ""}


def latin_to_script(text: Column, strict: bool = False) -> Column:
    """Digraphs first, from the left; unknown characters are skipped, or an error when strict."""
    units = F.regexp_extract_all(F.upper(text), F.lit(f"(?s)({DIGRAPHS}|.)"), F.lit(1))
    mapped = F.transform(units, lambda u: F.try_element_at(literal_map(TO_SCRIPT), u))
    if strict:
        mapped = F.transform(mapped, lambda x: F.coalesce(x, F.raise_error(F.lit("character without a letter"))))
    return F.array_join(mapped, "")


def script_to_latin(text: Column, unknown: str | None = "?") -> Column:
    """unknown None keeps characters that have no equivalent."""
    chars = F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1))
    return F.array_join(F.transform(chars, lambda c: F.coalesce(F.try_element_at(literal_map(TO_LATIN), c), c if unknown is None else F.lit(unknown))), "")


def normalize(text: Column) -> Column:
    return F.regexp_replace(text, f"[^{LETTERS}]", "")


def is_valid(text: Column) -> Column:
    return F.coalesce(text.rlike("^[ -᚟]+$"), F.lit(False))


def phonotactic(text: Column) -> Column:
    """No run of over three vowels, nor of over three other characters."""
    return ~text.rlike("[ᚐ-ᚔ]{4}|[^ᚐ-ᚔ]{4}")


def clean_transcription(text: Column) -> Column:
    """Numbers in front, gaps, marked letters and combining marks out; the block and blanks stay, as single U+1680."""
    t = F.regexp_replace(text, r"^\s*[0-9]+[.:)]?\s*", "")
    for pattern in (r"\[[.\- ]*\]", "[<>\\[\\]?]", r"\p{M}+"):
        t = F.regexp_replace(t, pattern, "")
    t = F.regexp_replace(t, "[^ -᚟ ]", "")
    t = F.regexp_replace(t, "[  ]+", SPACE)
    return F.regexp_replace(t, "^ +| +$", "")


# The four groups of plain letters, and the later ones.
GROUPS = {"Aicme Beithe (B Group)": "ᚁᚂᚃᚄᚅ", "Aicme hÚatha (H Group)": "ᚆᚇᚈᚉᚊ", "Aicme Muine (M Group)": "ᚋᚌᚍᚎᚏ", "Aicme Ailme (Vowels)": "ᚐᚑᚒᚓᚔ", "Forfeda (Supplementary)": "ᚕᚖᚗᚘᚙ", "Punctuation": "᚛᚜", "Space": SPACE}
# Shares of the letters in inscriptions.
FREQUENCIES = {
    "ᚐ": 0.15, "ᚔ": 0.11, "ᚒ": 0.07, "ᚑ": 0.04, "ᚓ": 0.02, "ᚋ": 0.12, "ᚊ": 0.09, "ᚉ": 0.08, "ᚈ": 0.06, "ᚌ": 0.05,
    "ᚄ": 0.05, "ᚂ": 0.04, "ᚅ": 0.03, "ᚁ": 0.03, "ᚇ": 0.02, "ᚆ": 0.01, "ᚃ": 0.01, "ᚏ": 0.01, "ᚎ": 0.005, "ᚍ": 0.005,
}
# Words of inscriptions that make a text easier, in the order in which they are tried.
PATTERNS = (
    "ᚋᚐᚊᚔ", "ᚋᚒᚉᚑᚔ", "ᚐᚃᚔ", "ᚉᚓᚂᚔ", "ᚐᚅᚋ", "ᚋᚐᚊᚔᚈᚈᚐᚄ", "ᚉᚒᚅᚐᚉᚐᚈᚑᚄ", "ᚉᚑᚏᚁᚁᚔ", "ᚃᚓᚇᚇᚑᚄ", "ᚉᚐᚈᚈᚒᚁᚒᚈᚈᚐᚄ", "ᚇᚑᚃᚃᚔᚅᚔᚐᚄ",
    "ᚂᚒᚌᚒᚊᚏᚔᚈ", "ᚇᚓᚌᚂᚐᚅᚅ", "ᚅᚓᚈᚈᚐᚄᚂᚑᚌᚔ", "ᚁᚏᚒᚄᚉᚉᚑᚄ", "ᚈᚏᚓᚅᚐᚌᚒᚄᚒ", "ᚌᚒᚄᚉᚒ", "ᚃᚑᚁᚐᚏᚐᚉᚔ", "ᚇᚒᚅᚐᚔᚇᚑᚅᚐᚄ", "ᚉᚐᚂᚔᚐᚉᚔ", "ᚐᚋᚋᚂᚂᚐᚌᚅᚔ",
)


def is_block_char(char: Column) -> Column:
    """One character of the block."""
    return F.coalesce(char.rlike("^[\u1680-\u169f]$") & (F.length(char) == 1), F.lit(False))


def is_letter(char: Column) -> Column:
    """A letter, a later letter or a feather mark; not the space."""
    return F.coalesce(char.rlike(f"^[{LETTERS}{FEATHERS}]$") & (F.length(char) == 1), F.lit(False))


def character_info(char: Column) -> Column:
    """struct(character, codepoint, latin, group, is_vowel, is_forfeda, frequency); null outside the block."""
    group = None
    for name, letters in GROUPS.items():
        hit = F.instr(F.lit(letters), char) > 0
        group = F.when(hit, name) if group is None else group.when(hit, name)
    told = F.struct(
        char.alias("character"),
        F.concat(F.lit("U+"), F.hex(F.encode(char, "UTF-16BE"))).alias("codepoint"),
        F.try_element_at(literal_map(dict(zip(LETTERS, LATIN))), char).alias("latin"),
        group.alias("group"),
        F.coalesce(F.instr(F.lit(GROUPS["Aicme Ailme (Vowels)"]), char) > 0, F.lit(False)).alias("is_vowel"),
        F.coalesce(F.instr(F.lit(GROUPS["Forfeda (Supplementary)"]), char) > 0, F.lit(False)).alias("is_forfeda"),
        F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in FREQUENCIES.items() for x in pair]), char), F.lit(0.0)).alias("frequency"),
    )
    return F.when(is_block_char(char), told)


def plain_spaces(text: Column) -> Column:
    """Labels for a tokenizer: the block's space becomes a blank."""
    return F.translate(text, SPACE, " ")


def words(text: Column) -> Column:
    """Split at runs of either space; at the ends, these give empty words."""
    return F.split(text, f"[{SPACE} ]+", -1)


def reading_direction(text: Column) -> Column:
    return F.when(text.startswith(FEATHERS[0]), "left_to_right").otherwise("bottom_to_top")


def character_counts(text: Column) -> Column:
    """The characters of the block, one row each when exploded."""
    return F.regexp_extract_all(text, F.lit("([\u1680-\u169f])"), F.lit(1))


def confidence(readings: Column, cleaned: Column, raw: Column) -> Column:
    """By how much of the raw text is left and by the readings' confidences and types (an array of structs)."""
    left, had = F.size(character_counts(cleaned)), F.size(character_counts(raw))
    sure = F.coalesce(F.exists(readings, lambda r: r["confidence"] == "verified"), F.lit(False))
    diplomatic = F.coalesce(F.exists(readings, lambda r: r["type"] == "diplomatic"), F.lit(False))
    return F.when((had > 0) & sure & diplomatic & (left > had * 0.8), "verified").when((had > 0) & sure & (left > had * 0.5), "probable").otherwise("uncertain")


def interpreted(readings: Column) -> Column:
    """The first interpretive reading that is script without its editorial marks, else the first diplomatic one as script."""
    of = lambda kind: F.filter(readings, lambda r: r["type"] == kind)
    plain = F.transform(of("interpretive"), lambda r: F.regexp_replace(r["text"], "[\u0323\u0331.?\u2026\\s]+", ""))
    made = F.transform(of("diplomatic"), lambda r: latin_to_script(r["text"]))
    return F.coalesce(F.get(F.filter(plain, lambda x: is_valid(x)), F.lit(0)), F.get(F.filter(made, lambda x: is_valid(x)), F.lit(0)))


def first_converted(readings: Column) -> Column:
    """The first reading that gives script text."""
    return F.get(F.filter(F.transform(readings, lambda r: latin_to_script(r["text"])), lambda x: is_valid(x)), F.lit(0))


def annotation(script: Column, latin: Column, version: Column) -> Column:
    """struct(text, version, error) of a form: Latin counts only where no script is given; empty and invalid texts are refused."""
    text = F.coalesce(F.nullif(script, F.lit("")), F.nullif(latin_to_script(latin), F.lit("")))
    error = F.when(text.isNull(), "empty").when(~is_valid(text), "invalid")
    return F.struct(F.when(error.isNull(), text).alias("text"), F.when(error.isNull(), F.coalesce(version, F.lit(0)) + 1).alias("version"), error.alias("error"))


def letter_table(spark: SparkSession) -> DataFrame:
    """The block's letters by group: the rows of the printed table."""
    return spark.createDataFrame([(g, c, dict(zip(LETTERS, LATIN)).get(c)) for g, letters in GROUPS.items() for c in letters], "group string, letter string, latin string")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


GROUP = Group()
_LETTER = "CASE u " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TO_SCRIPT.items()) + " ELSE '' END"
_BACK = "CASE c " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TO_LATIN.items()) + " ELSE '?' END"
_SCRIPT = f"array_to_string(list_transform(regexp_extract_all(upper(p_name), '(?s)({DIGRAPHS}|.)'), lambda u: {_LETTER}), '')"
_ROUND = f"array_to_string(list_transform(string_split({_SCRIPT}, ''), lambda c: {_BACK}), '')"
GROUP.frame("latin_to_script", lambda s, d: _parts(s, d).select("p_name", latin_to_script(F.col("p_name")).alias("script")), f"SELECT p_name, {_SCRIPT} AS script FROM part")
GROUP.frame("script_to_latin", lambda s, d: _parts(s, d).select("p_name", script_to_latin(latin_to_script(F.col("p_name"))).alias("latin")), f"SELECT p_name, {_ROUND} AS latin FROM part")
GROUP.frame("script_roundtrip_loss", lambda s, d: _parts(s, d).select("p_name", (script_to_latin(latin_to_script(F.col("p_name"))) != F.upper("p_name")).alias("lossy")), f"SELECT p_name, {_ROUND} <> upper(p_name) AS lossy FROM part")
GROUP.frame("normalize_script", lambda s, d: _parts(s, d).select("p_name", normalize(F.concat(F.lit("᚛"), latin_to_script(F.col("p_name")), F.lit("᚜"))).alias("letters")), f"SELECT p_name, regexp_replace('᚛' || {_SCRIPT} || '᚜', '[^{LETTERS}]', '', 'g') AS letters FROM part")
GROUP.frame("validate_script", lambda s, d: _parts(s, d).select("p_name", is_valid(latin_to_script(F.col("p_name"))).alias("valid"), is_valid(F.col("p_name")).alias("latin_valid")), f"SELECT p_name, regexp_full_match({_SCRIPT}, '[ -᚟]+') AS valid, regexp_full_match(p_name, '[ -᚟]+') AS latin_valid FROM part")
GROUP.frame("phonotactic_filter", lambda s, d: _parts(s, d).filter(phonotactic(latin_to_script(F.col("p_name")))).select("p_name"), f"SELECT p_name FROM part WHERE NOT regexp_matches({_SCRIPT}, '[ᚐ-ᚔ]{{4}}|[^ᚐ-ᚔ]{{4}}')")
_CHARS = f"(SELECT p_partkey, unnest(string_split({_SCRIPT}, '')) AS c FROM part)"


def _kinds(s: SparkSession, d: str) -> DataFrame:
    """The different letters of each part, before anything is told of them; each name's repeats go where it is read."""
    named = spread(_parts(s, d).select("p_partkey", "p_name"))
    return named.select("p_partkey", F.explode(F.array_distinct(character_counts(latin_to_script(F.col("p_name"))))).alias("c")).distinct()


def _letters(s: SparkSession, d: str) -> DataFrame:
    return _parts(s, d).select("p_partkey", F.explode(character_counts(latin_to_script(F.col("p_name")))).alias("c"))


GROUP.frame("script_char_counts", lambda s, d: _letters(s, d).groupBy("c").agg(F.count("*").alias("n")), f"SELECT c, count(*) AS n FROM {_CHARS} WHERE c <> '' GROUP BY c")
GROUP.frame(
    "character_info",
    lambda s, d: _kinds(s, d).select("p_partkey", "c", character_info(F.col("c")).alias("i")).select("p_partkey", "c", "i.codepoint", "i.latin", "i.group", "i.is_vowel", "i.frequency"),
    "SELECT DISTINCT p_partkey, c, 'U+' || upper(to_hex(unicode(c))) AS codepoint, "
    + "CASE c " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in zip(LETTERS, LATIN)) + " END AS latin, "
    + 'CASE WHEN unicode(c) BETWEEN 5761 AND 5765 THEN \'Aicme Beithe (B Group)\' WHEN unicode(c) BETWEEN 5766 AND 5770 THEN \'Aicme hÚatha (H Group)\' WHEN unicode(c) BETWEEN 5771 AND 5775 THEN \'Aicme Muine (M Group)\' WHEN unicode(c) BETWEEN 5776 AND 5780 THEN \'Aicme Ailme (Vowels)\' WHEN unicode(c) BETWEEN 5781 AND 5785 THEN \'Forfeda (Supplementary)\' ELSE \'Space\' END AS "group", '
    + "unicode(c) BETWEEN 5776 AND 5780 AS is_vowel, CASE c " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in FREQUENCIES.items()) + f" ELSE 0::DOUBLE END AS frequency FROM {_CHARS} WHERE c <> ''",
)
GROUP.frame("script_words", lambda s, d: _parts(s, d).select("p_partkey", F.size(words(latin_to_script(F.col("p_name")))).alias("n"), F.element_at(words(latin_to_script(F.col("p_name"))), 1).alias("first")), f"SELECT p_partkey, (1 + length(p_name) - length(replace(p_name, ' ', '')))::INT AS n, string_split({_SCRIPT}, '{SPACE}')[1] AS first FROM part")
GROUP.frame("plain_spaces", lambda s, d: _parts(s, d).select("p_partkey", plain_spaces(latin_to_script(F.col("p_name"))).alias("label")), f"SELECT p_partkey, replace({_SCRIPT}, '{SPACE}', ' ') AS label FROM part")
GROUP.frame("reading_direction", lambda s, d: _parts(s, d).select("p_partkey", reading_direction(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(FEATHERS[0]), F.col("p_name"))).otherwise(F.col("p_name"))).alias("direction")), "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'left_to_right' ELSE 'bottom_to_top' END AS direction FROM part")
GROUP.frame("script_to_latin_keep", lambda s, d: _parts(s, d).select("p_partkey", script_to_latin(F.concat(latin_to_script(F.col("p_name")), F.lit("-x")), None).alias("latin")), f"SELECT p_partkey, {_ROUND} || '-x' AS latin FROM part")
GROUP.frame("character_classes", lambda s, d: _kinds(s, d).select("p_partkey", "c", is_block_char(F.col("c")).alias("in_block"), is_letter(F.col("c")).alias("letter")), f"SELECT DISTINCT p_partkey, c, true AS in_block, c <> '{SPACE}' AS letter FROM {_CHARS} WHERE c <> ''")
GROUP.frame(
    "annotation_form",
    lambda s, d: _parts(s, d).select("p_partkey", annotation(F.when(F.col("p_partkey") % 3 == 0, F.lit("ᚁᚂ")).when(F.col("p_partkey") % 3 == 1, F.lit("bad")), F.col("p_name"), F.when(F.col("p_partkey") > 9, F.col("p_partkey"))).alias("a")).select("p_partkey", "a.*"),
    f"SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'ᚁᚂ' WHEN 2 THEN {_SCRIPT} END AS text, CASE WHEN p_partkey % 3 <> 1 THEN CASE WHEN p_partkey > 9 THEN p_partkey + 1 ELSE 1 END END AS version, CASE WHEN p_partkey % 3 = 1 THEN 'invalid' END AS error FROM part",
)
# the table's rows with how often the parts' names have each letter
GROUP.frame(
    "letter_table",
    lambda s, d: F.broadcast(letter_table(s)).join(_letters(s, d).groupBy(F.col("c").alias("letter")).agg(F.count("*").alias("n")), "letter", "right").select("group", "letter", "latin", "n"),
    f"WITH t(g, letter, latin) AS (VALUES " + ", ".join(f"('{g}', '{c}', {repr(dict(zip(LETTERS, LATIN))[c]) if c in LETTERS else 'NULL'})" for g, letters in GROUPS.items() for c in letters) + f') SELECT g AS "group", letter, latin, count(*) AS n FROM {_CHARS} JOIN t ON c = letter GROUP BY ALL',
)
