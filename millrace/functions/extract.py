"""Catalogue fields from page text, as Column expressions: numbers, places, dates, sizes, kinds, readings.

White space means that of any script, as the catalogue pages have no-break spaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import script as _script
from millrace.functions.script import LETTERS, PATTERNS
from millrace.plans.registry import Group

# Names of centuries and their last years.
CENTURIES = {
    "first": 100, "second": 200, "third": 300, "fourth": 400, "fifth": 500, "sixth": 600, "seventh": 700, "eighth": 800,
    "1st": 100, "2nd": 200, "3rd": 300, "4th": 400, "5th": 500, "6th": 600, "7th": 700, "8th": 800,
}
# Keywords in the order in which they are tried.
REGIONS = ("Ireland", "Scotland", "Wales", "Isle of Man", "Cornwall")
WEATHERING = {"severe": "badly damaged|severe|illegible|destroyed", "moderate": "weathered|damaged|worn|eroded|flaking", "minimal": "good|well preserved|clear|intact"}
IMAGE_KINDS = {"drawing": "drawing|sketch", "rubbing": "rubbing", "render_3d": "3d|render"}
VIEWS = {"front": "-a.", "back": "-b.", "side": "-c.", "detail": "-d."}
# How answers begin, and the patterns of image titles.
ANSWER_PREFIXES = ("The transcription is: ", "Transcription: ", "The Ogham text reads: ")
TITLES = (r"(?i)Ogham\s+(?:Stone\s+)?(?:at\s+)?(.+)", r"(?i)(.+?)\s+Ogham", r"(?i)CIIC\s*(\d+)")
# Licence keys in the order in which they are tried, and the licence that each stands for.
LICENCE_KEYS = {
    "cc-zero": "CC0", "cc0": "CC0", "pd": "CC0", "public domain": "CC0", "cc-by-4.0": "CC-BY", "cc-by-3.0": "CC-BY", "cc-by-2.5": "CC-BY",
    "cc-by-sa-4.0": "CC-BY-SA", "cc-by-sa-3.0": "CC-BY-SA", "cc-by-sa-2.5": "CC-BY-SA",
}
# Marks of a catalogue page, patterns of ids, and regions that a category names.
PAGE_MARKS = ("CIIC", "Findspot", "INSCRIPTION")
PROJECT_ID, IMAGE_MARK = r"^I-[A-Z]{2,4}-[A-Z]?\d{2,3}$", r"I-[A-Z]{2,4}-\d{2,3}"
LINKED_ID, LONE_ID = r"ogham\.celt\.dias\.ie/(I-[A-Z]{2,4}-[A-Z0-9]{2,4})", r"\b(I-[A-Z]{2,4}-[A-Z]?\d{2,3})\b"
CATEGORY_REGIONS = ("Ireland", "Scotland", "Wales")
# The letters that count as rare.
RARE = "ᚎᚍᚆᚃᚏᚕᚖᚗᚘᚙ"


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.nullif(F.regexp_extract(text, "(?U)" + pattern, group), F.lit(""))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def first_of(value: Column, tests: dict[str, str], otherwise: str | None) -> Column:
    """The name of the first test whose pattern the value has."""
    out = None
    for name, pattern in tests.items():
        hit = value.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def corpus_number(text: Column, loose: bool = False) -> Column:
    return found(text, r"(?i)CIIC\s*(?:no\.?\s*)?(\d+)" if loose else r"(?i)CIIC\s+(\d+)").try_cast("int")


def county(text: Column) -> Column:
    return found(text, r"Co\.\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)")


def townland(text: Column) -> Column:
    return stripped(found(text, r"Findspot[:\s]*([^(,\n]+?)(?:\s*\([^)]+\))?,\s*Co\."))


def stone_name(heading: Column) -> Column:
    """What follows the first bar of a heading, without a parenthesis at the end."""
    after = F.when(heading.contains("|"), F.regexp_replace(heading, r"^[^|]*\|", "")).otherwise(heading)
    return stripped(F.regexp_replace(after, r"(?U)\s*\([^)]+\)\s*$", ""))


def height_cm(text: Column) -> Column:
    return found(text, r"(?i)H\s+([\d.]+)\s*[x×]\s*W\s+([\d.]+)\s*[x×]\s*D\s+([\d.]+)\s*m").try_cast("double") * 100


def weathering(condition: Column) -> Column:
    """Null without text; what no keyword decides is moderate."""
    return F.when(F.length(condition) > 0, first_of(F.lower(condition), WEATHERING, "moderate"))


def image_kind(src: Column, alt: Column) -> Column:
    return first_of(F.lower(F.concat(src, F.lit(" "), alt)), IMAGE_KINDS, "photograph")


def view_angle(src: Column) -> Column:
    name = F.lower(F.substring_index(src, "/", -1))
    out = None
    for angle, mark in VIEWS.items():
        out = F.when(name.contains(mark), angle) if out is None else out.when(name.contains(mark), angle)
    return out


def region(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(low.contains(r.lower()), r) for r in REGIONS], F.lit("unknown"))


def reading_confidence(reading: Column) -> Column:
    return F.when(F.lower(reading).rlike(r"[?\[]|uncertain"), "uncertain").otherwise("probable")


def reference_id(ref: Column) -> Column:
    return F.upper(F.regexp_replace(F.regexp_replace(ref, r"(?U)[/\s]+", "_"), "[^A-Za-z0-9_]", ""))


def title_id(title: Column) -> Column:
    """Id from an image title, by the first of three patterns."""
    t = F.regexp_replace(F.regexp_replace(title, "(?i)^File:", ""), r"(?i)\.(jpg|jpeg|png|gif|tiff?)$", "")
    name = F.coalesce(*[found(t, p) for p in TITLES])
    return F.upper(F.regexp_replace(stripped(name), "[^A-Za-z0-9]+", "_"))


def century_end(word: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in CENTURIES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(word)), F.nullif(word.try_cast("int") * 100, F.lit(0)))


def year_range(text: Column) -> Column:
    """struct(first, last) of a century text: a part of a century, a range of numbered ones, else a single one; null without any."""
    part = r"(?i)(first|second|early|late|mid)\s+(?:half\s+(?:of\s+)?)?(?:the\s+)?(\w+)\s+centur"
    which, of = F.lower(found(text, part, 1)), century_end(found(text, part, 2))
    span = r"(?i)(\d+)(?:st|nd|rd|th)[\s\-]+(?:to\s+)?(\d+)(?:st|nd|rd|th)?\s*centur"
    a, z = found(text, span, 1).try_cast("int"), found(text, span, 2).try_cast("int")
    single = century_end(found(text, r"(?i)(\w+)\s+centur"))

    def years(first: Column, last: Column) -> Column:
        return F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"))

    return (
        F.when(of.isNotNull() & which.isin("first", "early"), years(of - 100, of - 50))
        .when(of.isNotNull() & (which == "mid"), years(of - 75, of - 25))
        .when(of.isNotNull(), years(of - 50, of))
        .when(a.isNotNull(), years(a * 100 - 100, z * 100))
        .when(single.isNotNull(), years(single - 100, single))
    )


def plain_answer(text: Column) -> Column:
    """A model's answer without its preamble and quotes; letters of the block and blanks stay."""
    for prefix in ANSWER_PREFIXES:
        text = F.when(text.startswith(prefix), F.substr(text, F.lit(len(prefix) + 1))).otherwise(text)
    text = stripped(text)
    for quote in ('"', "'"):
        text = F.regexp_replace(text, f"^{quote}+|{quote}+$", "")
    return stripped(F.regexp_replace(text, "[^\u1680-\u169C ]", ""))


def difficulty(text: Column, patterns: tuple[str, ...] = PATTERNS) -> Column:
    """0 (easy) to 1: by length, share of rare letters, and how many of the patterns are there; null and empty give 0."""
    n = F.length(text)
    rare = F.length(F.regexp_replace(text, f"[^{RARE}]", ""))
    regular = F.lit(0.3)
    for p in patterns:
        regular = regular - F.when(text.contains(p), 0.05).otherwise(0.0)
    score = F.least(n / 30.0, F.lit(1.0)) * 0.4 + F.least(rare / n, F.lit(1.0)) * 0.3 + F.greatest(regular, F.lit(0.0))
    return F.when(n > 0, F.least(score, F.lit(1.0))).otherwise(0.0)


def licence(short: Column, url: Column) -> Column:
    """The first key that a licence's short name or address holds; share-alike without any."""
    out = None
    for key, name in LICENCE_KEYS.items():
        hit = F.lower(F.coalesce(short, F.lit(""))).contains(key) | F.lower(F.coalesce(url, F.lit(""))).contains(key)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("CC-BY-SA")


def is_catalogue_page(html: Column) -> Column:
    hit = F.lit(False)
    for mark in PAGE_MARKS:
        hit = hit | html.contains(mark)
    return F.coalesce(hit, F.lit(False))


def is_project_id(text: Column) -> Column:
    return F.coalesce(text.rlike(PROJECT_ID), F.lit(False))


def is_stone_image(src: Column) -> Column:
    return F.coalesce(F.lower(src).contains("/images/ire/") | src.rlike(IMAGE_MARK), F.lit(False))


def new_id(html: Column) -> Column:
    """The id that an old page names: in an address, else alone."""
    return F.coalesce(found(html, LINKED_ID), found(html, LONE_ID))


def category_region(category: Column) -> Column:
    return F.coalesce(*[F.when(category.contains(r), r) for r in CATEGORY_REGIONS], F.lit("unknown"))


def glyphs(text: Column) -> Column:
    """The number of the twenty plain letters."""
    return F.length(F.regexp_replace(text, f"[^{LETTERS[:20]}]", ""))


GROUP = Group()


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet")


_LABEL = "'Findspot: ' || p_name || ' (parish), Co. Cork, CIIC ' || p_partkey || '. H ' || p_size || '.50 x W 1.10 x D 0.60 m'"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", F.expr(_LABEL).alias("label"))


GROUP.frame(
    "catalogue_fields",
    lambda s, d: _labels(s, d).select("p_partkey", corpus_number(F.col("label")).alias("number"), county(F.col("label")).alias("county"), townland(F.col("label")).alias("townland"), height_cm(F.col("label")).alias("height_cm")),
    "SELECT p_partkey, CAST(p_partkey AS INT) AS number, 'Cork' AS county, p_name AS townland, CAST(p_size || '.50' AS DOUBLE) * 100 AS height_cm FROM part",
)
GROUP.frame(
    "weathering_levels",
    lambda s, d: _parts(s, d).select("p_partkey", weathering(F.concat("p_name", F.lit(" "), F.when(F.col("p_size") > 25, "worn").otherwise("clear"))).alias("level")),
    "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'moderate' ELSE 'minimal' END AS level FROM part",
)
GROUP.frame(
    "reference_ids",
    lambda s, d: _parts(s, d).select("p_partkey", reference_id(F.concat_ws("/", "p_brand", "p_name")).alias("id")),
    r"SELECT p_partkey, upper(regexp_replace(regexp_replace(p_brand || '/' || p_name, '[/\s]+', '_', 'g'), '[^A-Za-z0-9_]', '', 'g')) AS id FROM part",
)
GROUP.frame(
    "reading_confidences",
    lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", reading_confidence(F.col("text")).alias("confidence")),
    "SELECT conv_id, turn, CASE WHEN contains(text, '?') OR contains(text, '[') OR contains(lower(text), 'uncertain') THEN 'uncertain' ELSE 'probable' END AS confidence FROM conversations",
)
GROUP.frame(
    "licence_parse",
    lambda s, d: _parts(s, d).select("p_partkey", licence(F.col("p_name"), F.concat(F.lit("https://x/licences/"), F.expr("element_at(array('CC-BY-4.0', 'cc0', 'by', 'cc-by-sa-2.5/PD', 'cc-zero'), CAST(p_partkey % 5 AS INT) + 1)"))).alias("licence")),
    "SELECT p_partkey, CASE WHEN contains(lower(p_name), 'pd') THEN 'CC0' ELSE ['CC-BY', 'CC0', 'CC-BY-SA', 'CC0', 'CC0'][p_partkey % 5 + 1] END AS licence FROM part",
)
GROUP.frame(
    "title_to_id",
    lambda s, d: _parts(s, d).select("p_partkey", title_id(F.concat(F.lit("File:"), F.expr("element_at(array('Ogham Stone at ', '', 'Ogham ', 'CIIC '), CAST(p_partkey % 4 AS INT) + 1)"), F.when(F.col("p_partkey") % 4 == 3, F.col("p_partkey").cast("string")).otherwise(F.col("p_name")), F.when(F.col("p_partkey") % 4 == 1, F.lit(" Ogham inscription")).otherwise(F.lit("")), F.lit(".JPG"))).alias("id")),
    r"SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN p_partkey::VARCHAR WHEN p_partkey % 4 = 1 THEN 'INSCRIPTION' ELSE upper(regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g')) END AS id FROM part",
)
GROUP.frame(
    "image_kind",
    lambda s, d: _parts(s, d).select("p_partkey", image_kind(F.concat(F.lit("/a/"), F.col("p_brand")), F.expr("element_at(array('A Drawing', 'sketch of a rubbing', 'Rubbing', '3D model', 'Render', 'photo'), CAST(p_partkey % 6 AS INT) + 1)")).alias("kind"), view_angle(F.concat(F.lit("/x-a./y-"), F.expr("substring('abcde', CAST(p_size % 5 AS INT) + 1, 1)"), F.lit(".JPG"))).alias("view")),
    "SELECT p_partkey, ['drawing', 'drawing', 'rubbing', 'render_3d', 'render_3d', 'photograph'][p_partkey % 6 + 1] AS kind, ['front', 'back', 'side', 'detail', NULL][p_size % 5 + 1] AS view FROM part",
)
GROUP.frame(
    "page_predicates",
    lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", is_catalogue_page(F.col("html")).alias("catalogue"), is_stone_image(F.regexp_replace("url", "^https?://[^/]+", "/images/IRE")).alias("image"), is_project_id(F.concat(F.lit("I-"), F.upper(F.substring(F.regexp_replace("url", "[^a-z]", ""), 1, 4)), F.lit("-"), F.col("page_id") % 2000)).alias("project")),
    "SELECT page_id, coalesce(contains(html, 'CIIC') OR contains(html, 'Findspot') OR contains(html, 'INSCRIPTION'), false) AS catalogue, coalesce(regexp_matches(url, '^https?://[^/]+') OR contains(lower(url), '/images/ire/'), false) AS image, coalesce(page_id % 2000 BETWEEN 10 AND 999, false) AS project FROM pages WHERE url IS NOT NULL UNION ALL SELECT page_id, coalesce(contains(html, 'CIIC') OR contains(html, 'Findspot') OR contains(html, 'INSCRIPTION'), false), false, false FROM pages WHERE url IS NULL",
)
GROUP.frame(
    "regions_named",
    lambda s, d: s.read.parquet(f"{d}/nation.parquet").select("n_name", category_region(F.concat(F.lit("Stones in "), F.when(F.col("n_nationkey") % 2 == 0, F.lit("Wales, Ireland")).otherwise(F.lit("ireland")))).alias("category"), region(F.concat(F.lit("of SCOTLAND "), F.when(F.col("n_nationkey") % 3 == 0, F.lit("or ireland")).otherwise(F.lit("")))).alias("region")),
    "SELECT n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'Ireland' ELSE 'unknown' END AS category, CASE WHEN n_nationkey % 3 = 0 THEN 'Ireland' ELSE 'Scotland' END AS region FROM nation",
)
GROUP.frame(
    "new_ids",
    lambda s, d: _parts(s, d).select("p_partkey", new_id(F.concat(F.lit("see I-KER-0"), (F.col("p_partkey") % 10).cast("string"), F.lit(" or "), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("https://ogham.celt.dias.ie/I-COR-L"), F.col("p_size"), F.lit("/x"))).otherwise(F.lit("none")))).alias("id")),
    "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_size > 0 THEN 'I-COR-L' || p_size ELSE 'I-KER-0' || p_partkey % 10 END AS id FROM part",
)
GROUP.frame(
    "text_difficulty",
    lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.round(difficulty(F.concat(F.repeat(F.lit("ᚋᚐᚊᚔ"), F.col("p_size") % 3), F.repeat(F.lit("ᚆ"), F.col("p_size") % 7), F.repeat(F.lit("ᚐ"), F.col("p_partkey").cast("int") % 40))), 9).alias("difficulty")),
    """SELECT p_partkey, CASE WHEN n = 0 THEN 0::DOUBLE ELSE round(least(least(n / 30.0::DOUBLE, 1) * 0.4::DOUBLE + (p_size % 7)::DOUBLE / n * 0.3::DOUBLE + CASE WHEN p_size % 3 > 0 THEN 0.25::DOUBLE ELSE 0.3::DOUBLE END, 1), 9) END AS difficulty FROM (SELECT *, 4 * (p_size % 3) + p_size % 7 + p_partkey % 40 AS n FROM part)""",
)
GROUP.frame(
    "reading_forms",
    lambda s, d: _parts(s, d).select("p_partkey", F.expr("filter(array(CASE WHEN p_size % 2 = 0 THEN named_struct('text', 'ᚁ̣ ᚂ…?', 'type', 'interpretive', 'confidence', 'verified') END, CASE WHEN p_size % 3 > 0 THEN named_struct('text', 'maqi', 'type', 'diplomatic', 'confidence', 'probable') END, named_struct('text', '12', 'type', 'interpretive', 'confidence', 'x')), r -> r IS NOT NULL)").alias("r"))
    .select("p_partkey", _script.interpreted(F.col("r")).alias("best"), _script.first_converted(F.col("r")).alias("first"), _script.confidence(F.col("r"), F.lit("ᚁᚂᚃᚄᚅ"), F.lit("ᚁᚂᚃᚄᚅᚁ")).alias("confidence")),
    "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'ᚁᚂ' WHEN p_size % 3 > 0 THEN 'ᚋᚐᚊᚔ' END AS best, CASE WHEN p_size % 2 = 0 THEN chr(5760) WHEN p_size % 3 > 0 THEN 'ᚋᚐᚊᚔ' END AS first, CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size % 3 > 0 THEN 'verified' ELSE 'probable' END ELSE 'uncertain' END AS confidence FROM part",
)
