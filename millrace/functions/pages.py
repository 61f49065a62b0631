"""Records from catalogue pages: labelled fields, readings, coordinates, references, links and images.

A page is parsed once, in an Arrow batch, and all its fields are taken from that tree. The
trees are small and live for one page; nothing is gathered over pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.extract import IMAGE_MARK
from millrace.plans.registry import Group, pieces, spread

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Labels, element ids and names of sources of the catalogue pages.
FIELDS = {"findspot": "Findspot", "object_type": "Object type", "material": "Material", "condition": "Condition"}
PLACES = ("Last recorded location", "Current repository", "Present location", "Current location")
INTERPRETIVE, DIPLOMATIC, APPARATUS, EDITION = "nav-home", "nav-profile", "apparatus", "editionF"
HISTORIC = r"Macalister\s*\([^)]+\)\s*read[^:]*:\s*(.+)"
SOURCES = {
    "interpretive": ("DIAS O3D (Interpretive)", "verified"), "interpretive_latin": ("DIAS O3D (Interpretive Latin)", "verified"),
    "diplomatic": ("DIAS O3D (Diplomatic)", "verified"), "historic": ("Macalister (1945)", "probable"),
}
READING_LABEL = r"(?i)^(Reading|Transcription):\s*"
WGS84 = r"WGS84[:\s]*(-?\d+\.\d+)[,\s]+(-?\d+\.\d+)"
OLD_LINK, OLD_TITLE = r"stone\.php.*stone=", r"(\d+[a-z]?)\.\s*(.+)"


class Element:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Element | None"):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator["Element | str"]:
        """All that lies within, in page order."""
        stack = self.children[::-1]
        while stack:
            x = stack.pop()
            yield x
            if isinstance(x, Element):
                stack.extend(x.children[::-1])

    def elements(self, *tags: str) -> Iterator["Element"]:
        return (x for x in self.walk() if isinstance(x, Element) and (not tags or x.tag in tags))

    def text(self) -> str:
        return "".join(x for x in self.walk() if isinstance(x, str))

    def joined(self) -> str:
        """Its strings, each stripped, one after the other."""
        return "".join(x.strip() for x in self.walk() if isinstance(x, str))

    def later(self) -> list["Element"]:
        """The siblings after it that are elements."""
        every = self.parent.children if self.parent else []
        at = next(i for i, x in enumerate(every) if x is self)
        return [x for x in every[at + 1 :] if isinstance(x, Element)]


class Parser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = self.root = Element("[document]", {}, None)
        self.hidden = False

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in attrs}, self.top)
        self.top.children.append(e)
        if tag not in VOID:
            self.top = e
            self.hidden = tag in ("script", "style")

    def handle_startendtag(self, tag, attrs):
        self.top.children.append(Element(tag, {k: v or "" for k, v in attrs}, self.top))

    def handle_endtag(self, tag):
        self.hidden = False
        e = self.top
        while e is not None and e.tag != tag:
            e = e.parent
        if e is not None and e.parent is not None:
            self.top = e.parent

    def handle_data(self, data):
        if not self.hidden:
            self.top.children.append(data)


def parsed(html: str | None) -> Element:
    p = Parser()
    p.feed(html or "")
    p.close()
    return p.root


def with_id(root: Element, name: str, *tags: str) -> Element | None:
    return next((e for e in root.elements(*tags) if e.attrs.get("id") == name), None)


def labelled(root: Element, label: str) -> str | None:
    """What follows a bold label: the text right after it, else the rest of the element around it."""
    for e in root.elements("b", "strong"):
        if label.lower() not in e.joined().lower():
            continue
        every = e.parent.children
        after = next((every[i + 1] for i, x in enumerate(every) if x is e and i + 1 < len(every)), None)
        if after is not None:
            value = (after if isinstance(after, str) else after.joined()).strip().lstrip(":").strip()
            if value:
                return value
        m = re.search(rf"{re.escape(label)}[^:]*[:\s]+(.+)", e.parent.joined(), re.IGNORECASE)
        if m:
            return m[1].strip()
    return None


def told(root: Element, label: str) -> str | None:
    """label: value or label - value in the page's text, else the cell after one that names the label."""
    m = re.search(rf"{label}\s*[:\-]\s*([^<\n]+)", root.text(), re.IGNORECASE)
    if m:
        return m[1].strip()
    for cell in root.elements("td"):
        if label.lower() in cell.text().lower():
            following = [x for x in cell.later() if x.tag == "td"]
            if following:
                return following[0].joined()
    return None


def pane_readings(root: Element) -> list[dict]:
    """Readings of the tab panes and of the apparatus; texts of one character don't count."""
    found: list[tuple[str, str]] = []
    for pane, kinds in ((INTERPRETIVE, ("interpretive", "interpretive_latin")), (DIPLOMATIC, ("diplomatic",))):
        e = with_id(root, pane, "div")
        editions = [x for x in e.elements("div") if x.attrs.get("id") == EDITION] if e else []
        found += [(kind, x.joined()) for kind, x in zip(kinds, editions)]
    e = with_id(root, APPARATUS, "div")
    m = re.search(HISTORIC, e.text()) if e else None
    if m:
        found.append(("historic", m[1].strip()))
    return [{"text": t, "source": SOURCES[k][0], "confidence": SOURCES[k][1], "type": k} for k, t in found if len(t) > 1]


def doubtful(text: str) -> str:
    return "uncertain" if "?" in text or "[" in text or "uncertain" in text.lower() else "probable"


def section_readings(root: Element) -> list[dict]:
    """Readings of sections by class, with the heading before them as source, then of table rows by their label."""
    out = []
    heading = "Unknown"
    for e in root.elements():
        if e.tag in ("h3", "h4", "strong"):
            heading = e.joined()
        name = e.attrs.get("class", "")
        if "reading" in name or "transcription" in name.split():
            text = re.sub(READING_LABEL, "", e.joined()).strip()
            if text:
                out.append({"text": text, "source": heading, "confidence": doubtful(text), "type": None})
    for table in root.elements("table"):
        for row in table.elements("tr"):
            cells = list(row.elements("td"))
            label = cells[0].joined().lower() if len(cells) > 1 else ""
            if "reading" in label or "transcription" in label:
                text = cells[1].joined()
                if text:
                    out.append({"text": text, "source": label.title(), "confidence": doubtful(text), "type": None})
    return out


def number(text: str | None) -> float | None:
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def coordinates(root: Element) -> tuple[float, float] | None:
    """Latitude and longitude: by element ids, by data attributes, by the text."""
    a, b = with_id(root, "lat"), with_id(root, "long")
    got = [(number(a.joined()), number(b.joined()))] if a and b else []
    got += [(number(e.attrs["data-lat"]), number(e.attrs["data-lng"])) for e in root.elements() if "data-lat" in e.attrs and "data-lng" in e.attrs]
    m = re.search(WGS84, root.text())
    got += [(float(m[1]), float(m[2]))] if m else []
    return next((x for x in got if None not in x), None)


def section(root: Element, pattern: str, headings: tuple[str, ...], stops: tuple[str, ...]) -> list[str]:
    """Texts of the elements after the first heading that matches, up to the next of the stops."""
    for e in root.elements(*headings):
        if len(e.children) == 1 and isinstance(e.children[0], str) and re.search(pattern, e.children[0], re.IGNORECASE):
            out = []
            for x in e.later():
                if x.tag in stops:
                    break
                out.append(x.joined())
            return out
    return []


def stone_name(root: Element) -> str | None:
    e = next(root.elements("h1"), None)
    if e is None:
        return None
    text = e.joined()
    return re.sub(r"\s*\([^)]+\)\s*$", "", text.split("|", 1)[1] if "|" in text else text).strip()


def images(root: Element) -> list[dict]:
    """The page's stone photographs, numbered from 0 in page order."""
    got = [(e.attrs.get("src", ""), e.attrs.get("alt", "")) for e in root.elements("img")]
    kept = [(s, a) for s, a in got if "/images/ire/" in s.lower() or re.search(IMAGE_MARK, s)]
    return [{"index": i, "src": s, "alt": a} for i, (s, a) in enumerate(kept)]


def photographs(root: Element) -> list[dict]:
    """The images of a page of the other catalogue: those below images/ or photos/, photographs unless the text says otherwise."""
    got = [(e.attrs.get("src", ""), e.attrs.get("alt", "")) for e in root.elements("img")]
    kinds = [(s, a, "drawing" if re.search("drawing|sketch", a.lower()) else "rubbing" if "rubbing" in a.lower() else "photograph") for s, a in got if "images/" in s or "photos/" in s]
    return [{"index": i, "src": s, "alt": a, "kind": k} for i, (s, a, k) in enumerate(kinds)]


def links(root: Element) -> list[dict]:
    return [{"href": e.attrs["href"], "text": e.joined()} for e in root.elements("a") if "href" in e.attrs]


def old_entries(root: Element) -> list[dict]:
    """The overview's links to stones: number and name."""
    out = []
    for x in links(root):
        m = re.match(OLD_TITLE, x["text"]) if re.search(OLD_LINK, x["href"]) else None
        if m:
            out.append({"href": x["href"], "number": m[1], "name": m[2]})
    return out


READING = "struct<text:string,source:string,confidence:string,type:string>"
RECORD = f"""name string, {', '.join(f'{k} string' for k in FIELDS)}, location string, latitude double, longitude double, readings array<{READING}>, consensus string,
  translation string, bibliography array<string>, images array<struct<index:int,src:string,alt:string>>"""


def record(html: str | None) -> dict:
    """The record of one catalogue page."""
    root = parsed(html)
    readings = pane_readings(root)
    where = coordinates(root) or (None, None)
    parts = [x for x in section(root, "TRANSLATION", ("h3",), ("h1", "h2", "h3")) if x]
    return {
        "name": stone_name(root), **{k: labelled(root, v) for k, v in FIELDS.items()},
        "location": next((v for v in (labelled(root, p) for p in PLACES) if v), None),
        "latitude": where[0], "longitude": where[1], "readings": readings,
        "consensus": next((r["text"] for kind in ("interpretive", "diplomatic", "historic") for r in readings if r["type"] == kind), None),
        "translation": " ".join(parts).strip("\"'‘’“” ") or None,
        "bibliography": [x for x in section(root, "REFERENCES?|BIBLIOGRAPHY", ("h2", "h3", "h4"), ("h1", "h2")) if len(x) > 5],
        "images": images(root),
    }


def by_page(pages: DataFrame, fields: str, read) -> DataFrame:
    """page_id and what read(html) gives, a dict of the fields."""
    src = pages.select("page_id", "html")
    schema = f"page_id {src.schema['page_id'].dataType.simpleString()}, {fields}"

    def run(batches):
        import pyarrow as pa

        for b in pieces(batches):
            rows = [read(x) for x in b.column("html").to_pylist()]
            names = list(rows[0]) if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array([r[k] for r in rows], types[k]) for k in names)], ["page_id", *names])

    from pyspark.sql.pandas.types import to_arrow_type

    types = {f.name: to_arrow_type(f.dataType) for f in pages.sparkSession.createDataFrame([], fields).schema}
    return src.mapInArrow(run, schema)


def page_records(pages: DataFrame) -> DataFrame:
    return by_page(pages, RECORD, record)


def page_links(pages: DataFrame) -> DataFrame:
    """A row per link: page_id, place, href, text. Two levels of a listing are this joined with itself on the address."""
    found = by_page(pages, "links array<struct<href:string,text:string>>", lambda x: {"links": links(parsed(x))})
    return found.select("page_id", F.posexplode("links").alias("place", "l")).select("page_id", "place", "l.href", "l.text")


GROUP = Group()
# Pages written from the parts, so that what they say is known.
_PAGE = """concat('<html><body><h1>Cloch | ', p_name, ' (no. ', p_partkey, ')</h1><script>var b = "<b>Material:</b> none";</script><p><b>Findspot:</b> ', p_brand, '</p><p><strong>Material</strong>: <i>', p_type, '</i></p><p><b>Object type:</b><span>',
  p_type, '</span></p>', CASE WHEN p_size % 2 = 0 THEN concat('<b>Present location</b>: ', p_brand) ELSE concat('<div data-lat="', p_size, '.5" data-lng="-', p_size, '.25"></div><b>Current location</b>: here') END,
  '<div id="nav-home"><div id="editionF">ᚁᚂ</div><div id="editionF">B</div></div><div id="nav-profile"><div id="editionF">', p_name, '</div></div><div id="apparatus">Macalister (1945, 3) reads: ', p_brand, '</div><h3>Translation</h3><p>“of ', p_name, '”</p><h2>References</h2><ul>abc</ul><p>Corpus ',
  p_partkey, '</p><img src="/Images/IRE/', p_partkey, '.jpg" alt="a"><img src="logo.png"><img src="x/I-KER-012-a.jpg"></body></html>')"""


def _made(s: SparkSession, d: str) -> DataFrame:
    return spread(s.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")).select(F.col("p_partkey").alias("page_id"), F.expr(_PAGE).alias("html"))


GROUP.frame(
    "page_records",
    lambda s, d: page_records(_made(s, d)).select("page_id", "name", "findspot", "material", "object_type", "location", "latitude", "longitude", "consensus", F.array_join(F.transform("readings", lambda r: F.concat_ws(":", r["type"], r["confidence"], r["text"])), "|").alias("readings"), "translation", F.array_join("bibliography", "|").alias("bibliography"), F.size("images").alias("n_images")),
    """SELECT p_partkey AS page_id, p_name AS name, p_brand AS findspot, p_type AS material, p_type AS object_type, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'here' END AS location, CASE WHEN p_size % 2 = 1 THEN p_size + 0.5::DOUBLE END AS latitude, CASE WHEN p_size % 2 = 1 THEN -p_size - 0.25::DOUBLE END AS longitude,
  'ᚁᚂ' AS consensus, 'interpretive:verified:ᚁᚂ|diplomatic:verified:' || p_name || '|historic:probable:' || p_brand AS readings, 'of ' || p_name AS translation, 'Corpus ' || p_partkey AS bibliography, 2 AS n_images FROM part""",
)
GROUP.frame(
    "section_readings",
    lambda s, d: by_page(spread(s.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")).select(F.col("p_partkey").alias("page_id"), F.expr("concat('<h3>', p_brand, '</h3><div class=\"old reading-text\">Reading: ', p_name, CASE WHEN p_size % 2 = 0 THEN ' [x]' ELSE '' END, '</div><table><tr><td>First Transcription</td><td>', p_type, '</td></tr><tr><td>County</td><td> Cork </td></tr></table>')").alias("html")),
                         f"readings array<{READING}>, county string", lambda x: {"readings": section_readings(parsed(x)), "county": told(parsed(x), "County")}).select("page_id", "county", F.array_join(F.transform("readings", lambda r: F.concat_ws(":", r["source"], r["confidence"], r["text"])), "|").alias("readings")),
    "SELECT p_partkey AS page_id, 'Cork' AS county, p_brand || CASE WHEN p_size % 2 = 0 THEN ':uncertain:' || p_name || ' [x]' ELSE ':probable:' || p_name END || '|First Transcription:probable:' || p_type AS readings FROM part",
)
GROUP.frame(
    "page_links",
    lambda s, d: page_links(s.read.parquet(f"{d}/pages.parquet").select("page_id", "html")).groupBy("page_id").agg(F.count("*").alias("n_links"), F.countDistinct("href").alias("n_targets")),
    """SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_targets FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1)) AS href FROM pages) GROUP BY page_id""",
)
