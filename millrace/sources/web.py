"""Sources of the crawl: paced and repeated requests, paged listings, page files, hub tables, and the listings made of pages.

Requests go through a Python data source with a partition per listing, so a lost task asks
again for its own listing only; as a stream it keeps the continuations as its offsets. Addresses
may be files, which is how tests run offline.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from urllib.error import HTTPError, URLError
from urllib.parse import quote
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from millrace.sources import files

# Seconds between requests, by source, and how often a request is made.
RATES = {"cisp": 2.0, "dias": 3.0, "commons": 1.0}
TRIES = 3
# Lengths of texts that count, and how many rows are looked at and go to each part.
STREAM = {"rows": 500, "least": 5, "most": 30, "few_shot": 3, "test": 30}


class Pacer:
    """Requests at least `rate` seconds after the last response. A failed one is repeated after rate * (attempt + 1) seconds, up to `tries` times."""

    def __init__(self, rate: float, tries: int = TRIES, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.tries, self.clock, self.sleep, self.last = rate, tries, clock, sleep, None

    def get(self, url: str, fetch: Callable[[str], bytes]) -> bytes:
        for attempt in range(self.tries):
            if self.last is not None:
                self.sleep(max(0.0, self.rate - (self.clock() - self.last)))
            try:
                got = fetch(url)
                self.last = self.clock()
                return got
            except HTTPError:
                self.last = self.clock()  # an error status is a response as well
                if attempt + 1 == self.tries:
                    raise
            except (URLError, OSError):
                if attempt + 1 == self.tries:
                    raise
            self.sleep(self.rate * (attempt + 1))
        raise ValueError("no request allowed")


def fetched(url: str) -> bytes:
    with urlopen(url) as r:
        return r.read()


class Listing(InputPartition):
    def __init__(self, name: str):
        self.name = name


class ListingReader(DataSourceReader):
    def __init__(self, options):
        self.base, self.names = options["base"], options["names"].split("|")
        self.rate = float(options.get("rate", "0"))

    def partitions(self):
        return [Listing(n) for n in self.names]

    def read(self, partition):
        """Follows the listing's continuations. An error keeps what has come, and ends the listing with a row that tells it."""
        pacer, more = Pacer(self.rate), ""
        place = 0
        while more is not None:
            rows, more = page_rows(pacer, self.base, partition.name, more, place)
            place += len(rows)
            yield from rows


def page_rows(pacer: Pacer, base: str, name: str, more: str, place: int) -> tuple[list[tuple], str | None]:
    """Rows of one page of a listing, and its continuation; a page that fails is one row with its error, and the end."""
    try:
        page = json.loads(pacer.get(base.format(name=quote(name), more=quote(more)), fetched))
        rows = [(name, place + i, int(m["pageid"]), m["title"], None) for i, m in enumerate(page.get("members", []))]
        return rows, page.get("continue")
    except (URLError, OSError, ValueError, KeyError, TypeError) as e:
        return [(name, place, None, None, f"{type(e).__name__}: {e}"[:200])], None


LISTED = "listing string, place int, pageid long, title string, error string"


class ListingStream(SimpleDataSourceStreamReader):
    """Some pages (one, unless told) of every unfinished listing a batch. An offset has the continuation of each listing and the place that it has come to, or the end and the error that was met there."""

    def __init__(self, options):
        self.base, self.names = options["base"], options["names"].split("|")
        self.pacer, self.pages = Pacer(float(options.get("rate", "0"))), int(options.get("pages", "1"))

    def initialOffset(self) -> dict:
        return {n: {"more": "", "place": 0} for n in self.names}

    def read(self, start: dict):
        rows, end = [], {}
        for name, at in start.items():
            end[name] = at
            for _ in range(self.pages):
                at = end[name]
                if at["more"] is None:
                    break
                got, more = page_rows(self.pacer, self.base, name, at["more"], at["place"])
                rows += got
                end[name] = {"more": more, "place": at["place"] + len(got)}
                if got and got[-1][4] is not None:
                    end[name]["error"] = got[-1][4]
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict):
        """The same rows once more, after a failure: an error that was told is told again, whether or not the page can be read by now."""
        for name, at in start.items():
            more, place, goal = at["more"], at["place"], end[name]
            while more is not None and place < goal["place"]:
                if "error" in goal and place + 1 == goal["place"]:
                    yield name, place, None, None, goal["error"]
                    break
                rows, more = page_rows(self.pacer, self.base, name, more, place)
                if rows and rows[-1][4] is not None:
                    raise OSError(f"a page of {name} that was read before can't be read again: {rows[-1][4]}")
                yield from rows
                place += len(rows)


class PagedListings(DataSource):
    """Options: base (an address with {name} and {more}), names (joined by |), rate, pages (of a listing in a batch of the stream). Pages are JSON: members (pageid, title), continue."""

    @classmethod
    def name(cls):
        return "paged_listings"

    def schema(self):
        return LISTED

    def reader(self, schema):
        return ListingReader(self.options)

    def simpleStreamReader(self, schema):
        return ListingStream(self.options)


def paged_listings(spark: SparkSession, base: str, names: list[str], rate: float = RATES["commons"]) -> DataFrame:
    spark.dataSource.register(PagedListings)
    return spark.read.format("paged_listings").options(base=base, names="|".join(names), rate=str(rate)).load()


def listing_stream(spark: SparkSession, base: str, names: list[str], rate: float = RATES["commons"], pages: int = 1) -> DataFrame:
    """The listings as a stream, so many pages of each a batch (the driver holds those of a batch); started again with its checkpoint it goes on behind the last page that was taken."""
    spark.dataSource.register(PagedListings)
    return spark.readStream.format("paged_listings").options(base=base, names="|".join(names), rate=str(rate), pages=str(pages)).load()


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """Page files: url (the path), html; the last part of the path may be a glob. Listed and read by tasks."""
    root, _, glob = path.rpartition("/")
    if not glob or any(c in root for c in "*?[{"):  # folders by glob are Spark's to find
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))
    rows = files.contents(files.below(spark, root, glob, deep=False).select("path"), "html")
    url = F.col("path")
    for c in '% "#<>?[]^`{|}':  # as Spark's readers tell a file's address
        url = F.replace(url, F.lit(c), F.lit(quote(c, safe="")))
    return rows.select(url.alias("url"), F.col("html").cast("string").alias("html"))


def sound_after(rows: DataFrame, span: int, bits: int) -> DataFrame:
    """rows: at (0 to span), first (null, or an ordinal). Adds after: the next row's first that isn't null.

    Rows are searched in blocks of 2 ** bits places; what a block has no answer for comes from the same
    search over the blocks, one row each, and so on: no window holds more than a block.
    """
    if span < 1 << bits:
        whole = Window.partitionBy(F.lit(0)).orderBy("at")
        return rows.withColumn("after", F.first("first", True).over(whole.rowsBetween(1, Window.unboundedFollowing)))
    told = rows.withColumn("block", F.shiftright("at", bits))
    inside = Window.partitionBy("block").orderBy("at").rowsBetween(1, Window.unboundedFollowing)
    firsts = told.groupBy("block").agg(F.min("first").alias("first")).select(F.col("block").alias("at"), "first")
    above = sound_after(firsts, span >> bits, bits).select(F.col("at").alias("block"), F.col("after").alias("later"))
    return told.withColumn("near", F.first("first", True).over(inside)).join(above, "block").select("at", "first", F.coalesce("near", "later").alias("after"))


def read_hub(rows: DataFrame, ordinal: str, image: str, columns: list[str], bits: int = 16) -> DataFrame:
    """Rows of a hub table in which a row without a usable image takes the next sound row's columns, around the end.

    Only ordinals (unique whole numbers; rows without one go) are searched; the rows without an
    image then meet their sound row by its ordinal. Without any sound row there are no rows.
    """
    sound = F.coalesce(F.length(image) > 0, F.lit(False))
    rows = rows.filter(F.col(ordinal).isNotNull())
    low, high, least = rows.agg(F.min(ordinal), F.max(ordinal), F.min(F.when(sound, F.col(ordinal)))).first()
    if least is None:
        return rows.select(ordinal, image, *columns).limit(0)
    places = rows.select((F.col(ordinal) - low).cast("long").alias("at"), F.when(sound, F.col(ordinal)).alias("first"))
    moved = sound_after(places, high - low, bits).filter("first IS NULL").select((F.col("at") + low).alias("__at"), F.coalesce("after", F.lit(least)).alias("__sound"))
    whole = rows.filter(sound).select(ordinal, image, *columns)
    kind = rows.schema[ordinal].dataType
    taken = moved.join(whole, F.col("__sound") == F.col(ordinal)).select(F.col("__at").cast(kind).alias(ordinal), image, *columns)
    return whole.unionByName(taken)


def early_stop(rows: DataFrame, ordinal: str, text: str, limits: dict = STREAM) -> DataFrame:
    """The first rows of a stream by ordinal whose length counts: the first of them few-shot examples, the next ones the test."""
    some = rows.orderBy(ordinal).limit(limits["rows"]).filter(F.length(text).between(limits["least"], limits["most"]))
    ranked = some.withColumn("__n", F.row_number().over(Window.orderBy(ordinal)))
    part = F.when(F.col("__n") <= limits["few_shot"], "few_shot").when(F.col("__n") <= limits["few_shot"] + limits["test"], "test")
    return ranked.withColumn("part", part).filter("part IS NOT NULL").drop("__n")


def two_levels(index: DataFrame, sites: DataFrame) -> DataFrame:
    """index, sites: page, href, text (links of the index pages and of the site pages). The stones of each site; a site that has no page is left out."""
    s = sites.select(F.col("page").alias("site"), F.col("href").alias("stone"), F.col("text").alias("name"))
    return index.select(F.col("href").alias("site")).distinct().join(s, "site")


def numbered_images(rows: DataFrame, images: str, keep: str | None = None, gaps: bool = False) -> DataFrame:
    """Explodes an array of images with their index: after a filter of the array, or before it, so that what goes leaves gaps."""
    source = F.col(images) if gaps or keep is None else F.expr(f"filter({images}, x -> {keep})")
    out = rows.select(*[c for c in rows.columns if c != images], F.posexplode(source).alias("index", "image"))
    return out.filter(F.expr(keep.replace("x.", "image."))) if gaps and keep else out


def image_records(rows: DataFrame) -> DataFrame:
    """rows: stone_id, source, index, url. A metadata row each: id, file name, status; a row without an address fails with its error."""
    image_id = F.substring(F.md5(F.concat_ws("_", "stone_id", "source", F.col("index").cast("string"))), 1, 12)
    extension = F.lower(F.regexp_extract("url", r"\.([A-Za-z0-9]+)(?:\?.*)?$", 1))
    failed = F.coalesce(F.col("url"), F.lit("")) == ""
    return rows.select(
        image_id.alias("image_id"), "stone_id", "source", "url",
        F.when(~failed, F.concat(F.col("stone_id"), F.lit("_"), F.format_string("%03d", F.col("index").cast("int")), F.lit("."), F.when(extension == "", "jpg").otherwise(extension))).alias("file"),
        F.when(failed, "failed").otherwise("ok").alias("status"), F.when(failed, "no address").alias("error"),
    )


def settings(spark: SparkSession) -> DataFrame:
    """The sources and their pace."""
    return spark.createDataFrame([(k, v, TRIES) for k, v in RATES.items()], "source string, rate double, tries int")
