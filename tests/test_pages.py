"""Catalogue pages, pictures and generated texts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import pages
from millrace.operators import generate, pixels

PAGE = """<html><h1>Baile | Ballytown (Parish)</h1><p><b>Findspot:</b> Ballytown</p><p><strong>Material</strong><i></i></p><p>Condition: <b>Condition:</b></p>
<div id="nav-home"><div id="editionF">ᚁᚂ</div><div id="editionF">BL</div></div><div id="nav-profile"><div id="editionF">X</div></div>
<div id="apparatus">Macalister (1945) reads: MAQI</div><span id="lat">52.5</span><span id="long">-10.25</span>
<h3>TRANSLATION</h3><p>'of Bl'</p><h3>More</h3><h2>References</h2><p>Corpus 1945</p><p>abc</p><h2>End</h2><p>Not this one</p>
<img src="/images/ire/a-a.jpg" alt="x"><img src="logo.png"></html>"""


def test_page_record():
    got = pages.record(PAGE)
    assert (got["name"], got["findspot"], got["latitude"], got["longitude"]) == ("Ballytown", "Ballytown", 52.5, -10.25)
    # a text of one character is no reading
    assert [r["type"] for r in got["readings"]] == ["interpretive", "interpretive_latin", "historic"] and got["consensus"] == "ᚁᚂ"
    assert got["translation"] == "of Bl" and got["bibliography"] == ["Corpus 1945"] and [i["src"] for i in got["images"]] == ["/images/ire/a-a.jpg"]
    assert pages.record(None)["readings"] == [] and pages.record("")["name"] is None


def test_sections_tables_and_links():
    root = pages.parsed('<strong>Macalister</strong><p class="reading">Reading: MAQI [x]</p><table><tr><td>Diplomatic reading</td><td>AB</td></tr><tr><td>County</td><td>Cork</td></tr></table><a href="stone.php?stone=3">12a. Name here</a><a href="x">13. No</a><img src="photos/1.jpg" alt="a sketch">')
    got = pages.section_readings(root)
    assert [(r["text"], r["source"], r["confidence"]) for r in got] == [("MAQI [x]", "Macalister", "uncertain"), ("AB", "Diplomatic Reading", "probable")]
    assert pages.told(root, "County") == "Cork" and pages.told(pages.parsed("County: Kerry<br>"), "County") == "Kerry"
    assert pages.old_entries(root) == [{"href": "stone.php?stone=3", "number": "12a", "name": "Name here"}]
    assert pages.photographs(root) == [{"index": 0, "src": "photos/1.jpg", "alt": "a sketch", "kind": "drawing"}]
    assert pages.coordinates(pages.parsed("at WGS84: 51.25, -9.5")) == (51.25, -9.5)


def test_deep_pages():
    assert pages.record("<div>" * 20_000 + "x")["name"] is None


def test_sampler_is_the_same_by_row(spark):
    a = sorted(map(tuple, generate.synthetic_rows(spark, 200, "hard", 7, 1).collect()))
    assert a == sorted(map(tuple, generate.synthetic_rows(spark, 200, "hard", 7, 9).collect()))
    assert a[3][1] == generate.Sampler("hard", 10).draw() and len({r[1] for r in a}) > 50


def test_sampler_rules():
    s = generate.Sampler("easy", 1)
    got = s.batch(400)
    assert set(generate.TEMPLATES) & set(got) and any(p in x for x in got for p in ("ᚋᚐᚊᚔ",)) and generate.Sampler("easy", 1).batch(400) == got
    s.switch("hard")
    assert (s.most, s.whole) == (25, 0.30) and set(generate.LATER) <= set(s.letters)
    assert sum(generate.weights(True).values()) == pytest.approx(1) and len(set(generate.weights(uniform=True).values())) == 1
    assert generate.sounds("ᚁᚁᚁᚐ") and not generate.sounds("ᚁᚁᚁᚁ") and not generate.sounds("ᚐᚑᚒᚓ") and generate.sounds("")
    with pytest.raises(ValueError):
        generate.Sampler("none")


def test_fonts(spark):
    assert sorted(map(tuple, generate.fonts(spark.createDataFrame([("f",), ("f",)], "n string"), "n", 20, 35).collect())) == [("f", 20), ("f", 25), ("f", 30)]
    with pytest.raises(ValueError):
        generate.fonts(spark.createDataFrame([], "n string"), "n", 1, 2)


def test_picture_arithmetic():
    x = np.zeros((30, 40, 3), np.uint8)
    x[10:20, 5:35] = (10, 200, 100)
    assert pixels.grey(x)[15, 20] == round(0.114 * 10 + 0.587 * 200 + 0.299 * 100) and pixels.grey(x).shape == (30, 40)
    assert pixels.crop(x, -5, 10, 100, 20).shape == (10, 40, 3) and pixels.rotated(x).shape == (40, 30, 3)
    assert (pixels.rotated(pixels.rotated(x), clockwise=False) == x).all()
    x1, y1, x2, y2 = pixels.content_box(x)
    assert 3 <= x1 <= 6 and 8 <= y1 <= 11 and 34 <= x2 <= 37 and 19 <= y2 <= 22
    assert pixels.content_box(np.zeros((9, 9, 3), np.uint8)) == (0, 0, 9, 9)
    flat = np.full((33, 47), 90, np.uint8)
    assert pixels.clahe(flat).shape == flat.shape and len(np.unique(pixels.clahe(flat))) == 1
    ramp = np.tile(np.arange(100, 140, dtype=np.uint8), (40, 1))
    assert int(np.ptp(pixels.clahe(ramp, clip=4.0))) > int(np.ptp(ramp)) and pixels.sharpened(flat[:, :, None]).max() == 90
    assert pixels.retinex(flat[:, :, None]).max() == 0 and pixels.otsu(np.array([[0, 0, 250, 250]], np.uint8)) < 250
    assert pixels.normalised(np.full((1, 1, 3), 255, np.uint8))[0, 0, 0] == pytest.approx((1 - 0.485) / 0.229)


def test_picture_steps(spark):
    x = np.zeros((4, 6, 3), np.uint8)
    df = spark.createDataFrame([(1, 4, 6, 3, bytearray(x.tobytes())), (2, 4, 6, 3, bytearray(b"short")), (3, None, 6, 3, None)], f"id int, {pixels.PICTURE}")
    got = {r.id: r for r in pixels.run_steps(df, [("grey", {}), ("rotate", {})]).collect()}
    assert got[1].log == ["grey 4x6x1", "rotate 6x4x1"] and got[1].error is None and len(got[1].pixels) == 24
    assert got[2].error and got[2].pixels is None and got[3].error
    assert pixels.run_steps(df.filter("id > 9"), [("grey", {})]).count() == 0
    assert df.filter(F.col("id") == 1).count() == 1
