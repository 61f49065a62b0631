"""Paced requests, hub rows, early stops, picture files, wear."""

import json
from urllib.error import HTTPError, URLError

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import variation, pixels, weather
from millrace.sources import pictures, web


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, []

    def sleep(self, s):
        self.slept.append(s)
        self.now += s


def pacer(tries=3):
    c = Clock()
    return web.Pacer(2.0, tries, lambda: c.now, c.sleep), c


def test_requests_keep_their_distance():
    p, c = pacer()
    assert p.get("a", lambda u: b"x") == b"x" and c.slept == []
    c.now += 0.5
    p.get("b", lambda u: b"y")
    assert c.slept == [1.5]


def test_failed_requests_are_repeated():
    p, c = pacer()
    errors = [URLError("down"), HTTPError("u", 500, "no", None, None)]

    def fetch(url):
        if errors:
            raise errors.pop(0)
        return b"ok"

    # no response yet, so no distance; then 2 and 4 seconds, the second of which covers the distance to the error status
    assert p.get("a", fetch) == b"ok" and c.slept == [2.0, 4.0, 0.0]

    def down(url):
        raise URLError("down")

    p, c = pacer(2)
    with pytest.raises(URLError):
        p.get("a", down)
    assert c.slept == [2.0]


def test_hub_rows_go_around(spark):
    rows = spark.createDataFrame([(0, b"a", "a"), (1, b"", "b"), (2, b"c", "c"), (3, None, "d")], "i int, image binary, text string")
    assert sorted(map(tuple, web.read_hub(rows, "i", "image", ["text"]).select("i", "text").collect())) == [(0, "a"), (1, "c"), (2, "c"), (3, "a")]


def test_early_stop(spark):
    rows = spark.range(600).select("id", F.when(F.col("id") % 2 == 0, "long enough").otherwise("x").alias("text"))
    got = {r.part: r.n for r in web.early_stop(rows, "id", "text").groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert got == {"few_shot": 3, "test": 30}


def test_index_gaps(spark):
    rows = spark.createDataFrame([(1, [("a",), (None,), ("c",)])], "k int, images array<struct<url:string>>")
    assert [r["index"] for r in web.numbered_images(rows, "images", "x.url IS NOT NULL", gaps=True).collect()] == [0, 2]
    assert [r["index"] for r in web.numbered_images(rows, "images", "x.url IS NOT NULL").collect()] == [0, 1]


def test_picture_files():
    x = np.random.default_rng(1).integers(0, 255, (7, 5, 3)).astype(np.uint8)
    assert (pictures.decoded(pictures.encoded(x)) == x).all() and (pictures.decoded(pictures.encoded(x[:, :, :1])) == x[:, :, :1]).all()
    assert (pictures.decoded(b"P6 5 7 255\n" + x[:, :, ::-1].tobytes()) == x).all()
    for bad in (None, b"", b"GIF89a", pictures.encoded(x)[:40], b"P5 9 9 255\nshort"):
        with pytest.raises(ValueError):
            pictures.decoded(bad)
    # every row filter, against its definition
    raw, want = bytearray(), np.random.default_rng(2).integers(0, 255, (5, 4, 3)).astype(np.int64)
    for y in range(5):
        raw.append(y)
        for k in range(12):
            a, b, c = (int(want[y].ravel()[k - 3]) if k >= 3 else 0), (int(want[y - 1].ravel()[k]) if y else 0), (int(want[y - 1].ravel()[k - 3]) if y and k >= 3 else 0)
            near = sorted(((abs(a + b - c - v), i, v) for i, v in enumerate((a, b, c))))[0][2]
            raw.append((int(want[y].ravel()[k]) - (0, a, b, (a + b) // 2, near)[y]) % 256)
    assert (pictures.unfiltered(bytes(raw), 5, 4, 3) == want).all()


def test_wear_is_by_seed_and_severity():
    x = np.full((48, 64, 3), 180, np.uint8)
    x[20:30, 10:50] = 60
    assert (weather.weathered(x, "clean") == x).all()
    for effect in (weather.weathered, weather.freeform, variation.training):
        a, b, c = effect(x, "heavy", 1), effect(x, "heavy", 1), effect(x, "heavy", 2)
        assert a.shape == x.shape and a.dtype == np.uint8 and (a == b).all() and (a != c).any()
    assert (variation.training(x, "hard", 3) == variation.training(x, "medium", 3)).all()
    with pytest.raises(KeyError):
        weather.weathered(x, "none")
    assert abs(float(weather.grain(np.random.default_rng(1), 30, 40, (8, 16)).mean())) < 0.3


def test_filters():
    x = np.full((20, 30, 3), 100, np.uint8)
    x[:, 15:] = 200
    smooth = weather.bilateral(np.clip(x + np.random.default_rng(1).normal(0, 5, x.shape), 0, 255).astype(np.uint8), 5, 50, 50)
    assert smooth[:, :13].std() < 4 and abs(int(smooth[10, 14, 0]) - 100) < 15 and abs(int(smooth[10, 15, 0]) - 200) < 15
    assert weather.stem(x)[0] == 15 and weather.stem(x)[1] == "high"
    plain = variation.matched(x, noise=0, blur=0, clip=0, flatten=0)
    assert set(np.unique(plain)) == {80, 180} and plain.shape == variation.matched(x).shape == (384, 691, 3)
    assert set(weather.ENHANCEMENTS) == {"baseline", "clahe", "clahe_mild", "clahe_strong", "bilateral", "retinex", "combined", "weathered"}
    assert set(name for chain in weather.ENHANCEMENTS.values() for name, _ in chain) <= set(pixels.STEPS)


def test_schedules(spark):
    got = weather.schedules(spark, [(3, 0.5, "easy"), (3, 0.25, "hard")])
    assert got.filter("schedule = 'custom'").count() == 1 and got.count() == 13


def _paged(folder, name, pages):
    import json

    for i, members in enumerate(pages):
        more = f"p{i + 1}" if i + 1 < len(pages) else None
        (folder / f"{name}-{f'p{i}' if i else ''}.json").write_text(json.dumps({"members": [{"pageid": m, "title": f"t {m}"} for m in members], "continue": more}))


def test_a_listing_that_fails_keeps_what_has_come_and_says_so(spark, tmp_path):
    _paged(tmp_path, "a #1", [[1, 2], [3]])
    _paged(tmp_path, "b", [[4], [5], [6]])
    (tmp_path / "b-p1.json").write_text("no json")
    got = web.paged_listings(spark, f"file://{tmp_path}/{{name}}-{{more}}.json", ["a #1", "b", "none"], 0.0).collect()
    assert sorted((r.listing, r.place, r.pageid) for r in got if r.error is None) == [("a #1", 0, 1), ("a #1", 1, 2), ("a #1", 2, 3), ("b", 0, 4)]
    assert sorted((r.listing, r.place) for r in got if r.error) == [("b", 1), ("none", 0)]


def test_a_listing_stream_goes_on_after_a_stop(spark, tmp_path):
    site = tmp_path / "site"
    site.mkdir()
    _paged(site, "a", [[1, 2], [3], [4, 5], [6]])
    _paged(site, "b", [[7]])

    def go(pages=None):
        rows = web.listing_stream(spark, f"file://{site}/{{name}}-{{more}}.json", ["a", "b"], 0.0)
        query = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).start()
        if pages is None:
            query.processAllAvailable()
        else:  # stopped in the middle
            import time

            end = time.time() + 60
            while query.lastProgress is None and time.time() < end:
                time.sleep(0.05)
        query.stop()

    go(pages=1)
    go()
    go()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.listing, r.place, r.pageid) for r in got) == [("a", i, i + 1) for i in range(6)] + [("b", 0, 7)]


def test_offsets_are_replayed_as_they_were(tmp_path):
    _paged(tmp_path, "a", [[1, 2], [3], [4]])
    (tmp_path / "a-p1.json").write_text("{")
    reader = web.ListingStream({"base": f"file://{tmp_path}/{{name}}-{{more}}.json", "names": "a"})
    at, seen = reader.initialOffset(), []
    for _ in range(4):
        rows, then = reader.read(at)
        rows = list(rows)
        assert list(reader.readBetweenOffsets(at, then)) == rows
        seen.append((at, then, rows))
        at = then
    assert [len(rows) for _, _, rows in seen] == [2, 1, 0, 0] and seen[1][2][0][4] and at["a"]["more"] is None
    # the page can be read by now, but the stream has told that it couldn't
    _paged(tmp_path, "a", [[1, 2], [3], [4]])
    assert list(reader.readBetweenOffsets(seen[0][0], seen[1][1])) == seen[0][2] + seen[1][2]


@pytest.mark.parametrize("bits", [1, 2, 16])
def test_hub_rows_over_levels(spark, bits):
    rows = [(100 + 3 * i, b"x" if i % 11 in (3, 4) and not 40 < i < 160 else (b"" if i % 2 else None), f"t{i}") for i in range(200)]
    want, good = {}, [i for i, r in enumerate(rows) if r[1]]
    for i, r in enumerate(rows):
        want[r[0]] = rows[next((g for g in good if g >= i), good[0])][2]
    frame = spark.createDataFrame([*rows, (None, b"x", "lost")], "idx int, image binary, text string")
    got = web.read_hub(frame, "idx", "image", ["text"], bits).collect()
    assert {r.idx: r.text for r in got} == want and len(got) == 200
    assert web.read_hub(frame.filter("length(image) = 0"), "idx", "image", ["text"]).count() == 0
    plan = web.read_hub(frame, "idx", "image", ["text"])._jdf.queryExecution().optimizedPlan().toString()
    window = [x for x in plan.splitlines() if "Window [" in x]
    assert window and not any("image" in x or "text" in x for x in window)


def test_a_batch_takes_several_pages(tmp_path):
    for k, more in (("", "p1"), ("p1", "p2"), ("p2", None)):
        (tmp_path / f"a-{k}.json").write_text(json.dumps({"members": [{"pageid": len(k), "title": f"t{k}"}], "continue": more}))
    made = web.ListingStream({"base": f"file://{tmp_path}/{{name}}-{{more}}.json", "names": "a", "pages": "2"})
    rows, end = made.read(made.initialOffset())
    rows = list(rows)
    assert [r[3] for r in rows] == ["t", "tp1"] and end == {"a": {"more": "p2", "place": 2}}
    assert list(made.readBetweenOffsets(made.initialOffset(), end)) == rows
    last, done = made.read(end)
    assert [r[3] for r in last] == ["tp2"] and done == {"a": {"more": None, "place": 3}} and list(made.read(done)[0]) == []
