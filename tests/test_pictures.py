"""Pictures at speed: the same pixels as by the plain formulas, in less time; wobble that keeps the light."""

import time

import numpy as np

from millrace.operators import draw, pixels, stems, variation, weather
from millrace.sources import pictures


def boxed(k=7, n=9):
    x = np.zeros((40, 60, 3), np.uint8)
    x[5:25, 5 + n % 20 : 35 + n % 20] = 200 + k % 50
    return x


def test_wobble_leaves_the_light():
    # the farthest of 60,000 keys when the border's places were repeated: 118,790 of the 120,000 allowed
    for k in (68462, 28089, 72049):
        x = boxed(k, k * 7919 % 50 + 1)
        assert abs(weather.freeform(x, "heavy", 42 + k).mean() - x.mean()) < 95
    # displacements near a corner are not much larger than in the middle
    fields = np.array([pixels.blurred(np.random.default_rng(k).uniform(-1, 1, (40, 60)), 10, "reflect") for k in range(200)])
    assert fields[:, 0, 0].std() < 3 * fields[:, 20, 30].std()


def plain_inside(height, width, corners):
    yy, xx = np.mgrid[:height, :width] + 0.5
    out = np.zeros((height, width), bool)
    for (x1, y1), (x2, y2) in zip(corners, np.roll(corners, -1, axis=0)):
        if y1 != y2:
            out ^= ((yy < y1) != (yy < y2)) & (xx < (x2 - x1) * (yy - y1) / (y2 - y1) + x1)
    return out


def plain_shadows(x, polygons, share):
    for corners in polygons:
        out = x.astype(float)
        out[plain_inside(*x.shape[:2], corners)] *= share
        x = weather.clipped(out)
    return x


def least_time(run, times=5):
    def once():
        t = time.process_time()
        for _ in range(20):
            run()
        return time.process_time() - t

    return min(once() for _ in range(times))


def test_shadows_over_each_other():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (40, 60, 3)).astype(np.uint8)
    for n in (1, 2, 4):
        polygons = rng.uniform((-5, -5), (65, 45), (n, 5, 2))
        assert (variation.shadowed(x, polygons, 0.5) == plain_shadows(x, polygons, 0.5)).all()
    level = np.array([(0, 0), (30, 0), (30, 40), (0, 40)], float)
    assert (variation.inside(40, 60, level) == plain_inside(40, 60, level)).all()
    assert least_time(lambda: variation.shadowed(x, polygons, 0.5)) < 0.7 * least_time(lambda: plain_shadows(x, polygons, 0.5))


def plain_wear(x, rng, spread, contrast, brightness):
    x = weather.clipped(x.astype(float) + (51 * weather.grain(rng, *x.shape[:2], (8, 16)))[:, :, None])
    x = weather.clipped(x + rng.normal(0, spread, x.shape))
    return weather.clipped(128 + (x.astype(float) - 128) * contrast + 255 * brightness)


def test_wear_of_wide_pictures():
    x = draw.drawn("ᚁᚂᚃᚄᚅ" * 4)
    rng = np.random.default_rng(3)
    y = weather.textured(x, rng, 0.2, (8, 16))
    y = weather.settled(weather.roughened(y, rng, 8))
    y = weather.looked_up(y, lambda v: 128 + (v - 128) * 1.05 + 255 * 0.02)
    assert (y == plain_wear(x, np.random.default_rng(3), 8, 1.05, 0.02)).all()
    patches = [weather.overgrown(x, np.random.default_rng(k), None) for k in range(6)]
    assert all(p.shape == x.shape and (p != x).any() and (p == x).mean() > 0.3 for p in patches)


def test_no_side_of_a_row_a_picture_is_broadcast(spark):
    named = ((draw.GROUP, "synthetic_dataset"), (draw.GROUP, "batch_styles"), (variation.GROUP, "pictures_weather"), (variation.GROUP, "pictures_combined"), (variation.GROUP, "traces_respaced"), (stems.GROUP, "planted_stems"))
    for group, name in named:
        plan = group.queries[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Broadcast" not in plan, name


def plain_bilateral(x, d, colour, space):
    r, (h, w) = d // 2, x.shape[:2]
    wide = np.pad(x.astype(float), ((r, r), (r, r), (0, 0)), mode="edge")
    total, mass = np.zeros(x.shape), np.zeros((h, w, 1))
    for i in range(-r, r + 1):
        for j in range(-r, r + 1):
            if i * i + j * j <= r * r:
                near = wide[r + i : r + i + h, r + j : r + j + w]
                far = np.abs(near - x).sum(axis=2, keepdims=True)
                k = np.exp(-0.5 * (far / colour) ** 2 - 0.5 * (i * i + j * j) / space**2)
                total += k * near
                mass += k
    return weather.clipped(np.rint(total / mass))


def test_bilateral_is_the_plain_formula_in_less_time():
    rng = np.random.default_rng(1)
    for shape in ((40, 60, 3), (7, 90, 1), (3, 2, 3)):
        x = rng.integers(0, 256, shape).astype(np.uint8)
        assert (weather.bilateral(x, 5, 50, 50) == plain_bilateral(x, 5, 50, 50)).all() and (weather.bilateral(x) == plain_bilateral(x, 9, 75, 75)).all()
    x = boxed()
    assert least_time(lambda: weather.bilateral(x), 3) < 0.45 * least_time(lambda: plain_bilateral(x, 9, 75, 75), 3)


def test_lines_end_where_no_votes_are_left(monkeypatch):
    mask = np.zeros((160, 160), bool)
    mask[:, 70] = True
    mask[20:60, 10] = True
    sums = []
    count = np.bincount
    monkeypatch.setattr(stems.np, "bincount", lambda *a, **k: sums.append(1) or count(*a, **k))
    assert stems.lines(mask) == [(70, 0, 70, 159)] and len(sums) == 1
    assert stems.lines(mask[:, :60]) == [] and len(sums) == 1
    assert stems.lines(mask[:, :60], votes=30) == [(10, 20, 10, 59)]


def test_resized_to_its_own_shape_is_not_worked_on():
    x = np.random.default_rng(1).random((12, 20))
    assert (variation.resized(x, 12, 20) == x).all() and np.allclose(variation.resized(x, 12, 10), x.reshape(12, 10, 2).mean(axis=2))
    style = variation.matched(boxed(), height=96, blur=0, noise=0, clip=0)
    assert set(np.unique(style)) == {112, 172} and (style[:, :, 0] == style[:, :, 2]).all()


def test_levels_that_get_one_more():
    for rest in range(256):
        step, level = max(256 // max(rest, 1), 1), np.arange(256)
        assert (pixels.MORE[rest] == ((level % step == 0) & (level // step < rest))).all()


def test_strokes_of_one_direction_are_inked_at_once():
    rng = np.random.default_rng(1)
    for dx, dy in ((0.0, 20.7), (9.3, -31.1)):
        at = [float(v) for v in rng.uniform(-6, 96, 70)]
        lines = [(x, 30.3, x + dx, 30.3 + dy) for x in at]
        alone = np.max([draw.covers(70, 90, [line], 2.6) for line in lines], axis=0)
        assert np.abs(draw.covers(70, 90, lines, 2.6) - alone).max() < 1e-9
    few = [(x, 30.3, x + 9.3, 3.2) for x in (10.1, 20.7, 31.9, 44.4, 58.2, 70.3, 75.5, 80.9)]
    assert least_time(lambda: draw.covers(70, 90, few, 2.6)) < 0.7 * least_time(lambda: [draw.covers(70, 90, [line], 2.6) for line in few])
    for ink in ((50, 50, 50), (200, 10, 250)):
        look = draw.style(3, ink=ink)
        x, strokes = draw.rendered("ᚁᚂᚃ ᚋᚌᚍ", look)
        stem = draw.inked(128, x.shape[1], [(draw.PADDING / 2, 64, x.shape[1] - draw.PADDING / 2, 64)], look["stem"], ink, look["ground"])
        assert (x == np.minimum(stem, draw.inked(128, x.shape[1], strokes, max(1.0, look["stem"] / 2), ink, look["ground"]))).all()


def test_plain_rows_of_a_png_are_taken_whole():
    x = np.random.default_rng(1).integers(0, 256, (200, 30, 3)).astype(np.uint8)
    assert (pictures.decoded(pictures.encoded(x)) == x).all() and (pictures.decoded(pictures.encoded(x[:, :, :1])) == x[:, :, :1]).all()
    raw = b"".join(b"\0" + r.tobytes() for r in x)
    filtered = raw[:-91] + b"\2" + raw[-90:]
    assert (pictures.unfiltered(raw, 200, 30, 3) == x).all() and (pictures.unfiltered(filtered, 200, 30, 3)[:-1] == x[:-1]).all()
    assert least_time(lambda: pictures.unfiltered(raw, 200, 30, 3)) < 0.2 * least_time(lambda: pictures.unfiltered(filtered, 200, 30, 3))
