"""Stems of stones: edges by gradient, thinned and joined by hysteresis, lines by a Hough accumulator, the best one and the crop around it.

A picture is worked on alone, in numpy. The accumulator is exact: every edge pixel votes at every
degree, peaks are taken from the highest on, and the pixels of a peak take their votes back, so
no random order has a say. Memory is a few arrays of the picture's size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.pixels import PICTURE, array, clahe, edged, grey
from millrace.plans.registry import Group, pieces, small_batches, sorted_join, spread

# Thresholds of edges; votes, gap and least length (as a share of the height) of a line; shares of a stem's score; greatest tilt; margins of a crop.
EDGES, VOTES, GAP, LEAST = (50, 150), 100, 20, 0.3
SCORE, TILT = (0.4, 0.3, 0.3), 30
MARGIN, STRIP = 0.25, 0.1
#: Nearness of a pixel to its line, and the tangent of an eighth of a right angle's half turn.
NEAR, SECTOR = 1.0, np.tan(np.pi / 8)


def gradient(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Across and down, by 3 x 3 windows that weigh the middle twice; the border repeats."""
    p = edged(g.astype(np.int32), 1, 1)
    wide, high = p[:, 2:] - p[:, :-2], p[2:] - p[:-2]
    return wide[:-2] + 2 * wide[1:-1] + wide[2:], high[:, :-2] + 2 * high[:, 1:-1] + high[:, 2:]


def framed(mask: np.ndarray) -> np.ndarray:
    """The places of a mask's pixels in one long row of a picture with a frame of one pixel."""
    y, x = np.divmod(np.flatnonzero(mask), mask.shape[1])
    return (y + 1) * (mask.shape[1] + 2) + x + 1


def joined(weak: np.ndarray, strong: np.ndarray) -> np.ndarray:
    """The pixels of weak in whose component (eight neighbours) there is a strong one."""
    place = framed(weak)
    n, across = len(place), weak.shape[1] + 2
    at = np.full((weak.shape[0] + 2) * across, -1)
    at[place] = np.arange(n)
    links = []
    for step in (1, across, across + 1, across - 1):
        other = at[place + step]
        both = np.flatnonzero(other >= 0)
        links.append((both, other[both]))
    a, b = (np.concatenate(x) for x in zip(*links))
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        if not apart.any():
            break
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    held = np.zeros(n, bool)
    held[root[at[framed(strong)]]] = True
    out = np.zeros(weak.shape, bool)
    out[weak] = held[root]
    return out


def edges(g: np.ndarray, low: int = EDGES[0], high: int = EDGES[1]) -> np.ndarray:
    """Where the gradient is greatest across an edge, above low, and joined to a place above high."""
    dx, dy = gradient(g)
    size = np.abs(dx) + np.abs(dy)
    h, w = g.shape
    p = np.zeros((h + 2, w + 2), size.dtype)
    p[1:-1, 1:-1] = size
    # only where it is above low is it compared with its neighbours
    above = size > low
    dx, dy, place, p = dx[above], dy[above], framed(above), p.ravel()
    ax, ay = np.abs(dx), np.abs(dy)
    step = np.where(ay < SECTOR * ax, 1, np.where(ax < SECTOR * ay, w + 2, np.where((dx ^ dy) >= 0, w + 3, w + 1)))
    here = p[place]
    thin = np.zeros((h, w), bool)
    thin[above] = (here > p[place - step]) & (here >= p[place + step])
    return joined(thin, thin & (size > high))


def closed(x: np.ndarray) -> np.ndarray:
    """Grown and shrunk again by one pixel to each side, so that gaps of two pixels close."""

    def over(y: np.ndarray, border: bool, pick) -> np.ndarray:
        p = np.full((y.shape[0] + 2, y.shape[1] + 2), border)
        p[1:-1, 1:-1] = y
        rows = pick(pick(p[:-2], p[1:-1]), p[2:])
        return pick(pick(rows[:, :-2], rows[:, 1:-1]), rows[:, 2:])

    return over(over(x, False, np.logical_or), True, np.logical_and)


def lines(mask: np.ndarray, votes: int = VOTES, least: float = 0, gap: int = GAP) -> list[tuple[int, int, int, int]]:
    """Straight runs of pixels as x1, y1, x2, y2, those with most votes first."""
    y, x = np.nonzero(mask)
    turn = np.arange(180) * np.pi / 180
    cos, sin = np.cos(turn), np.sin(turn)
    reach = int(np.ceil(np.hypot(*mask.shape))) + 1
    count = np.zeros((180, 2 * reach + 1), np.int32)

    def vote(px: np.ndarray, py: np.ndarray, sign: int) -> None:
        for at in range(0, len(px), 1024):
            a, b = px[at : at + 1024], py[at : at + 1024]
            place = np.rint(cos[:, None] * a + sin[:, None] * b).astype(int) + (reach + np.arange(180) * (2 * reach + 1))[:, None]
            # few pixels touch few places
            if len(a) < 64:
                np.add.at(count.ravel(), place.ravel(), sign)
            else:
                change = np.bincount(place.ravel(), minlength=count.size).reshape(count.shape).astype(np.int32)
                np.add(count, change, out=count) if sign > 0 else np.subtract(count, change, out=count)

    alive, out = np.ones(len(x), bool), []
    # a pixel has one vote in each two places beside each other
    if len(x) >= votes:
        vote(x, y, 1)
    while len(x) and alive.sum() >= votes:
        # a line between two places has its votes in both
        pair = count[:, :-1] + count[:, 1:]
        t, r = np.unravel_index(int(pair.argmax()), pair.shape)
        if pair[t, r] < votes:
            break
        near = np.flatnonzero(alive & (np.abs(x * cos[t] + y * sin[t] - (r + 0.5 - reach)) <= NEAR))
        along = y[near] * cos[t] - x[near] * sin[t]
        near = near[np.argsort(along, kind="stable")]
        along = np.sort(along)
        for run in np.split(np.arange(len(near)), np.flatnonzero(np.diff(along) > gap) + 1):
            if along[run[-1]] - along[run[0]] >= least:
                px, py = x[near[run]].astype(float), y[near[run]].astype(float)
                # the line that is nearest to the run's pixels
                middle = np.array([px.mean(), py.mean()])
                _, axes = np.linalg.eigh(np.cov(px, py, bias=True))
                axis = axes[:, -1]
                far = (px - middle[0]) * axis[0] + (py - middle[1]) * axis[1]
                out.append(tuple(int(v) for k in (far.min(), far.max()) for v in np.rint(middle + k * axis)))
        alive[near] = False
        if alive.sum() >= votes:
            vote(x[near], y[near], -1)
    return out


def best_stem(found: list[tuple[int, int, int, int]], height: int, width: int) -> tuple[int, int, int, int] | None:
    """The line with the best score of length, distance from the middle and uprightness; of equal ones the first."""
    best, most = None, -1.0
    for x1, y1, x2, y2 in found:
        dx, dy = abs(x2 - x1), abs(y2 - y1)
        tilt = np.degrees(np.arctan2(dx, dy))
        if not dy or tilt > TILT:
            continue
        parts = np.hypot(dx, dy) / height, abs((x1 + x2) / 2 - width / 2) / (width / 2), 1 - tilt / TILT
        score = float(np.dot(SCORE, parts))
        if score > most:
            best, most = (x1, y1, x2, y2), score
    return best


def stem_of(x: np.ndarray, votes: int = VOTES) -> tuple[int, int, int, int] | None:
    h, w = x.shape[:2]
    return best_stem(lines(closed(edges(clahe(grey(x), 2.0, 8))), votes, int(h * LEAST)), h, w)


def suggested(stem: tuple[int, int, int, int] | None, height: int, width: int) -> tuple[int, int, int, int]:
    """The crop around a stem; without one, the picture but for strips at both sides."""
    if stem is None:
        strip = int(width * STRIP)
        return strip, 0, width - strip, height
    middle, margin = (stem[0] + stem[2]) // 2, int(width * MARGIN)
    return max(0, middle - margin), 0, min(width, middle + margin), height


REPORT = "stem array<int>, box array<int>, detected boolean, confidence string, needs_review boolean, height int, width int, error string"


def crop_reports(pictures: DataFrame, key: str = "id", votes: int = VOTES) -> DataFrame:
    """A row a picture: its stem (null if none is sure), the suggested box, and whether someone should look. A picture that can't be read has an error and no box."""
    small_batches(pictures.sparkSession)
    src = pictures.select(key, "height", "width", "channels", "pixels")

    def run(batches):
        import pyarrow as pa

        for b in pieces(batches):
            out = []
            for h, w, c, raw in zip(*(b.column(k).to_pylist() for k in ("height", "width", "channels", "pixels"))):
                try:
                    stem = stem_of(array(h, w, c, raw), votes)
                    out.append((stem, suggested(stem, h, w), stem is not None, "low" if stem is None else "high", stem is None, h, w, None))
                except (ValueError, TypeError) as e:
                    out.append((None, None, False, "low", True, h, w, f"{type(e).__name__}: {e}"))
            kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.string())
            names = [p.split()[0] for p in REPORT.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column(key), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], [key, *names])

    return src.mapInArrow(run, f"{key} {src.schema[key].dataType.simpleString()}, {REPORT}")


GROUP = Group()
#: Planted stones: the edge between a dark and a light side, through the middle row at PLACE + p_size % 40, tilted by p_partkey * 7 % 57 - 28 degrees; none where p_size % 5 is 0.
HEIGHT, WIDTH, PLACE = 160, 160, 60


def _stones(s, d: str) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        yy, xx = np.mgrid[:HEIGHT, :WIDTH]
        rough = (xx * 7 + yy * 13) % 5  # a little grain
        for b in pieces(batches):
            raws = []
            for k, n in zip(b.column("p_partkey").to_pylist(), b.column("p_size").to_pylist()):
                edge = PLACE + n % 40 + (yy - HEIGHT / 2) * np.tan(np.radians(k * 7 % 57 - 28))
                light = np.where((xx > edge) & (n % 5 > 0), 180, 60) + rough
                raws.append(np.repeat(light.astype(np.uint8)[:, :, None], 3, axis=2).tobytes())
            shape = [pa.array([v] * b.num_rows, pa.int32()) for v in (HEIGHT, WIDTH, 3)]
            yield pa.RecordBatch.from_arrays([b.column("p_partkey"), *shape, pa.array(raws, pa.binary())], ["id", "height", "width", "channels", "pixels"])

    return spread(s.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size")).mapInArrow(run, f"id long, {PICTURE}")


def _found(s, d: str) -> DataFrame:
    """Of each stone, whether the stem that was found lies within a pixel and a degree of the one that was planted."""
    planted = s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), (PLACE + F.col("p_size") % 40).alias("x"), F.radians(F.col("p_partkey") * 7 % 57 - 28).alias("tilt"))
    got = sorted_join(crop_reports(_stones(s, d)), planted, "id")
    x1, y1, x2, y2 = (F.col("stem")[i] for i in range(4))
    tilt = F.atan((x2 - x1) / (y2 - y1))
    off = F.abs((x1 + x2) / 2 - F.col("x") - ((y1 + y2) / 2 - HEIGHT / 2) * F.tan("tilt")) * F.cos("tilt")
    return got.select("id", "confidence", "needs_review", (off <= 1).alias("within_a_pixel"), (F.abs(F.degrees(tilt - F.col("tilt"))) <= 1).alias("within_a_degree"), (F.abs((x1 + x2) / 2 - F.col("x")) < WIDTH * MARGIN).alias("edge_in_the_box"))


GROUP.frame("planted_stems", _found,
            "SELECT p_partkey AS id, CASE WHEN p_size % 5 > 0 THEN 'high' ELSE 'low' END AS confidence, p_size % 5 = 0 AS needs_review, CASE WHEN p_size % 5 > 0 THEN true END AS within_a_pixel, CASE WHEN p_size % 5 > 0 THEN true END AS within_a_degree, CASE WHEN p_size % 5 > 0 THEN true END AS edge_in_the_box FROM part")
