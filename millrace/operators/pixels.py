"""Picture arithmetic on Arrow batches: a picture is a row of height, width, channels and its bytes (8 bits a channel, BGR).

Each picture is worked on alone, in numpy; nothing is exploded into pixels.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.registry import Group, pieces, small_batches, spread

PICTURE = "height int, width int, channels int, pixels binary"
# Weights of blue, green and red, and the sharpening kernel's centre.
GREY = (0.114, 0.587, 0.299)
CROP_SHARE, CROP_LEAST = (0.4, 0.3), 0.05


def array(height: int, width: int, channels: int, pixels: bytes) -> np.ndarray:
    return np.frombuffer(pixels, np.uint8).reshape(height, width, channels)


def grey(x: np.ndarray) -> np.ndarray:
    if x.shape[2] == 1:
        return x[:, :, 0]
    return np.clip(np.rint(x[:, :, :3] @ np.array(GREY)), 0, 255).astype(np.uint8)


def rotated(x: np.ndarray, clockwise: bool = True) -> np.ndarray:
    return np.rot90(x, -1 if clockwise else 1)


def crop(x: np.ndarray, x1: int, y1: int, x2: int, y2: int) -> np.ndarray:
    """The box, clamped to the picture."""
    h, w = x.shape[:2]
    x1, x2 = (min(max(v, 0), w) for v in (x1, x2))
    y1, y2 = (min(max(v, 0), h) for v in (y1, y2))
    return x[y1:y2, x1:x2]


def edged(x: np.ndarray, ry: int, rx: int) -> np.ndarray:
    """The picture with its edges repeated, so many rows and columns to each side."""
    h, w = x.shape[:2]
    out = np.empty((h + 2 * ry, w + 2 * rx, *x.shape[2:]), x.dtype)
    out[ry : ry + h, rx : rx + w] = x
    out[ry : ry + h, :rx], out[ry : ry + h, rx + w :] = x[:, :1], x[:, -1:]
    out[:ry], out[ry + h :] = out[ry], out[ry + h - 1]
    return out


def blurred(x: np.ndarray, sigma: float, border: str = "edge") -> np.ndarray:
    """Gaussian, three standard deviations to each side, edges repeated (or what border names)."""
    r = max(1, int(round(3 * sigma)))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    out = x.astype(float)
    part = np.empty_like(out)
    for axis in (0, 1):
        wide = edged(out, *((r, 0) if axis == 0 else (0, r))) if border == "edge" else np.pad(out, [(r, r) if a == axis else (0, 0) for a in range(out.ndim)], mode=border)
        n = out.shape[axis]
        for i, w in enumerate(k):
            np.multiply(wide[i : i + n] if axis == 0 else wide[:, i : i + n], w, out=part if i else out)
            if i:
                out += part
    return out


def sharpened(x: np.ndarray, sigma: float = 1.0, amount: float = 1.5) -> np.ndarray:
    """Unsharp mask."""
    return np.clip(np.rint(amount * x - (amount - 1) * blurred(x, sigma)), 0, 255).astype(np.uint8)


def retinex(x: np.ndarray, sigmas: tuple[float, ...] = (15, 80, 250)) -> np.ndarray:
    """Mean over scales of log picture less log surround, stretched to 0-255."""
    y = x.astype(float) + 1
    got = sum(np.log(y) - np.log(np.maximum(blurred(y, s), 1e-6)) for s in sigmas) / len(sigmas)
    low, high = float(got.min()), float(got.max())
    return np.zeros(x.shape, np.uint8) if high <= low else np.rint(255 * (got - low) / (high - low)).astype(np.uint8)


#: The levels that get one more, for each number of such levels (a row each).
_STEP = np.maximum(256 // np.maximum(np.arange(256), 1), 1)[:, None]
MORE = (np.arange(256) % _STEP == 0) & (np.arange(256) // _STEP < np.arange(256)[:, None])


@lru_cache(16)
def _tiles(h: int, w: int, grid: int) -> tuple[np.ndarray, ...]:
    """Of a shape: where each pixel's tile has its histogram, where the four nearest tiles have their maps, and how near those below and to the right are."""
    th, tw = -(-h // grid), -(-w // grid)
    tile = (np.arange(th * grid) // th)[:, None] * grid + (np.arange(tw * grid) // tw)[None, :]
    fy, fx = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    ya, yb, xa, xb = (np.clip(v, 0, grid - 1) for v in (y0, y0 + 1, x0, x0 + 1))
    return tile * 256, *(256 * (yy[:, None] * grid + xx[None, :]) for yy, xx in ((ya, xa), (ya, xb), (yb, xa), (yb, xb))), (fy - y0)[:, None], (fx - x0)[None, :]


def clahe(x: np.ndarray, clip: float = 2.0, grid: int = 8) -> np.ndarray:
    """Contrast-limited equalisation of a grey picture: a clipped histogram a tile, mapped between the four nearest tiles."""
    h, w = x.shape
    th, tw = -(-h // grid), -(-w // grid)
    wide = np.pad(x, ((0, th * grid - h), (0, tw * grid - w)), mode="reflect" if h > 1 and w > 1 and th * grid - h < h and tw * grid - w < w else "edge")
    limit = max(int(clip * th * tw / 256), 1)
    # the histograms of all tiles at once
    tile, *corners, ay, ax = _tiles(h, w, grid)
    hist = np.bincount((tile + wide).ravel(), minlength=grid * grid * 256).reshape(-1, 256)
    held = np.minimum(hist, limit)
    over = hist.sum(axis=1, keepdims=True) - held.sum(axis=1, keepdims=True)
    held += over // 256
    held += MORE[over[:, 0] % 256]
    maps = np.cumsum(held, axis=1) * 255 / (th * tw)
    maps = np.minimum(np.rint(maps, out=maps), 255, out=maps)
    x = x.astype(np.intp)
    a, b, c, d = (maps.take(at + x) for at in corners)
    for left, right in ((a, b), (c, d)):
        left *= 1 - ax
        right *= ax
        left += right
    a *= 1 - ay
    c *= ay
    a += c
    return np.rint(a, out=a).astype(np.uint8)


def otsu(x: np.ndarray) -> int:
    """The threshold that parts a grey picture into the two most separate classes."""
    hist = np.bincount(x.ravel(), minlength=256).astype(float)
    n, below = hist.sum(), np.cumsum(hist)
    mass = np.cumsum(hist * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mass[-1] * below / n - mass) ** 2 / (below * (n - below))
    return int(np.argmax(np.nan_to_num(between, posinf=0)))


def content_box(x: np.ndarray) -> tuple[int, int, int, int]:
    """The box of what stands out: edges above Otsu's threshold, rows and columns by their share of the strongest; the whole picture if that is too small."""
    g = grey(x).astype(float)
    dy, dx = np.zeros_like(g), np.zeros_like(g)
    dy[1:-1], dx[:, 1:-1] = g[2:] - g[:-2], g[:, 2:] - g[:, :-2]
    edges = np.clip(np.hypot(dx, dy), 0, 255).astype(np.uint8)
    strong = edges > otsu(edges)
    h, w = g.shape
    rows, columns = strong.sum(axis=1), strong.sum(axis=0)
    y = np.flatnonzero(rows > CROP_SHARE[0] * rows.max(initial=0))
    c = np.flatnonzero(columns > CROP_SHARE[1] * columns.max(initial=0))
    if not len(y) or not len(c) or (y[-1] - y[0] + 1) * (c[-1] - c[0] + 1) < CROP_LEAST * h * w:
        return 0, 0, w, h
    return int(c[0]), int(y[0]), int(c[-1]) + 1, int(y[-1]) + 1


def normalised(x: np.ndarray, mean=(0.485, 0.456, 0.406), std=(0.229, 0.224, 0.225)) -> np.ndarray:
    return ((x[:, :, ::-1] / 255.0 - np.array(mean)) / np.array(std)).astype(np.float32)


STEPS = {
    "grey": lambda x, **o: grey(x)[:, :, None], "rotate": lambda x, **o: rotated(x, **o), "auto_crop": lambda x, **o: crop(x, *content_box(x)), "crop": lambda x, **o: crop(x, **o),
    "clahe": lambda x, **o: clahe(grey(x), **o)[:, :, None], "sharpen": lambda x, **o: sharpened(x, **o), "retinex": lambda x, **o: retinex(x, **o), "denoise": lambda x, sigma=1.0: np.rint(blurred(x, sigma)).astype(np.uint8),
}


def run_steps(pictures: DataFrame, steps: list[tuple[str, dict]], key: str = "id") -> DataFrame:
    """The pictures (key and PICTURE) after the named steps, and log: each step with the shape it gave. A picture that fails has an error and no pixels."""
    small_batches(pictures.sparkSession)
    src = pictures.select(key, "height", "width", "channels", "pixels")
    schema = f"{key} {src.schema[key].dataType.simpleString()}, {PICTURE}, log array<string>, error string"

    def run(batches):
        import pyarrow as pa

        for b in pieces(batches):
            out = []
            for h, w, c, raw in zip(*(b.column(k).to_pylist() for k in ("height", "width", "channels", "pixels"))):
                try:
                    x, log = array(h, w, c, raw), []
                    for name, options in steps:
                        x = STEPS[name](x, **options)
                        log.append(f"{name} {x.shape[0]}x{x.shape[1]}x{x.shape[2]}")
                    out.append((*x.shape, np.ascontiguousarray(x).tobytes(), log, None))
                except (ValueError, TypeError, KeyError) as e:
                    out.append((None, None, None, None, None, f"{type(e).__name__}: {e}"))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.string())
            names = ["height", "width", "channels", "pixels", "log", "error"]
            yield pa.RecordBatch.from_arrays([b.column(key), *(pa.array(list(col), k) for col, k in zip(zip(*out), kinds))] if out else [b.column(key), *(pa.array([], k) for k in kinds)], [key, *names])

    return src.mapInArrow(run, schema)


GROUP = Group()


def _squares(s: SparkSession, d: str, tasks: int | None = None) -> DataFrame:
    """A dark picture a part with a bright box whose place follows from the part; in so many tasks."""

    def run(batches):
        import pyarrow as pa

        for b in pieces(batches):
            raws = []
            for k, n in zip(b.column("p_partkey").to_pylist(), b.column("p_size").to_pylist()):
                x = np.zeros((40, 60, 3), np.uint8)
                x[5 : 25, 5 + n % 20 : 35 + n % 20] = 200 + k % 50
                raws.append(x.tobytes())
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("p_partkey"), pa.array([40] * n, pa.int32()), pa.array([60] * n, pa.int32()), pa.array([3] * n, pa.int32()), pa.array(raws, pa.binary())], ["id", "height", "width", "channels", "pixels"])

    small_batches(s)
    part = s.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size")
    return (part.repartition(tasks, "p_partkey") if tasks else spread(part)).mapInArrow(run, f"id long, {PICTURE}")


GROUP.frame("picture_grey", lambda s, d: run_steps(_squares(s, d), [("grey", {}), ("crop", {"x1": 30, "y1": 10, "x2": 99, "y2": 11})]).select("id", "height", "width", "channels", F.conv(F.hex(F.substring("pixels", 1, 1)), 16, 10).cast("int").alias("first")),
            "SELECT p_partkey AS id, 1::INT AS height, 30::INT AS width, 1::INT AS channels, (200 + p_partkey % 50)::INT AS first FROM part")
GROUP.frame("picture_rotate", lambda s, d: run_steps(_squares(s, d), [("rotate", {}), ("sharpen", {})]).select("id", "height", "width", F.array_join("log", ",").alias("log"), "error"),
            "SELECT p_partkey AS id, 60::INT AS height, 40::INT AS width, 'rotate 60x40x3,sharpen 60x40x3' AS log, NULL AS error FROM part")
GROUP.frame("picture_crop", lambda s, d: run_steps(_squares(s, d), [("auto_crop", {})]).select("id", "height", "width"),
            "SELECT p_partkey AS id, 22::INT AS height, 32::INT AS width FROM part")
