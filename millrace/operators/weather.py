"""Wear and variation of pictures: grain, shade, growth, fading, sensor noise, light, focus; hand-drawn variation, named enhancements.

Each picture has a generator of its own, seeded by base + index, so results do not depend on
partitions. A chain is a table of (chance, effect); an effect takes the generator, the
picture and the strengths of its severity.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.pixels import PICTURE, STEPS, _squares, array, blurred, edged, grey, otsu, run_steps
from millrace.plans.registry import Group, pieces, small_batches

# Strengths and chances of wear, by severity.
WEAR = {
    "clean": {},
    "light": {"texture": 0.10, "noise": 8, "brightness": 0.08, "blur": 0.2, "shadow": 0.2, "lichen": 0.1, "erosion": 0.1},
    "medium": {"texture": 0.20, "noise": 18, "brightness": 0.15, "blur": 0.4, "shadow": 0.5, "lichen": 0.3, "erosion": 0.3},
    "heavy": {"texture": 0.30, "noise": 30, "brightness": 0.25, "blur": 0.6, "shadow": 0.7, "lichen": 0.5, "erosion": 0.5},
}
# Scales of the grain in wear and in rendering, and the colours of what grows (blue, green, red as given).
WEAR_SCALES, RENDER_SCALES, RENDER_INTENSITY = (8, 16, 32, 64), (16, 32, 64), 0.15
GROWTH = ((90, 120, 70), (130, 140, 80), (160, 165, 140), (80, 100, 60), (170, 170, 120))
# Elastic strength and smoothness, blur range and rotation of hand-drawn variation; the ground colour.
FREEFORM = {"light": (40, 6, (0.5, 1.2), 1.5), "medium": (75, 8, (0.7, 1.8), 2.0), "heavy": (120, 10, (1.0, 2.2), 3.0)}
GROUND = 180
# Named chains of enhancement.
ENHANCEMENTS = {
    "baseline": [], "clahe": [("clahe", {"clip": 2.0, "grid": 8})], "clahe_mild": [("clahe", {"clip": 1.5, "grid": 8})], "clahe_strong": [("clahe", {"clip": 3.0, "grid": 4})],
    "bilateral": [("bilateral", {"d": 9, "colour": 75, "space": 75})], "retinex": [("retinex", {"sigmas": (15, 80, 250)})],
    "combined": [("bilateral", {"d": 5, "colour": 50, "space": 50}), ("clahe", {"clip": 1.5, "grid": 8})],
    "weathered": [("bilateral", {"d": 9, "colour": 100, "space": 100}), ("clahe", {"clip": 3.0, "grid": 4}), ("sharpen", {"sigma": 1.0, "amount": 2.0})],
}


def clipped(x: np.ndarray) -> np.ndarray:
    return np.clip(x, 0, 255).astype(np.uint8)


def settled(x: np.ndarray, whole: bool = False) -> np.ndarray:
    """As clipped (and rounded before if whole), in the room of x, whose values are lost."""
    if whole:
        np.rint(x, out=x)
    np.maximum(x, 0, out=x)
    return np.minimum(x, 255, out=x).astype(np.uint8)


def looked_up(x: np.ndarray, effect) -> np.ndarray:
    """An effect that depends on a pixel's level alone, by the table of its 256 levels."""
    return np.frombuffer(x.tobytes().translate(clipped(effect(np.arange(256.0))).tobytes()), np.uint8).reshape(x.shape)


def by_channel(x: np.ndarray, plane: np.ndarray, effect) -> np.ndarray:
    """effect(channel, plane), clipped, a channel at a time: planes have no short inner axis."""
    out, part = np.empty(x.shape, np.uint8), np.empty(x.shape[:2])
    for c in range(x.shape[2]):
        effect(x[:, :, c], plane, out=part)
        np.maximum(part, 0, out=part)
        out[:, :, c] = np.minimum(part, 255, out=part)
    return out


def roughened(x: np.ndarray, rng: np.random.Generator, spread: float) -> np.ndarray:
    """The picture with normal noise, as real values."""
    out = rng.standard_normal(x.shape)
    out *= spread
    out += x
    return out


def grain(rng: np.random.Generator, h: int, w: int, scales: tuple[int, ...]) -> np.ndarray:
    """Smooth noise of several scales, from -0.5 to 0.5."""
    out, near, far = np.zeros((h, w)), np.empty((h, w)), np.empty((h, w))
    for s in scales:
        low = rng.random((h // s + 2, w // s + 2))
        y, x = np.arange(h) / s, np.arange(w) / s
        i, j = y.astype(int), x.astype(int)
        a, b = (y - i)[:, None], (x - j)[None, :]
        wide = (1 - b) * low[:, j] + b * low[:, j + 1]
        np.multiply(np.take(wide, i, axis=0, out=near, mode="clip"), 1 - a, out=near)
        np.multiply(np.take(wide, i + 1, axis=0, out=far, mode="clip"), a, out=far)
        near += far
        out += near
    low, high = out.min(), out.max()
    if high <= low:
        return out * 0
    out -= low
    out /= high - low
    out -= 0.5
    return out


def textured(x: np.ndarray, rng: np.random.Generator, intensity: float = RENDER_INTENSITY, scales: tuple[int, ...] = RENDER_SCALES) -> np.ndarray:
    return by_channel(x, 255 * intensity * grain(rng, *x.shape[:2], scales), np.add)


def shaded(x, rng, cfg):
    """Soft dark bands across the picture."""
    h, w = x.shape[:2]
    yy, xx = np.arange(h)[:, None], np.arange(w)[None, :]
    light = np.ones((h, w))
    for _ in range(int(rng.integers(1, 4))):
        turn, spread = rng.uniform(0, np.pi), rng.uniform(0.2, 0.6) * max(h, w)
        across = (xx - rng.uniform(0.2, 0.8) * w) * np.cos(turn) + (yy - rng.uniform(0.2, 0.8) * h) * np.sin(turn)
        light -= rng.uniform(0.15, 0.4) * np.exp(-0.5 * (across / spread) ** 2)
    return by_channel(x, np.clip(light, 0.4, 1), np.multiply)


def overgrown(x, rng, cfg):
    """Irregular patches of a colour that grows on stone."""
    h, w = x.shape[:2]
    out = x.astype(float)
    for _ in range(int(rng.integers(2, 8))):
        radius = int(rng.integers(5, max(6, min(h, w) // 8)))
        at, down = int(rng.integers(0, w)), int(rng.integers(0, h))
        # nothing grows beyond the radius
        box = np.s_[max(0, down - radius) : down + radius + 1, max(0, at - radius) : at + radius + 1]
        cover = np.clip(1 - np.hypot(np.arange(w)[None, box[1]] - at, np.arange(h)[box[0], None] - down) / radius, 0, 1) ** 2
        cover = (cover * (grain(rng, h, w, (8,))[box] > -0.1) * rng.uniform(0.3, 0.7))[:, :, None]
        out[box] = out[box] * (1 - cover) + np.array(GROWTH[int(rng.integers(len(GROWTH)))])[: x.shape[2]] * cover
    return clipped(out)


def faded(x, rng, cfg):
    mean, share = x.mean(), rng.uniform(0.6, 0.85)
    return looked_up(x, lambda v: mean + (v - mean) * share)


def noisy(x, rng, cfg):
    return settled(roughened(x, rng, rng.uniform(cfg["noise"] / 2, cfg["noise"])))


def lit(x, rng, cfg):
    d = cfg["brightness"]
    contrast, brightness = rng.uniform(1 - d, 1 + d), rng.uniform(-d, d)
    return looked_up(x, lambda v: 128 + (v - 128) * contrast + 255 * brightness)


def unfocused(x, rng, cfg):
    return settled(blurred(x, float(rng.choice([0.8, 1.1]))))


#: The effects in order; a name is that of their chance in the severity, None for always.
CHAIN = ((None, lambda x, rng, cfg: textured(x, rng, cfg["texture"], WEAR_SCALES)), ("shadow", shaded), ("lichen", overgrown), ("erosion", faded), (None, noisy), (None, lit), ("blur", unfocused))


def weathered(x: np.ndarray, severity: str = "medium", seed: int = 42) -> np.ndarray:
    cfg, rng = WEAR[severity], np.random.default_rng(seed)
    for chance, effect in CHAIN if cfg else ():
        if chance is None or rng.random() < cfg[chance]:
            x = effect(x, rng, cfg)
    return x


def sampled_at(x: np.ndarray, y: np.ndarray, z: np.ndarray, ground: float) -> np.ndarray:
    """The picture at real places, between its pixels; the ground outside."""
    h, w = x.shape[:2]
    i, j = np.floor(y).astype(int), np.floor(z).astype(int)
    a, b = (y - i).ravel(), (z - j).ravel()
    # channel by channel, as long rows
    wide = np.full((x.shape[2], h + 2, w + 2), ground, float)
    wide[:, 1:-1, 1:-1] = x.transpose(2, 0, 1)
    wide = wide.reshape(len(wide), -1)
    (r0, r1), (c0, c1) = ([np.minimum(np.maximum(k + s, 0), n + 1).ravel() for s in (1, 2)] for k, n in ((i, h), (j, w)))
    r0, r1 = r0 * (w + 2), r1 * (w + 2)

    def between(r: np.ndarray) -> np.ndarray:
        left, right = wide.take(r + c0, axis=1), wide.take(r + c1, axis=1)
        left *= 1 - b
        right *= b
        left += right
        return left

    over, under = between(r0), between(r1)
    over *= 1 - a
    under *= a
    over += under
    return np.ascontiguousarray(over.T).reshape(*y.shape, x.shape[2])


def freeform(x: np.ndarray, severity: str = "medium", seed: int = 42) -> np.ndarray:
    """Wobble, blur, turn, light and thinner strokes, as of a hand-drawn trace; an unknown severity is medium."""
    alpha, smooth, blur, turn = FREEFORM.get(severity, FREEFORM["medium"])
    rng = np.random.default_rng(seed)
    h, w = x.shape[:2]
    yy, xx = np.mgrid[:h, :w].astype(float)
    # mirrored at the border: a repeated edge would weigh its few places so often that corners are torn away
    dy, dx = (alpha * blurred(rng.uniform(-1, 1, (h, w)), smooth, "reflect") for _ in range(2))
    out = sampled_at(x, yy + dy, xx + dx, GROUND)
    if rng.random() < 0.8:
        out = blurred(out, rng.uniform(*blur))
    if rng.random() < 0.7:
        t = np.deg2rad(rng.uniform(-turn, turn))
        cy, cx = (h - 1) / 2, (w - 1) / 2
        out = sampled_at(out, cy + (yy - cy) * np.cos(t) - (xx - cx) * np.sin(t), cx + (yy - cy) * np.sin(t) + (xx - cx) * np.cos(t), GROUND)
    if rng.random() < 0.6:
        out = 128 + (out - 128) * rng.uniform(0.88, 1.12) + 255 * rng.uniform(-0.08, 0.08)
    if rng.random() < 0.2:
        out = np.max([np.roll(out, s, axis) for axis in (0, 1) for s in (0, 1)], axis=0)
    return clipped(out)


def bilateral(x: np.ndarray, d: int = 9, colour: float = 75, space: float = 75) -> np.ndarray:
    """Means over a window, weighed by nearness in place and in colour."""
    r = d // 2
    h, w = x.shape[:2]
    # channel by channel, rows of one width: a place of the window is a distance in one long row, and what lies beyond the picture's width is dropped
    whole = np.ascontiguousarray(edged(x, r, r).transpose(2, 0, 1))
    across = w + 2 * r
    size = h * across - 2 * r
    whole = whole.reshape(len(whole), -1)
    wide, here = whole.astype(float), whole[:, r * across + r : r * across + r + size]
    apart = -0.5 * (np.arange(255 * x.shape[2] + 1) / colour) ** 2  # differences of colour are whole numbers
    weights: dict[int, np.ndarray] = {}
    total, mass = np.zeros((len(whole), size)), np.zeros(size)
    near, low, far, k = np.empty_like(total), np.empty_like(here), np.empty_like(here), np.empty(size)
    for i in range(-r, r + 1):
        for j in range(-r, r + 1):
            if (away := i * i + j * j) <= r * r:
                if away not in weights:
                    weights[away] = np.exp(apart - 0.5 * away / space**2)
                at = (r + i) * across + r + j
                np.maximum(whole[:, at : at + size], here, out=far)
                far -= np.minimum(whole[:, at : at + size], here, out=low)
                weights[away].take(np.add.reduce(far, axis=0, dtype=np.intp), out=k, mode="clip")
                total += np.multiply(wide[:, at : at + size], k, out=near)
                mass += k
    total /= mass
    out = np.empty((h, across, len(whole)), np.uint8)
    out.reshape(-1, len(whole))[:size] = settled(total, True).T
    return np.ascontiguousarray(out[:, :w])


def stem(x: np.ndarray) -> tuple[int, str]:
    """The column in which edges are strongest, and how sure that is: high if it holds twice the mean."""
    g = grey(x).astype(float)
    edges = np.abs(np.diff(g, axis=1, prepend=g[:, :1]))
    strong = (edges > max(otsu(clipped(edges)), 1)).sum(axis=0)
    at = int(np.argmax(strong))
    return at, "high" if strong[at] > 2 * max(strong.mean(), 1e-9) else "low"


def each(effect):
    """A step of run_steps; its seed is a parameter."""
    return lambda x, **o: effect(x, **o)


STEPS.update({"bilateral": each(bilateral), "weather": each(weathered), "freeform": each(freeform), "texture": lambda x, seed=42: textured(x, np.random.default_rng(seed))})


def enhanced(pictures: DataFrame, config: str, key: str = "id") -> DataFrame:
    if config not in ENHANCEMENTS:
        raise ValueError(f"unknown enhancement: {config}")
    return run_steps(pictures, ENHANCEMENTS[config], key)


def varied(pictures: DataFrame, kind: str, severity: str, seed: int = 42, key: str = "id") -> DataFrame:
    """Each picture worn or varied by its own seed (seed + key); kind: weather, freeform, training."""
    small_batches(pictures.sparkSession)
    src = pictures.select(key, "height", "width", "channels", "pixels")

    def run(batches):
        import pyarrow as pa

        for b in pieces(batches):
            raws = [STEPS[kind](array(h, w, c, p), severity=severity, seed=seed + k).tobytes() for k, h, w, c, p in zip(*(b.column(n).to_pylist() for n in (key, "height", "width", "channels", "pixels")))]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in (key, "height", "width", "channels")), pa.array(raws, pa.binary())], [key, "height", "width", "channels", "pixels"])

    return src.mapInArrow(run, f"{key} {src.schema[key].dataType.simpleString()}, {PICTURE}")


# Shares of synthetic rows and difficulties from an epoch on.
SCHEDULES = {
    "default": ((0, 0.95, "easy"), (10, 0.85, "medium"), (20, 0.70, "medium"), (35, 0.50, "hard")),
    "aggressive": ((0, 0.90, "easy"), (5, 0.70, "medium"), (15, 0.50, "medium"), (25, 0.30, "hard"), (40, 0.20, "hard")),
    "synthetic_only": ((0, 1.0, "easy"), (15, 1.0, "medium"), (30, 1.0, "hard")),
}


def schedules(spark: SparkSession, custom: list[tuple[int, float, str]] = ()) -> DataFrame:
    """schedule, epoch, ratio, difficulty; of a custom schedule's phases with one epoch the last counts."""
    told = [(name, *p) for name, phases in SCHEDULES.items() for p in phases] + [("custom", *p) for p in {p[0]: p for p in custom}.values()]
    return spark.createDataFrame(told, "schedule string, epoch int, ratio double, difficulty string")


GROUP = Group()


def _scheduled(s: SparkSession, d: str) -> DataFrame:
    """For each part, the phase of every schedule at the epoch that is its size: the last one that has begun."""
    part = s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_size").cast("int").alias("at"))
    phases = schedules(s, [(3, 0.5, "easy"), (3, 0.25, "hard")])
    told = phases.groupBy("schedule").agg(F.array_sort(F.collect_list(F.struct("epoch", "ratio", "difficulty"))).alias("phases"))
    begun = F.filter("phases", lambda x: x["epoch"] <= F.col("at"))
    return part.crossJoin(F.broadcast(told)).select("p_partkey", "schedule", F.try_element_at(begun, F.lit(-1)).alias("x")).filter("x IS NOT NULL").select("p_partkey", "schedule", "x.epoch", "x.ratio", "x.difficulty")


GROUP.frame(
    "schedule_tables", _scheduled,
    """WITH t(schedule, epoch, ratio, difficulty) AS (VALUES ('default', 0, 0.95::DOUBLE, 'easy'), ('default', 10, 0.85::DOUBLE, 'medium'), ('default', 20, 0.7::DOUBLE, 'medium'), ('default', 35, 0.5::DOUBLE, 'hard'),
    ('aggressive', 0, 0.9::DOUBLE, 'easy'), ('aggressive', 5, 0.7::DOUBLE, 'medium'), ('aggressive', 15, 0.5::DOUBLE, 'medium'), ('aggressive', 25, 0.3::DOUBLE, 'hard'), ('aggressive', 40, 0.2::DOUBLE, 'hard'),
    ('synthetic_only', 0, 1::DOUBLE, 'easy'), ('synthetic_only', 15, 1::DOUBLE, 'medium'), ('synthetic_only', 30, 1::DOUBLE, 'hard'), ('custom', 3, 0.25::DOUBLE, 'hard'))
    SELECT p_partkey, schedule, max(epoch)::INT AS epoch, arg_max(ratio, epoch) AS ratio, arg_max(difficulty, epoch) AS difficulty FROM part JOIN t ON epoch <= p_size GROUP BY p_partkey, schedule""",
)


def stem_report(pictures: DataFrame, key: str = "id") -> DataFrame:
    """key, the column of the stem, how sure it is, and the suggested crop: a quarter of the width to each side of a sure stem, else the middle."""
    small_batches(pictures.sparkSession)
    src = pictures.select(key, "height", "width", "channels", "pixels")

    def run(batches):
        import pyarrow as pa

        for b in pieces(batches):
            out = []
            for h, w, c, raw in zip(*(b.column(n).to_pylist() for n in ("height", "width", "channels", "pixels"))):
                at, sure = stem(array(h, w, c, raw))
                x1, x2 = (max(0, at - w // 4), min(w, at + w // 4)) if sure == "high" else (w // 10, w - w // 10)
                out.append((at, sure, x1, x2))
            names = ["stem", "confidence", "x1", "x2"]
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(key), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], [key, *names])

    return src.mapInArrow(run, f"{key} {src.schema[key].dataType.simpleString()}, stem int, confidence string, x1 int, x2 int")


# the bright box's left edge is the first of its two edges, which are equally strong
GROUP.frame("stem_reports", lambda s, d: stem_report(_squares(s, d)),
            "SELECT p_partkey AS id, (5 + p_size % 20)::INT AS stem, 'high' AS confidence, greatest(0, 5 + p_size % 20 - 15)::INT AS x1, least(60, 5 + p_size % 20 + 15)::INT AS x2 FROM part")
