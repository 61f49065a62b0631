"""Whitening of embeddings from an exact covariance, by digit-slice matrix products.

Entries become integers. A block of integer vectors is split into limbs of LIMB bits; the
products of two limbs' matrices are sums of whole numbers below 2 ** 53, so float64 BLAS gives
them exactly. Limb products are recombined as big integers, partitions' matrices are merged
digit by digit in Spark, and the covariance is rounded once, from the exact quotient, before its
eigenvectors are taken. The covariance of what comes out is measured in a second pass.

Every distinct vector counts once in the fit (one shuffle, which combines equal vectors before
it); all rows are whitened. The driver gets one matrix, whose size depends on the dimension alone.

Rows whose vector is null or holds a null or an entry that isn't finite go. The dimension is the
longest remaining vector's; a shorter one, an empty one too, is filled up with zeros. Entries
beyond 2 ** 62 / 64 count as that. Components without variance (a share of the first
one's that rounding can't tell from 0) have no whitened value and are left out, so a table of
fewer than two distinct vectors gives no rows. Of equal eigenvalues the order is the solver's,
the same for all rows. A deviation beyond a long is null. Only vec_id and embedding are read,
whatever other columns there are; ids may be null or repeated.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch

SCALE, SHIFT, TOP = 64, 1_000_000, 16
#: Products of two limbs lie below 2 ** 32; ROWS of them below 2 ** 50, eight such sums below 2 ** 53.
LIMB, ROWS = 16, 1 << 18
#: Bits of a digit in which partitions hand over their sums.
DIGIT = 60
FAR = float(1 << 62)


def vectors(column, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Of an Arrow column of lists of doubles: which rows remain, and their integer vectors of d entries."""
    import pyarrow as pa
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), np.maximum(sizes, 0))
    keep = (sizes >= 0) & (np.bincount(row, ~np.isfinite(flat), len(sizes)) == 0)
    starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    inside = keep[row]
    out = np.zeros((len(sizes), d))
    out[row[inside], (np.arange(len(flat)) - starts[row])[inside]] = flat[inside]
    with np.errstate(over="ignore"):
        return keep, np.clip(np.floor(SCALE * out[keep]), -FAR, FAR).astype(np.int64) + SHIFT


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """x as float64 matrices of LIMB bits, lowest first; all but the last are non-negative."""
    out = []
    while True:
        if x.size == 0 or (x.min() >= -(1 << (LIMB - 1)) and x.max() < 1 << (LIMB - 1)):
            return [*out, x.astype(np.float64)]
        out.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x = x >> LIMB


class Gram:
    """Exact sums of products of the columns of integer blocks."""

    def __init__(self, d: int):
        self.total, self.waiting, self.rows = np.zeros((d, d), object), {}, 0

    def add(self, x: np.ndarray) -> None:
        for i in range(0, len(x), ROWS):
            part = limbs(x[i : i + ROWS])
            if self.rows + len(part[0]) > ROWS:
                self.fold()
            self.rows += len(part[0])
            for a, low in enumerate(part):
                for b, high in enumerate(part[a:], a):
                    p = low.T @ high
                    if a < b:
                        p = p + p.T
                    self.waiting[a + b, a == b] = self.waiting.get((a + b, a == b), 0) + p

    def fold(self) -> None:
        """Limb products into the big integers."""
        for (place, _), p in self.waiting.items():
            self.total += p.astype(np.int64).astype(object) << (LIMB * place)
        self.waiting, self.rows = {}, 0

    def digits(self) -> list[tuple[int, int, int, int]]:
        """Row, column, place and digit of the upper triangle; the last digit has the sign."""
        self.fold()
        out = []
        for i, row in enumerate(self.total):
            for j in range(i, len(row)):
                v, place = int(row[j]), 0
                while not -(1 << DIGIT) <= v < 1 << DIGIT:
                    out.append((i, j, place, v & ((1 << DIGIT) - 1)))
                    v, place = v >> DIGIT, place + 1
                out.append((i, j, place, v))
        return out


@dataclass
class Model:
    n: int
    sums: list[int]
    axes: np.ndarray  # one column for each component
    values: np.ndarray  # eigenvalues
    explained: np.ndarray

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: int64 where that holds it, else Python's integers."""
        far = self.n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in self.sums), default=0)
        if far < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def project(self, y: np.ndarray) -> np.ndarray:
        """Whitened vectors of deviations."""
        return (y.astype(np.float64) / self.n) @ self.axes / np.sqrt(self.values)


def squares(y: np.ndarray) -> list[int | None]:
    """The sum of squares of each row; None where a long can't hold it."""
    top = int(np.abs(y).max(initial=0))
    if top * top * y.shape[1] < 1 << 62:
        return (y.astype(np.int64) ** 2).sum(1).tolist()
    return [s if (s := sum(int(v) ** 2 for v in row)) < 1 << 63 else None for row in y]


def decompose(gram: dict[tuple[int, int], int], d: int, top: int) -> Model:
    """The model of the exact sums of products of (1, x)."""
    n, sums = gram.get((0, 0), 0), [gram.get((0, j + 1), 0) for j in range(d)]
    if n < 2:
        return Model(n, sums, np.zeros((d, 0)), np.zeros(0), np.zeros(0))
    above = {(i, j): n * gram[i + 1, j + 1] - sums[i] * sums[j] for i in range(d) for j in range(i, d)}
    v = np.empty((d, d))
    for (i, j), value in above.items():
        v[i, j] = v[j, i] = value / (n * n)  # a quotient of integers is rounded once
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:top], axes[:, ::-1][:, :top]
    real = values > d * np.finfo(float).eps * max(float(values[0]), 0.0)
    trace = sum(above[i, i] for i in range(d)) / (n * n)
    return Model(n, sums, np.ascontiguousarray(axes[:, real]), values[real], values[real] / trace)


def learn(embeddings: DataFrame, scratch: Scratch, top: int = TOP) -> tuple[Model, float]:
    """The model of the distinct vectors, and how far the covariance of their whitened form is from the identity."""
    src = embeddings.select(F.col("embedding").cast("array<double>").alias("v"))
    usable = F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    d = src.agg(F.max(F.when(usable, F.size("v")))).first()[0] or 0

    def whole(batches):
        import pyarrow as pa

        for b in batches:
            _, x = vectors(b.column("v"), d)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * d, pa.int32()), pa.array(x.ravel()))], ["x"])

    def matrix(column) -> np.ndarray:
        import pyarrow.compute as pc

        return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(len(column), d)

    def products(batches):
        import pyarrow as pa

        gram = Gram(d + 1)
        for b in batches:
            gram.add(np.insert(matrix(b.column("x")), 0, 1, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*gram.digits()), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["i", "j", "place", "digit"])

    fit = scratch.put(src.mapInArrow(whole, "x array<long>").distinct(), "fit")
    summed = fit.mapInArrow(products, "i int, j int, place int, digit long").groupBy("i", "j", "place").agg(F.sum(F.col("digit").cast("decimal(38,0)")).alias("digit"))
    gram: dict[tuple[int, int], int] = {}
    for i, j, place, digit in summed.collect():
        gram[i, j] = gram.get((i, j), 0) + (int(digit) << (DIGIT * place))
    model = decompose(gram, d, top)
    shared, k = embeddings.sparkSession.sparkContext.broadcast(model), len(model.values)

    def spread(batches):
        import pyarrow as pa

        total = np.zeros((k + 1, k + 1))
        for b in batches:
            w = np.insert(shared.value.project(shared.value.deviations(matrix(b.column("x")))), 0, 1.0, axis=1)
            total += w.T @ w
        i, j = (z.ravel() for z in np.indices(total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    error = 0.0
    if k:
        got = np.zeros((k + 1, k + 1))
        for i, j, v in fit.mapInArrow(spread, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
            got[i, j] = v
        # the mean is 0 but for rounding
        mean = got[0, 1:] / model.n
        error = float(np.abs(got[1:, 1:] / model.n - np.outer(mean, mean) - np.eye(k)).max())
    scratch.drop("fit")
    return model, error


def whiten(embeddings: DataFrame, model: Model) -> DataFrame:
    """vec_id, whitened (an array, one entry for each component) and deviation of every row that remains."""
    shared, d = embeddings.sparkSession.sparkContext.broadcast(model), len(model.sums)
    src = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for b in batches:
            keep, x = vectors(b.column("v"), d)
            y = m.deviations(x)
            w = m.project(y)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id").filter(pa.array(keep)), lists, pa.array(squares(y), pa.int64())], ["vec_id", "whitened", "deviation"])

    return src.mapInArrow(run, f"vec_id {src.schema['vec_id'].dataType.simpleString()}, whitened array<double>, deviation long")


def report(embeddings: DataFrame, top: int = TOP) -> DataFrame:
    """A row for each remaining row and component."""
    model, error = learn(embeddings, Scratch(embeddings.sparkSession, "whitening"), top)
    shares = F.array(*map(F.lit, model.explained.tolist())).cast("array<double>")
    rows = whiten(embeddings, model).select("vec_id", "deviation", F.posexplode("whitened").alias("component", "whitened"))
    return rows.select(
        "vec_id", (F.col("component") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("component")).alias("explained"), F.lit(error).alias("identity_error"),
    )
