"""Text quality by compression: one zstandard dictionary from good text, one from bad.

Every text is cut into blocks of BLOCK bytes, and each block is compressed by itself with
either dictionary, so that a long text doesn't come to be its own dictionary. What the good
one saves against the bad one, for each byte of the text (with SLACK bytes more, so that a
few bytes are no verdict), is the margin. A logistic curve, fitted to the margins of other
labelled texts, makes a score of it.

The dictionaries come from BLOCKS blocks of each class at most (expected), 4 MB a class at the
defaults, of SAMPLE documents of each class expected; the curve from as many documents
again, which come back from Spark as counts of rounded margins. So what the driver holds
grows with neither the tables nor the length of texts. Scores cover all blocks of all texts.

Null and empty texts have a margin of 0. Rows with a null label teach nothing; a document
with several labels counts for each, repeated labels once. With one class alone all scores are
near its label, with none 0.5. Equal texts get equal scores; there are no ties to break. Classes
too small for the library's training serve as they are, as raw dictionaries; empty ones
as none. Only doc_id and text (and quality) are read, whatever other columns there are. An
empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, id_remainder

BLOCK, SLACK = 1024, 64
SAMPLE, SPARE, BLOCKS = 4000, 4, 4000
DICTIONARY, LEVEL = 65_536, 3
#: Margins are counted in steps of 1 / STEPS for the curve.
STEPS = 4096
THRESHOLD = 0.3
CERTAIN = 8.0


def blocks(raw: bytes) -> list[bytes]:
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


def dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary of the samples: trained, or their own bytes if they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def compressors(dictionaries: list[bytes]) -> list:
    import zstandard

    out = []
    for raw in dictionaries:
        made = None
        if raw:
            made = zstandard.ZstdCompressionDict(raw)
            made.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=False, write_content_size=False, write_dict_id=False))
    return out


def margin(text: str | None, bad, good) -> float:
    raw = (text or "").encode()
    saved = sum(len(bad.compress(b)) - len(good.compress(b)) for b in blocks(raw))
    return saved / (len(raw) + SLACK)


def curve(margins, labels, weights) -> tuple[float, float]:
    """Slope and intercept of the weighted log-loss's minimum, by Newton's steps, on targets a little inside of 0 and 1."""
    import numpy as np

    x, y, w = (np.asarray(v, float) for v in (margins, labels, weights))
    n1, n0 = float(w[y == 1].sum()), float(w[y == 0].sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    spread = max(float(np.sqrt(np.average((x - np.average(x, weights=w)) ** 2, weights=w))), 1e-9)
    x = np.stack([x / spread, np.ones(len(x))])
    theta, ridge = np.array([0.0, math.log((n1 + 1) / (n0 + 1))]), np.diag([1e-3, 1e-9])

    def value(t):
        z = t @ x
        return float(w @ (np.logaddexp(0, z) - target * z) + t @ ridge @ t / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(theta @ x, -500, 500)))
        slope = x @ (w * (p - target)) + ridge @ theta
        step = np.linalg.solve((x * (w * p * (1 - p))) @ x.T + ridge, slope)
        size = 1.0
        while size > 1e-6 and value(theta - size * step) > value(theta):
            size /= 2
        theta = theta - size * step
        if float(np.abs(size * step).max()) < 1e-9:
            break
    return float(theta[0]) / spread, float(theta[1])


def sampled(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """text, quality and calibrates of sampled labelled rows, written once; and the number of labels of each class."""
    rows = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).distinct()
    sizes = {r["quality"]: r["n"] for r in rows.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return docs.limit(0), sizes
    chance = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(12)), F.lit(1_000_000))
    share = F.when(F.col("quality") == 1, min(1.0, 2 * sample / sizes[1])).otherwise(min(1.0, 2 * sample / sizes[0]))
    side = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(13)), F.lit(2)) == 0
    picked = scratch.put(rows.filter(chance < share * 1_000_000).withColumn("calibrates", side), "picked")
    # as few as expected they go to the documents; the documents come to them otherwise
    few = F.broadcast(picked) if picked.count() <= 2 * SPARE * sample else picked
    return scratch.put(docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(few, "doc_id").select("text", "quality", "calibrates"), "found"), sizes


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = BLOCKS) -> tuple[list[bytes], float, float]:
    """The dictionaries of bad and good text, slope and intercept."""
    scratch = Scratch(docs.sparkSession, "compressed")
    found, sizes = sampled(docs, labels, scratch, sample)
    if len(sizes) < 2:
        scratch.drop("picked", "found")
        return [b"", b""], 0.0, 0.0 if not sizes else CERTAIN if 1 in sizes else -CERTAIN
    taught = found.filter(~F.col("calibrates"))
    n = {r["quality"]: r["n"] for r in taught.groupBy("quality").agg(F.sum(F.ceil(F.octet_length("text") / BLOCK)).alias("n")).collect()}
    shares = {k: min(1.0, most / max(v or 1, 1)) for k, v in n.items()}

    def pieces(batches):
        import pyarrow as pa
        import xxhash

        for b in batches:
            kinds, out = [], []
            for k, text in zip(b.column("quality").to_pylist(), b.column("text").to_pylist()):
                for piece in blocks(text.encode()):
                    if xxhash.xxh64_intdigest(piece) % 1_000_000 < shares[k] * 1_000_000:
                        kinds.append(k)
                        out.append(piece)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(out, pa.binary())], ["quality", "piece"])

    got = taught.select("quality", "text").mapInArrow(pieces, "quality int, piece binary")
    # repeated blocks once: the bound holds whatever is repeated how often
    got = got.distinct().orderBy("quality", "piece").toArrow()
    kinds = got.column("quality").to_pylist()
    made = [dictionary([p for k, p in zip(kinds, got.column("piece").to_pylist()) if k == kind]) for kind in (0, 1)]
    shared = docs.sparkSession.sparkContext.broadcast(made)

    def margins(batches):
        import pyarrow as pa

        tools = compressors(shared.value)
        for b in batches:
            xs = [round(margin(t, *tools) * STEPS) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("quality"), pa.array(xs, pa.int32())], ["quality", "x"])

    seen = found.filter("calibrates").select("quality", "text").mapInArrow(margins, "quality int, x int").groupBy("quality", "x").count().orderBy("quality", "x").toArrow()
    y, x, often = (seen.column(k).to_numpy().astype(float) for k in ("quality", "x", "count"))
    scratch.drop("picked", "found")
    if len(set(y)) < 2:
        return made, 0.0, math.log(sizes[1] / sizes[0])
    # both classes weigh as in the population
    weights = often.copy()
    for k in (0, 1):
        weights[y == k] *= often.sum() * sizes[k] / (sizes[0] + sizes[1]) / often[y == k].sum()
    return made, *curve(x / STEPS, y, weights)


def predict(docs: DataFrame, model: tuple[list[bytes], float, float]) -> DataFrame:
    """doc_id, margin and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select("doc_id", "text")

    def run(batches):
        import pyarrow as pa

        made, a, c = shared.value
        tools = compressors(made)
        for b in batches:
            xs = [margin(t, *tools) for t in b.column("text").to_pylist()]
            scores = [1 / (1 + math.exp(-min(max(a * x + c, -500.0), 500.0))) for x in xs]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(xs, pa.float64()), pa.array(scores, pa.float64())], ["doc_id", "margin", "score"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, margin double, score double")


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Learns from labelled rows whose crc32(doc_id) mod 5 is not 0, scores all."""
    held = id_remainder(F.col("doc_id"), 5) == 0
    model = learn(docs, labels.filter(id_remainder(F.col("doc_id"), 5) != 0), **options)
    return predict(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "margin")
