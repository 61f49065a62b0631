"""Toxicity by a counterfactual-regularised classifier.

A logistic model on the presence of words and word beginnings. Every sentence of a labelled
text that names a group gets twins, in which each identity term is exchanged for the others
of its kind and language in turn; the squared differences of the sentence's and the twins'
scores are a penalty of the fit, so that naming a group moves no score. The model learns
from a bounded sample of labelled rows (SAMPLE of each class expected, 2 * SPARE * SAMPLE
texts of repeated ids at most expected). Every feature that LEAST sampled texts have counts,
on a scale of how well it tells the classes apart.

Null and empty texts have no features and get the score of the bare intercept. Rows
with a null label teach nothing; a document with several labels counts each, repeated
labels once. With one class or none the model is a constant. Equal texts, however long, get
equal scores; there are no ties to break. Only doc_id and text (and toxic) are read.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, id_remainder

SAMPLE, SPARE = 4000, 4
LEAST = 3
STEMS = (4, 5, 6)
STEP = 0.15
CACHE = 300_000
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")
#: Identity terms that may stand for each other: one kind and one language.
GROUPS = tuple(
    x.split()
    for x in (
        "women men", "woman man", "girls boys", "girl boy", "mothers fathers", "mother father", "female male", "she he", "her his", "hers him", "trans cis", "transgender cisgender nonbinary",
        "christians muslims jews hindus buddhists atheists sikhs catholics protestants", "christian muslim jewish hindu buddhist atheist sikh catholic protestant", "christianity islam judaism hinduism buddhism atheism",
        "gays lesbians bisexuals heterosexuals", "gay lesbian bisexual queer straight homosexual heterosexual", "blacks whites asians latinos arabs", "black white asian latino arab hispanic indigenous",
        "africans europeans americans indians mexicans chinese", "african european american indian mexican turkish polish", "immigrants refugees migrants natives foreigners locals", "immigrant refugee migrant native foreigner local",
        "disabled deaf blind autistic", "old young elderly", "rich poor", "liberals conservatives", "liberal conservative",
        "frauen männer", "frau mann", "mädchen jungen", "mütter väter", "weiblich männlich", "christen muslime juden hindus buddhisten atheisten", "christ muslim jude hindu buddhist atheist", "christliche muslimische jüdische hinduistische",
        "schwule lesben bisexuelle", "schwul lesbisch bisexuell heterosexuell", "schwarze weiße asiaten araber", "ausländer flüchtlinge einwanderer einheimische", "behinderte gehörlose blinde", "alte junge", "türken polen deutsche franzosen",
        "femmes hommes", "femme homme", "filles garçons", "fille garçon", "mères pères", "féminine masculine", "chrétiens musulmans juifs hindous bouddhistes athées", "chrétien musulman juif hindou bouddhiste athée", "chrétienne musulmane juive hindoue",
        "homosexuels lesbiennes bisexuels", "homosexuel lesbienne bisexuel hétérosexuel", "noirs blancs asiatiques arabes", "noir blanc asiatique arabe", "immigrés réfugiés étrangers migrants", "immigré réfugié étranger migrant", "handicapés sourds aveugles", "vieux jeunes",
        "mujeres hombres", "mujer hombre", "niñas niños", "niña niño", "madres padres", "femenina masculina", "cristianos musulmanes judíos hindúes budistas ateos", "cristiano musulmán judío hindú budista ateo", "cristiana musulmana judía",
        "homosexuales lesbianas bisexuales", "homosexual lesbiana bisexual heterosexual", "negros blancos asiáticos árabes", "negro blanco asiático árabe", "inmigrantes refugiados extranjeros migrantes", "inmigrante refugiado extranjero migrante", "discapacitados sordos ciegos", "viejos jóvenes",
    )
)
#: A term of several kinds or languages stands for the first of them.
PLACE: dict[str, tuple[list[str], int]] = {}
for _group in GROUPS:
    for _i, _word in enumerate(_group):
        PLACE.setdefault(_word, (_group, _i))
TURNS = max(map(len, GROUPS))


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in STEMS if len(word) >= k)]


def twins(words: set[str]) -> list[set[str]]:
    """The words of a sentence with every identity term exchanged, one set for each turn that changes them."""
    named = words.intersection(PLACE)
    out = []
    for turn in range(1, TURNS) if named else ():
        other = {PLACE[w][0][(PLACE[w][1] + turn) % len(PLACE[w][0])] for w in named}
        if other != named and other not in out:
            out.append(other)
    return [words - named | other for other in out]


class Rows:
    """Sparse rows, from lists or an Arrow column of lists: for each entry its row, column and value."""

    def __init__(self, lists, signed: bool = False):
        if isinstance(lists, list):
            sizes, flat = np.array([len(x) for x in lists], np.int64), np.array([i for x in lists for i in x], np.int64)
        else:
            import pyarrow.compute as pc

            sizes, flat = pc.list_value_length(lists).to_numpy().astype(np.int64), pc.list_flatten(lists).to_numpy().astype(np.int64)
        self.n = len(sizes)
        self.row = np.repeat(np.arange(self.n), sizes)
        self.value = np.sign(flat).astype(float) if signed else np.ones(len(flat))
        self.column = np.abs(flat) - 1 if signed else flat

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column] * self.value, self.n)

    def back(self, e: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.column, e[self.row] * self.value, n)


def loss(w: np.ndarray, b: float, x: Rows, y: np.ndarray, weight: np.ndarray, d: Rows, often: np.ndarray, scale: np.ndarray, l2: float, swap: float) -> tuple[float, np.ndarray]:
    """Log-loss, swap times the mean square of the twins' score differences, l2 / 2 times the squared weights; and the gradient by w and b."""
    z = np.clip(x.times(w * scale) + b, -30, 30)
    p = 1 / (1 + np.exp(-z))
    value = -float(weight @ (y * np.log(p) + (1 - y) * np.log1p(-p))) + l2 / 2 * float(w @ w)
    e = weight * (p - y)
    g = x.back(e, len(w)) * scale + l2 * w
    if d.n:
        apart, share = d.times(w * scale), often / often.sum()
        value += swap * float(share @ apart**2)
        g += swap * 2 * d.back(share * apart, len(w)) * scale
    return value, np.append(g, e.sum())


def fit(rows, y, often, diffs, diffs_often, scale: np.ndarray, prior: float, l2: float = 1e-4, swap: float = 1.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """Weights and intercept for population share prior of label 1. rows: features on; diffs: signed features (from 1) of a sentence less its twin's."""
    n = len(scale)
    y = np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        return np.zeros(n), 8.0 if len(y) and y[0] else -8.0
    x, d = Rows(rows), Rows(diffs, signed=True)
    # both classes weigh as in the population
    often = np.asarray(often, float)
    ones = float(often[y == 1].sum()) / float(often.sum())
    weight = often * np.where(y == 1, prior / ones, (1 - prior) / (1 - ones))
    weight /= weight.sum()
    w, b = np.zeros(n), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        _, g = loss(w, b, x, y, weight, d, np.asarray(diffs_often, float), scale, l2, swap)
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        move = STEP * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:n], b - float(move[n])
    return w * scale, b


def sampled(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """text and toxic of the sampled labelled rows (written, so that they are read once), and the labels by class."""
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).distinct()
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return docs.limit(0), sizes

    def chance(share, *by):
        return F.pmod(F.xxhash64(*by, F.lit(7)), F.lit(1_000_000)) < share * 1_000_000

    share = F.when(F.col("toxic") == 1, min(1.0, sample / sizes[1])).otherwise(min(1.0, sample / sizes[0]))
    picked = scratch.put(rows.filter(chance(share, F.col("doc_id").cast("string"))), "picked")
    # few by sample: they go to the documents if they are as few as expected
    few = F.broadcast(picked) if picked.count() <= 2 * SPARE * sample else picked
    found = scratch.put(docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(few, "doc_id").select("text", "toxic"), "found")
    n = found.count()
    return found.filter(chance(min(1.0, 2 * SPARE * sample / max(n, 1)), F.col("text"))), sizes


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, swap: float = 1.0):
    """Index of the features, weights, intercept."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    picked, sizes = sampled(docs, labels, scratch, sample)
    if len(sizes) < 2:
        scratch.drop("picked", "found")
        return {}, np.zeros(0), 8.0 if 1 in sizes else -8.0

    def presence(batches):
        import pyarrow as pa

        for b in batches:
            got: dict[str, list[int]] = {}
            for y, text in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist()):
                for f in {f for w in words_of(text) for f in features(w)}:
                    got.setdefault(f, [0, 0])[int(y)] += 1
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.string()), *(pa.array([x[k] for x in got.values()], pa.int64()) for k in (0, 1))], ["f", "n0", "n1"])

    seen = picked.select("toxic", "text").mapInArrow(presence, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    seen = seen.filter(F.col("n0") + F.col("n1") >= LEAST).orderBy("f").toArrow()
    index = {f: i for i, f in enumerate(seen.column("f").to_pylist())}
    took = {k: max(1, min(n, sample)) for k, n in sizes.items()}
    c, a = seen.column("n0").to_numpy() / took[0], seen.column("n1").to_numpy() / took[1]
    apart = np.abs(a - c) / np.sqrt((a + c) / 2 + 1 / min(took.values()))
    scale = apart / max(float(apart.max(initial=0)), 1e-9)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def of(words, index):
        return {index[f] for w in words for f in features(w) if f in index}

    def vectors(batches):
        import pyarrow as pa

        index = shared.value
        for b in batches:
            xs = [sorted(of(words_of(t), index)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(xs, pa.list_(pa.int32()))], ["toxic", "x"])

    def differences(batches):
        import pyarrow as pa

        index = shared.value
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                for s in SENTENCE.findall(text):
                    words = words_of(s)
                    for other in twins(words):
                        x, t = of(words, index), of(other, index)
                        out.append([*(i + 1 for i in sorted(x - t)), *(-i - 1 for i in sorted(t - x))])
            yield pa.RecordBatch.from_arrays([pa.array([d for d in out if d], pa.list_(pa.int32()))], ["x"])

    got = picked.select("toxic", "text").mapInArrow(vectors, "toxic int, x array<int>").groupBy("toxic", "x").count().orderBy("toxic", "x").toArrow()
    apart = picked.select("text").mapInArrow(differences, "x array<int>").groupBy("x").count().orderBy("x").toArrow()
    y, often = (got.column(k).to_numpy() for k in ("toxic", "count"))
    w, b = fit(got.column("x"), y, often, apart.column("x"), apart.column("count").to_numpy(), scale, sizes[1] / (sizes[0] + sizes[1]), swap=swap)
    scratch.drop("picked", "found")
    return index, w, b


def predict(docs: DataFrame, model) -> DataFrame:
    """doc_id and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select("doc_id", "text")
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, score double"

    def run(batches):
        import pyarrow as pa

        index, w, bias = shared.value
        known: dict[str, tuple[int, ...]] = {}
        for b in batches:
            scores = []
            for text in b.column("text").to_pylist():
                on: set[int] = set()
                for word in words_of(text):
                    ids = known.get(word)
                    if ids is None:
                        if len(known) > CACHE:
                            known.clear()
                        ids = known[word] = tuple(index[f] for f in features(word) if f in index)
                    if ids:
                        on.update(ids)
                z = bias + float(w[sorted(on)].sum()) if on else bias
                scores.append(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return src.mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Learns from labelled rows whose crc32(doc_id) mod 5 is not 0, scores all."""
    held = id_remainder(F.col("doc_id"), 5) == 0
    model = learn(docs, labels.filter(id_remainder(F.col("doc_id"), 5) != 0), **options)
    return predict(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
