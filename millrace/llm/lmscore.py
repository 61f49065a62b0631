"""Language-model scoring by masked pseudo-likelihood.

A window network predicts every token from WINDOW tokens on both sides of it; the sum
of the conditional log-probabilities scores a document. Tokens are lower-case words.
Every word that all documents have least() times or more has a number and an embedding of
its own; that count grows with the root of the tokens, and so does the vocabulary. The
softmax predicts one of VOCABULARY slots in two levels (class, then slot within the class):
the most frequent WORDS have a slot each, other words share slots by their last letters,
and a word has its share of its slot by its count. The words below least() have a share of
their slot as a whole, and are told apart by their spelling, byte after byte, with
probabilities counted over these words.

The counts cover all documents, and so does training: every partition trains a copy of
the network on all its tokens, from one common start, and the copies are averaged by their
numbers of tokens, in groups of FAN at a time, so no task gathers more than FAN copies.

Null and empty texts have no tokens, logprob 0 and no mean. Texts are scored whole, however
long. Repeated rows get equal scores; words with equal counts are numbered in byte order.
With no token at all the network stays as it began. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch
from millrace.llm.decontam import KEEP

WORDS, BUCKETS = 768, 256
VOCABULARY = WORDS + BUCKETS
CLASSES = 32
PER_CLASS = VOCABULARY // CLASSES
PAD = -1
WINDOW, WIDTH, HIDDEN = 2, 8, 16
BATCH = 8192
RATE = 0.2
FAN = 32
LEAST = 5
END = 256
SHAPES = {
    "w": (2 * WINDOW * WIDTH, HIDDEN), "b": (HIDDEN,),
    "c": (HIDDEN, CLASSES), "cb": (CLASSES,), "t": (CLASSES, HIDDEN, PER_CLASS), "tb": (CLASSES, PER_CLASS),
}


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(KEEP).split() if text else []


def slot(word: bytes) -> int:
    """The slot of a word beyond the first WORDS, by its last letters."""
    return WORDS + (word[-1] * 31 + (word[-2] if len(word) > 1 else 7) * 17 + (word[-3] if len(word) > 2 else 3)) % BUCKETS


def least(tokens: int) -> int:
    """The count from which a word has a number of its own."""
    return max(LEAST, round(tokens**0.5 / 100))


class Numbers(dict):
    """Word to number: its rank for the first WORDS, from VOCABULARY on for the others of the table; words outside the table get their slot's number."""

    def __init__(self, top: list[bytes]):
        super().__init__((w, i if i < WORDS else i + BUCKETS) for i, w in enumerate(top))
        self.most = len(self) + 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.most:
            for w in [w for w, i in self.items() if WORDS <= i < VOCABULARY]:
                del self[w]
        k = self[word] = slot(word)
        return k


class Shares:
    """Slot and log-share of the slot by number, and the spelling of words outside the table."""

    def __init__(self, top: list[bytes], counts: np.ndarray, rare: np.ndarray, pairs: np.ndarray):
        n = np.concatenate((counts[:WORDS], np.zeros(max(WORDS - len(top), 0)), rare + 1.0, counts[WORDS:]))
        self.slots = np.concatenate((np.arange(VOCABULARY), np.array([slot(w) for w in top[WORDS:]], np.int64)))
        mass = np.bincount(self.slots, n, VOCABULARY)
        self.logs = np.log(np.maximum(n, 1e-9) / np.maximum(mass, 1e-9)[self.slots]).astype(np.float32)
        self.logs[:WORDS] = 0  # a slot each
        self.pairs = np.log((pairs + 1.0) / (pairs + 1.0).sum(axis=1, keepdims=True)).tolist()

    def spelling(self, word: bytes) -> float:
        """Log-probability of the word's bytes and its end."""
        total, before = 0.0, END
        for c in word:
            total += self.pairs[before][c]
            before = c
        return total + self.pairs[before][END]


class Network:
    """A row of e for each number and one for padding; the other parameters lie in flat."""

    def __init__(self, flat: np.ndarray | None = None, e: np.ndarray | None = None, slots: np.ndarray | None = None, seed: int = 1):
        rng = np.random.default_rng(seed)
        if flat is None:
            flat = np.concatenate([(rng.standard_normal(s) * (0.0 if len(s) == 1 or k == "tb" else s[-2] ** -0.5)).ravel() for k, s in SHAPES.items()])
        self.slots = np.arange(VOCABULARY) if slots is None else slots
        self.e = (rng.standard_normal((len(self.slots) + 1, WIDTH)) * 0.3 if e is None else e).astype(np.float32)
        self.flat = flat.astype(np.float32)
        self.p, at = {}, 0
        for k, s in SHAPES.items():
            n = int(np.prod(s))
            self.p[k] = self.flat[at : at + n].reshape(s)
            at += n

    def run(self, ids: np.ndarray, at: np.ndarray, rate: float = 0.0, memory: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Log-probabilities of the slots of the tokens at the places; with a rate, one Adagrad step as well (memory: of flat, of e)."""
        p = self.p
        # neighbours in rank share no class, so that the classes are about equally likely
        slots = self.slots[ids[at]]
        cls = slots % CLASSES
        order = np.argsort(cls.astype(np.uint8), kind="stable")
        at, cls = at[order], cls[order]
        within = slots[order] // CLASSES
        cut = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
        around = ids[at[:, None] + np.array([k for k in range(-WINDOW, WINDOW + 1) if k])]
        x = self.e[around].reshape(len(at), -1)
        h = x @ p["w"]
        h += p["b"]
        np.tanh(h, out=h)
        row = np.arange(len(at))
        z = h @ p["c"]
        z += p["cb"]
        np.exp(z, out=z)  # tanh bounds what goes in
        norm = z.sum(axis=1)
        y = np.empty((len(at), PER_CLASS), np.float32)
        for k in range(CLASSES):
            i, j = cut[k], cut[k + 1]
            if i < j:
                np.matmul(h[i:j], p["t"][k], out=y[i:j])
                y[i:j] += p["tb"][k]
        np.exp(y, out=y)
        norm_y = y.sum(axis=1)
        out = np.empty(len(at), np.float32)
        out[order] = np.log(z[row, cls] / norm * (y[row, within] / norm_y) + 1e-30)
        if rate:
            n = np.float32(len(at))
            grads = {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
            z /= (norm * n)[:, None]
            z[row, cls] -= 1 / n
            y /= (norm_y * n)[:, None]
            y[row, within] -= 1 / n
            grads["c"], grads["cb"] = h.T @ z, z.sum(axis=0)
            dh = z @ p["c"].T
            for k in range(CLASSES):
                i, j = cut[k], cut[k + 1]
                if i < j:
                    grads["t"][k], grads["tb"][k] = h[i:j].T @ y[i:j], y[i:j].sum(axis=0)
                    dh[i:j] += y[i:j] @ p["t"][k].T
            dh *= 1 - h * h
            grads["w"], grads["b"] = x.T @ dh, dh.sum(axis=0)
            dx = (dh @ p["w"].T).reshape(-1, WIDTH)
            flat_ids = around.ravel()
            by = np.argsort(flat_ids, kind="stable")
            first = np.flatnonzero(np.diff(flat_ids[by], prepend=PAD - 1))
            rows, ge = flat_ids[by[first]], np.add.reduceat(dx[by], first, axis=0)
            memory[1][rows] += ge * ge
            self.e[rows] -= rate * ge / (np.sqrt(memory[1][rows]) + 1e-6)
            g = np.concatenate([grads[k].ravel() for k in SHAPES])
            memory[0][:] += g * g
            self.flat -= rate * g / (np.sqrt(memory[0]) + 1e-6)
        return out


def places(texts: list[str | None], numbers: Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Numbers of all tokens with padding around each document, the places of the tokens, the documents' token counts, and the tokens."""
    gap = [PAD] * WINDOW
    ids, counts, every_word = list(gap), [], []
    get = numbers.__getitem__
    for t in texts:
        words = words_of(t)
        counts.append(len(words))
        every_word += words
        ids.extend(map(get, words))
        ids.extend(gap)
    every = np.array(ids, np.int64)
    return every, np.flatnonzero(every != PAD), np.array(counts, np.int64), every_word


def frequent(docs: DataFrame, scratch: Scratch) -> tuple[list[bytes], Shares]:
    """The words that have a number, most frequent first (ties in byte order), and the shares of all words."""

    def count(batches):
        import pyarrow as pa
        from collections import Counter

        def rows(got):
            return pa.RecordBatch.from_arrays([pa.array(got.keys(), pa.binary()), pa.array(got.values(), pa.int64())], ["word", "n"])

        got: Counter = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                got.update(words_of(t))
                if len(got) > 200_000:
                    yield rows(got)
                    got.clear()
        if got:
            yield rows(got)

    def spelled(batches):
        """What words outside the table add to their slots (keys below BUCKETS) and to pairs of bytes."""
        import pyarrow as pa

        sums = np.zeros(BUCKETS + (END + 1) ** 2, np.int64)
        for b in batches:
            for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
                sums[slot(w) - WORDS] += n
                before = END
                for c in (*w, END):
                    sums[BUCKETS + before * (END + 1) + c] += n
                    before = c
        keys = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sums[keys])], ["key", "n"])

    words = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = scratch.put(words, "words")
    enough = least(words.agg(F.sum("n")).collect()[0][0] or 0)
    top = words.filter(F.col("n") >= enough).orderBy(F.desc("n"), "word").toArrow()
    rare = words.filter(F.col("n") < enough).mapInArrow(spelled, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    scratch.drop("words")
    sums = np.zeros(BUCKETS + (END + 1) ** 2)
    for r in rare:
        sums[r["key"]] = r["n"]
    top, counts = top.column("word").to_pylist(), top.column("n").to_numpy().astype(float)
    return top, Shares(top, counts, sums[:BUCKETS], sums[BUCKETS:].reshape(END + 1, END + 1))


def trained(docs: DataFrame, top: list[bytes], slots: np.ndarray, start: tuple[np.ndarray, np.ndarray], scratch: Scratch, name: str, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """The mean of the copies that the partitions train, from start: flat and e. A row of e is averaged by its uses, over the partitions that use it."""
    shared = docs.sparkSession.sparkContext.broadcast((top, slots, start))
    names = ["row", "part", "n", "raw", *(f"v{i}" for i in range(WIDTH))]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        top, slots, (flat, e) = shared.value
        numbers, net = Numbers(top), Network(flat.copy(), e.copy(), slots)
        memory = np.full(len(net.flat), 1e-6, np.float32), np.full(net.e.shape, 1e-6, np.float32)
        uses = np.zeros(len(net.e), np.int64)
        done = 0
        for b in batches:
            for k in range(0, b.num_rows, 256):
                ids, at, _, _ = places(b.column("text").slice(k, 256).to_pylist(), numbers)
                # every batch takes places of the whole slice
                at = at[np.random.default_rng(done).permutation(len(at))]
                for i in range(0, len(at), BATCH):
                    net.run(ids, at[i : i + BATCH], rate, memory)
                # padding counts as well
                np.add.at(uses, ids, 1)
                done += len(at)
        if done:
            part = TaskContext.get().partitionId()
            none = [pa.nulls(1, pa.float64())] * WIDTH
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([part], pa.int64()), pa.array([float(done)]), pa.array([(net.flat * np.float64(done)).astype("<f8").tobytes()], pa.binary()), *none], names)
            used = np.flatnonzero(uses)
            for i in range(0, len(used), 10_000):
                rows = used[i : i + 10_000]
                sums = net.e[rows] * uses[rows, None].astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.full(len(rows), part, np.int64)), pa.array(uses[rows].astype(float)), pa.nulls(len(rows), pa.binary()), *(pa.array(sums[:, c].copy()) for c in range(WIDTH))], names)

    def total(rows):
        import pyarrow as pa

        raw = sum(np.frombuffer(x, "<f8") for x in rows.column("raw").to_pylist())
        return pa.table([pa.array([rows.column("part")[0].as_py() // FAN], pa.int64()), pa.array([sum(rows.column("n").to_pylist())]), pa.array([raw.tobytes()], pa.binary())], ["part", "n", "raw"])

    kind = "part long, n double, raw binary"
    made = scratch.put(docs.select("text").mapInArrow(run, f"row long, {kind}, " + ", ".join(f"v{i} double" for i in range(WIDTH))), f"{name}0")
    copies = made.filter("row < 0").select("part", "n", "raw")
    level = 0
    while copies.count() > FAN:
        level += 1
        grouped = copies.groupBy((F.col("part") / FAN).cast("long").alias("__g")).applyInArrow(total, kind)
        copies = scratch.put(grouped, f"{name}{level}")
    rows = copies.orderBy("part").collect()
    flat, e = start
    if rows:
        flat = (sum(np.frombuffer(r["raw"], "<f8") for r in rows) / sum(r["n"] for r in rows)).astype(np.float32)
        means = made.filter("row >= 0").groupBy("row").agg(*[(F.sum(f"v{i}") / F.sum("n")).cast("float").alias(f"v{i}") for i in range(WIDTH)]).toArrow()
        e = e.copy()
        e[means.column("row").to_numpy()] = np.stack([means.column(f"v{i}").to_numpy() for i in range(WIDTH)], axis=1)
    scratch.drop(*[f"{name}{i}" for i in range(level + 1)])
    return flat, e


def train(docs: DataFrame):
    scratch = Scratch(docs.sparkSession, "lmscore")
    top, shares = frequent(docs, scratch)
    net = Network(slots=shares.slots)
    return top, shares, trained(docs, top, shares.slots, (net.flat, net.e), scratch, "full", RATE)


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, n_tokens, logprob (the sum), mean_logprob."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select("doc_id", "text")

    def run(batches):
        import pyarrow as pa

        top, shares, (flat, e) = shared.value
        numbers, net = Numbers(top), Network(flat, e, shares.slots)
        for b in batches:
            sums, counts = [], []
            for k in range(0, b.num_rows, 256):
                ids, at, n, words = places(b.column("text").slice(k, 256).to_pylist(), numbers)
                logs = np.concatenate([net.run(ids, at[i : i + BATCH]) for i in range(0, len(at), BATCH)] or [np.zeros(0)]).astype(float)
                numbered = ids[at]
                logs += shares.logs[numbered]
                spelt = np.flatnonzero((numbered >= WORDS) & (numbered < VOCABULARY))
                logs[spelt] += [shares.spelling(words[i]) for i in spelt.tolist()]
                ends = np.concatenate(([0], np.cumsum(logs)))[np.concatenate(([0], np.cumsum(n)))]
                sums += np.diff(ends).tolist()
                counts += n.tolist()
            means = [s / n if n else None for s, n in zip(sums, counts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sums, pa.float64()), pa.array(means, pa.float64())], ["doc_id", "n_tokens", "logprob", "mean_logprob"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_tokens long, logprob double, mean_logprob double")


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    return score(docs, train(docs))
