"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. A word's
probability is the sum over all its segmentations into pieces, by a forward algorithm;
a text's is the product over its words (runs of letters of any length, lower case, a mark
in front; digits and other number signs such as fractions are not letters). The probabilities are learned by expectation maximisation over segmentations,
from all words of a bounded sample of texts: SAMPLE texts expected of each language, TOTAL
of all languages together. The sums are kept in range by a scale that is taken out
every SCALED letters, so no word is too long.

Null texts and those without a letter give `und` and score 0; so does every text when
nothing could be learned. Equal texts get equal results, ties go to the first language
by name. Only text is scored; text, lang and doc_id are read for learning.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import id_remainder

#: Sampled texts of a language, and of all languages.
SAMPLE, TOTAL = 1000, 64_000
ROUNDS = 4
FLOOR = 1e-9
#: Letters after which the running sums are scaled: FLOOR to that power is a number still.
SCALED = 24
CACHE = 300_000
MARK = "▁"
WORD = re.compile(r"[^\W\d_]+")
UND = "und"


def words_of(text: str | None) -> list[str]:
    out: list[str] = []
    for w in WORD.findall(text.lower()) if text else ():
        if w.isalpha():
            out.append(w)
        else:  # the pattern's word characters include number signs
            out += "".join(c if c.isalpha() else " " for c in w).split()
    return out


def vocabulary(path: str) -> list[str]:
    """The vocabulary's pieces of letters, with or without the mark."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size())}
    return sorted(p for p in pieces if p != MARK and WORD.fullmatch(p.removeprefix(MARK)))


class Lattice:
    """Words of one length, and for each place the index of the piece that lies there (0: none). longest: letters of the longest piece."""

    def __init__(self, words: list[str], index: dict[str, int], longest: int):
        self.n, self.size, self.longest = len(words[0]), len(words), longest
        get = index.get
        self.at = {}
        for j in range(1, self.n + 1):
            for k in range(max(0, j - longest), j):
                ids = [get(w[k:j], 0) for w in words]
                if any(ids):
                    self.at[k, j] = np.array(ids, np.int32)

    def forward(self, p: np.ndarray) -> np.ndarray:
        """p: pieces x columns, row 0 zero. Logarithms of the sums over all segmentations, words x columns; an unknown letter costs FLOOR."""
        recent = {0: np.ones((self.size, p.shape[1]))}
        logs = np.zeros((self.size, p.shape[1]))
        for j in range(1, self.n + 1):
            a = recent[j - 1] * FLOOR
            for k in range(max(0, j - self.longest), j):
                if (k, j) in self.at:
                    a += recent[k] * p[self.at[k, j]]
            recent[j] = a
            recent.pop(j - self.longest, None)
            if j % SCALED == 0:
                scale = np.maximum(a, 1e-300)
                logs += np.log(scale)
                for k in recent:
                    recent[k] /= scale
        return logs + np.log(np.maximum(recent[self.n], 1e-300))

    def sums(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For one language: scaled forward and backward sums by place, and what each place's scale has taken out (logs)."""
        a, b = np.zeros((self.n + 1, self.size)), np.zeros((self.n + 1, self.size))
        out_a, out_b = np.zeros_like(a), np.zeros_like(b)
        a[0] = b[self.n] = 1
        for j in range(1, self.n + 1):
            # sums of earlier places are brought to the scale of the place before
            a[j] = a[j - 1] * FLOOR
            out_a[j] = out_a[j - 1]
            for k in range(max(0, j - self.longest), j):
                if (k, j) in self.at:
                    a[j] += a[k] * np.exp(out_a[k] - out_a[j]) * p[self.at[k, j]] if j > SCALED else a[k] * p[self.at[k, j]]
            if j % SCALED == 0:
                scale = np.maximum(a[j], 1e-300)
                a[j] /= scale
                out_a[j] += np.log(scale)
        for k in range(self.n - 1, -1, -1):
            b[k] = b[k + 1] * FLOOR
            out_b[k] = out_b[k + 1]
            for j in range(k + 1, min(self.n, k + self.longest) + 1):
                if (k, j) in self.at:
                    b[k] += p[self.at[k, j]] * b[j] * np.exp(out_b[j] - out_b[k]) if self.n - k > SCALED else p[self.at[k, j]] * b[j]
            if (self.n - k) % SCALED == 0:
                scale = np.maximum(b[k], 1e-300)
                b[k] /= scale
                out_b[k] += np.log(scale)
        return a, b, out_a, out_b

    def expected(self, p: np.ndarray, counts: np.ndarray, out: np.ndarray) -> None:
        """Adds the expected counts of the pieces, of one language."""
        a, b, out_a, out_b = self.sums(p)
        whole, out_whole = np.maximum(a[self.n], 1e-300), out_a[self.n]
        for (k, j), ids in self.at.items():
            share = a[k] * p[ids] * b[j] / whole
            if self.n >= SCALED:
                share *= np.exp(out_a[k] + out_b[j] - out_whole)
            out += np.bincount(ids, counts * share, len(out))
        out[0] = 0


def lattices(words: list[str], index: dict[str, int], longest: int) -> list[tuple[list[int], Lattice]]:
    by = defaultdict(list)
    for i, w in enumerate(words):
        by[len(w)].append(i)
    return [(rows, Lattice([words[i] for i in rows], index, longest)) for rows in by.values()]


def fit(counts: dict[str, dict[str, int]], pieces: list[str]) -> tuple[list[str], dict[str, int], np.ndarray]:
    """Languages, index of the pieces that any language uses, and their probabilities by language."""
    index = {p: i + 1 for i, p in enumerate(pieces)}
    longest = max(map(len, pieces), default=1)
    langs, columns = sorted(counts), []
    for lang in langs:
        words = sorted(counts[lang])
        n = np.array([counts[lang][w] for w in words], float)
        grid = lattices([MARK + w for w in words], index, longest)
        p = np.full(len(pieces) + 1, 1 / max(len(pieces), 1))
        p[0] = 0
        for _ in range(ROUNDS):
            out = np.zeros_like(p)
            for rows, lattice in grid:
                lattice.expected(p, n[rows], out)
            p = out / out.sum() if out.sum() else p
        columns.append(p)
    every = np.array(columns).T if columns else np.zeros((len(pieces) + 1, 0))
    used = np.flatnonzero(every.max(axis=1, initial=0) > 1e-7)
    kept = {pieces[i - 1]: k + 1 for k, i in enumerate(used.tolist())}
    table = np.vstack([np.zeros((1, len(langs))), every[used] + 1e-7])
    return langs, kept, table


class Scorer:
    """Log-probabilities by language of words, remembered for the last CACHE word types."""

    def __init__(self, langs, index, table):
        self.langs, self.index, self.table = langs, index, table
        self.longest = max(map(len, index), default=1)
        self.rows: dict[str, int] = {}
        self.logs = np.zeros((1024, len(langs)))

    def learn(self, words: set[str]) -> None:
        if len(self.rows) > CACHE:
            self.rows.clear()
        new = [w for w in words if w not in self.rows]
        if not new:
            return
        logs = np.zeros((len(new), len(self.langs)))
        for rows, lattice in lattices([MARK + w for w in new], self.index, self.longest):
            logs[rows] = lattice.forward(self.table)
        at = len(self.rows)
        while at + len(new) > len(self.logs):
            self.logs = np.vstack([self.logs, np.zeros_like(self.logs)])
        self.logs[at : at + len(new)] = logs
        self.rows.update(zip(new, range(at, at + len(new))))

    def texts(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        cut = [words_of(t) for t in texts]
        get = self.rows.get
        missing: set[str] = set()
        for ws in cut:
            if ws and None in (got := list(map(get, ws))):
                missing.update(w for w, x in zip(ws, got) if x is None)
        if len(self.rows) + len(missing) > CACHE:
            self.rows.clear()
            missing = {w for ws in cut for w in ws}
        self.learn(missing)
        langs, scores = [], []
        for ws in cut:
            if not ws or not self.langs:
                langs.append(UND)
                scores.append(0.0)
                continue
            s = self.logs[list(map(self.rows.__getitem__, ws))].sum(axis=0)
            e = np.exp(s - s.max())
            best = int(np.argmax(s))
            langs.append(self.langs[best])
            scores.append(float(e[best] / e.sum()))
        return langs, scores


def learn(docs: DataFrame, path: str | None = None, sample: int = SAMPLE, total: int = TOTAL):
    """A model from the rows of docs that have a language."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], {}, np.zeros((1, 0))
    each = min(sample, total / len(sizes))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, each / n)))])[F.col("lang")]
    picked = rows.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.lit(7)), F.lit(1_000_000)) < share * 1_000_000)

    def count(batches):
        import pyarrow as pa

        for b in batches:
            got = defaultdict(int)
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                for w in words_of(text):
                    got[lang, w] += 1
            keys = list(got)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([got[k] for k in keys], pa.int64())], ["lang", "word", "n"])

    # the word types of a bounded sample: few enough for the driver
    words = picked.select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, dict[str, int]] = {lang: {} for lang in sizes}
    for lang, w, n in zip(*(words.column(c).to_pylist() for c in ("lang", "word", "n"))):
        counts[lang][w] = n
    return fit(counts, vocabulary(path))


def predict(docs: DataFrame, model, carry: tuple[str, ...] = ("doc_id",), batch: int = 512) -> DataFrame:
    """The columns in carry, lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(*dict.fromkeys((*carry, "text")))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*carry).schema] + ["lang_pred string", "score double"])

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(*shared.value)
        for b in batches:
            langs, scores = [], []
            for k in range(0, b.num_rows, batch):
                x, y = scorer.texts(b.column("text").slice(k, batch).to_pylist())
                langs += x
                scores += y
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*carry, "lang_pred", "score"])

    return src.mapInArrow(run, schema)


def identify(docs: DataFrame, **options) -> DataFrame:
    """Learns from rows whose crc32(doc_id) mod 4 is not 2, predicts all."""
    held = id_remainder(F.col("doc_id"), 4) == 2
    model = learn(docs.filter(~held), **options)
    return predict(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
