"""Edit distance of long sequences, bit-parallel, on Arrow batches.

A column of the distance table is kept as its differences from row to row, one bit each, so a
step of the text moves 64 rows of the table at a time. Pairs of a batch whose patterns need
the same number of 64-bit words go together, one numpy operation for all of them, where they
are enough to pay for it; others go alone, the pattern's rows as one large integer of Python.
What two sequences have in common at their ends is left out first. No cap on lengths; a pair
costs words * letters of the text.

Texts count by code point, lists of words by word.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: So many pairs for each word of their patterns pay for going together; a group's masks of letters take at most so many words of memory.
PAYS, MASKS = 30, 1 << 22
WORD = 64


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without what they share at their beginnings and at their ends, the shorter first."""
    if len(a) > len(b):
        a, b = b, a
    apart = np.flatnonzero(a != b[: len(a)])
    at = int(apart[0]) if len(apart) else len(a)
    a, b = a[at:], b[at:]
    apart = np.flatnonzero(a[::-1] != b[len(b) - len(a) :][::-1])
    end = int(apart[0]) if len(apart) else len(a)
    return a[: len(a) - end], b[: len(b) - end]


def alone(a: np.ndarray, b: np.ndarray) -> int:
    """The distance of one pair, the pattern's rows in one integer."""
    masks: dict[int, int] = {}
    for i, c in enumerate(a.tolist()):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for c in b.tolist():
        same = masks.get(c, 0)
        level = (((same & up) + up) ^ up) | same | down
        higher, lower = down | (~(level | up) & full), up & level
        score += bool(higher & top) - bool(lower & top)
        higher, lower = (higher << 1 | 1) & full, (lower << 1) & full
        up, down = lower | (~(level | higher) & full), higher & level
    return score


def together(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Distances of pairs whose patterns take the same number of words; no pattern is empty."""
    n = len(pairs)
    sizes, lengths = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
    words = -(-int(sizes.max()) // WORD)
    letters, codes = np.unique(np.concatenate([p[0] for p in pairs]), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    rows = np.repeat(np.arange(n), sizes)
    place = np.arange(len(rows)) - starts[rows]
    masks = np.zeros((words, len(letters) + 1, n), np.uint64)
    np.bitwise_or.at(masks, (place // WORD, codes, rows), np.uint64(1) << (place % WORD).astype(np.uint64))
    # texts by falling length: at each step those that still have a letter come first
    order = np.argsort(-lengths, kind="stable")
    masks, sizes, lengths = masks[:, :, order], sizes[order], lengths[order]
    text = np.full((int(lengths.max()), n), len(letters), np.intp)
    for k, i in enumerate(order):
        b = pairs[i][1]
        at = np.minimum(np.searchsorted(letters, b), len(letters) - 1)
        text[: len(b), k] = np.where(letters[at] == b, at, len(letters))
    left = np.searchsorted(-lengths, -np.arange(len(text)))  # texts longer than the step
    one, high = np.uint64(1), np.uint64(WORD - 1)
    up, down = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), np.uint64)
    last, bit = (sizes - 1) // WORD, ((sizes - 1) % WORD).astype(np.uint64)
    score, column = sizes.astype(np.int64), np.arange(n)
    for step, m in enumerate(left.tolist()):
        codes = text[step, :m]
        rise, fall = np.ones(m, np.uint64), np.zeros(m, np.uint64)  # the row above the first one grows by one a step
        for w in range(words):
            same, u, d = masks[w, codes, column[:m]], up[w, :m], down[w, :m]
            across = same | d
            same = same | fall
            level = (((same & u) + u) ^ u) | same
            higher, lower = d | ~(level | u), u & level
            here = last[:m] == w
            score[:m] += np.where(here, ((higher >> bit[:m]) & one).astype(np.int64) - ((lower >> bit[:m]) & one).astype(np.int64), 0)
            out, back = higher >> high, lower >> high
            higher, lower = higher << one | rise, lower << one | fall
            up[w, :m], down[w, :m] = lower | ~(across | higher), higher & across
            rise, fall = out, back
    out = np.empty(n, np.int64)
    out[order] = score
    return out


def distances(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Distances of pairs of arrays of whole numbers."""
    out = np.zeros(len(pairs), np.int64)
    groups: dict[int, list[int]] = {}
    cut = [trimmed(a, b) for a, b in pairs]
    for i, (a, b) in enumerate(cut):
        if not len(a):
            out[i] = len(b)
        else:
            groups.setdefault(-(-len(a) // WORD), []).append(i)
    for words, members in groups.items():
        members.sort(key=lambda i: len(cut[i][1]))
        if len(members) < PAYS * words:
            for i in members:
                out[i] = alone(*cut[i])
            continue
        at = 0
        while at < len(members):
            # letters of a group are at most what its patterns have
            size, letters = 0, 0
            while at + size < len(members):
                letters += min(len(cut[members[at + size]][0]), 256)
                if size and words * min(letters, 1 << 12) * (size + 1) > MASKS:
                    break
                size += 1
            some = members[at : at + size]
            out[some] = together([cut[i] for i in some])
            at += size
    return out


def of_texts(left, right) -> list[int | None]:
    kept = [i for i, (a, b) in enumerate(zip(left, right)) if a is not None and b is not None]
    out: list[int | None] = [None] * len(left)
    for i, d in zip(kept, distances([(code_points(left[i]), code_points(right[i])) for i in kept]).tolist()):
        out[i] = d
    return out


def of_lists(left, right) -> list[int | None]:
    kept = [i for i, (a, b) in enumerate(zip(left, right)) if a is not None and b is not None]
    out: list[int | None] = [None] * len(left)
    numbers: dict = {}
    coded = [tuple(np.array([numbers.setdefault(w, len(numbers)) for w in x[i]], np.int64) for x in (left, right)) for i in kept]
    for i, d in zip(kept, distances(coded).tolist()):
        out[i] = d
    return out


def _udf(run):
    def told(a, b):
        import pyarrow as pa

        return pa.array(run(a.to_pylist(), b.to_pylist()), pa.int64())

    # the kinds of the arguments are read from these
    import pyarrow as pa

    told.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    return F.arrow_udf(told, "long")


def edit_distance(a: Column, b: Column) -> Column:
    """Code points to insert, delete or replace; null if either is null."""
    return _udf(of_texts)(a, b)


def word_distance(a: Column, b: Column) -> Column:
    """The same for arrays of strings, by element; a null element is a word of its own."""
    return _udf(of_lists)(a, b)


def register(spark: SparkSession) -> None:
    """edit_distance and word_distance for SQL texts of this session."""
    spark.udf.register("edit_distance", _udf(of_texts))
    spark.udf.register("word_distance", _udf(of_lists))
