"""Sum-of-squares packing of tokenised documents into sequences.

A document is its ids by a public tokenizer and a final END id; only documents longer
than the capacity are cut, into full pieces after a first piece that takes the rest.

All pieces are packed together, however the table is partitioned, in three steps:

1. Every task tokenises its documents and numbers its pieces within each length.
2. Only the number of pieces of each length reaches the driver (CAPACITY numbers). The
   plan is made from it: items go in by falling length, each to the open bin by whose
   change of gap the sum over gaps of the squared counts of open bins becomes smallest; a
   new bin is opened only where none fits, which leaves fewer bins than letting it compete.
   Beyond PLANNED pieces the counts are divided by a whole number k, the quotients are
   packed, and each of their bins is made k times; the remainders are packed in the same
   way. So the plan has PLANNED places a round and a few rounds at any size.
3. A piece's rank among all of its length (what tasks before its own have, and its number)
   is its place in the plan. Texts are never shuffled; the pieces' numbers are, once (and
   their ids, where with_ids asks for them).

Null and empty texts are the END id alone. Ties go to the smallest gap; repeated rows
are separate items. Only doc_id and text are read.

Tokenising: the file's added tokens are found in a text before all else, as the tokenizer
does unless it is told otherwise. Where the tokenizer file is a byte-level BPE whose merges are in the order of
their ids, a faster library applies the same merges; other files go to the tokenizer itself.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Scratch

CAPACITY = 1024
END = 2
#: Places in one round of the plan.
PLANNED = 1 << 16
_coders: dict[str, "Coder"] = {}


class Coder:
    """Texts to little-endian unsigned 32-bit ids, as the tokenizer gives them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.fast = self.merges(told)
        self.tokenizer = None if self.fast else self.slow(path)

    @staticmethod
    def merges(told: dict):
        """The fast coder of a plain byte-level BPE; None for other tokenizers."""
        model, before = told["model"], told.get("pre_tokenizer") or {}
        plain = (
            model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
            and not any(told.get(k) for k in ("normalizer", "truncation", "padding")) and not any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix"))
        )
        vocab, pairs = model.get("vocab", {}), model.get("merges", [])
        if not plain or any(vocab.get("".join(m if isinstance(m, list) else m.split(" "))) != 256 + i for i, m in enumerate(pairs)):
            return None
        import public_tokenizers
        import tiktoken

        # byte-level vocabularies write a byte that isn't printable as a letter from U+0100 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if i < 256 + len(pairs)}
        # added tokens that stand for themselves, wherever they are; other kinds are the tokenizer's business
        added = told.get("added_tokens") or []
        if any(a.get(k) for a in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            return None
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={a["content"]: a["id"] for a in added})

    @staticmethod
    def slow(path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.fast:
            return [np.array(self.fast.encode(t, allowed_special="all"), "<u4") for t in texts]
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, by falling length. Bins number from 0."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    counts = np.zeros(capacity + 1, np.int64)  # open bins by residual gap
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        if s == capacity:
            bins[i] = made
            made += 1
            continue
        # change of the sum of squares when a bin of gap g, at least s, becomes one of gap g - s
        after = 2 * counts[: capacity - s] + 1
        after[0] = 0  # a full bin isn't open
        change = np.where(counts[s:capacity] > 0, after - 2 * counts[s:capacity] + 1, np.iinfo(np.int64).max)
        best = int(np.argmin(change))
        if counts[best + s]:
            gap = best + s
            b = stacks[gap].pop()
            counts[gap] -= 1
        else:
            gap, b = capacity, made
            made += 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            stacks[gap - s].append(b)
            counts[gap - s] += 1
    return bins, offsets


def plan(counts: np.ndarray, capacity: int = CAPACITY, planned: int = PLANNED) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """counts: pieces by length. Places as keys (length and first rank), sequence of the first rank and offset, by key; and the number of sequences.

    A place takes the ranks from its first to the next key's; each further rank goes to the next sequence.
    """
    left = counts.astype(np.int64).copy()
    taken = np.zeros_like(left)
    keys, firsts, offsets, made = [], [], [], 0
    while left.any():
        copies = max(1, int(left.sum()) // max(planned, len(left)))
        now = left // copies
        lengths = np.repeat(np.arange(len(now)), now)
        bins, at = sum_of_squares(lengths, capacity)
        # the n-th item of a length takes the n-th run of that length's ranks
        nth = np.arange(len(lengths)) - np.repeat(np.cumsum(now) - now, now)
        keys.append(lengths * RANKS + taken[lengths] + nth * copies)
        firsts.append(made + bins * copies)
        offsets.append(at)
        made += (int(bins.max()) + 1) * copies
        taken += now * copies
        left -= now * copies
    if not keys:
        return (np.zeros(0, np.int64),) * 3 + (0,)
    keys, firsts, offsets = (np.concatenate(x) for x in (keys, firsts, offsets))
    order = np.argsort(keys, kind="stable")
    return keys[order], firsts[order], offsets[order], made


#: Ranks that a length may have.
RANKS = 1 << 48


def cut(docs: DataFrame, path: str, capacity: int, with_ids: bool, batch: int) -> DataFrame:
    """A row per piece, with the task that made it and its number among the task's pieces of its length."""
    src = docs.select("doc_id", "text")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * with_ids
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, nth long" + (", ids binary" if with_ids else "")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        code, part = coder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            for k in range(0, b.num_rows, batch):
                some = b.slice(k, batch)
                docs_at, pieces, starts, lengths, sums, ids_of = [], [], [], [], [], []
                for j, ids in enumerate(code.encode([t or "" for t in some.column("text").to_pylist()])):
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    size, at, piece = (len(ids) - 1) % capacity + 1, 0, 0
                    while at < len(ids):
                        chunk = ids[at : at + size]
                        docs_at.append(j)
                        pieces.append(piece)
                        starts.append(at)
                        lengths.append(size)
                        sums.append(zlib.crc32(chunk))
                        if with_ids:
                            ids_of.append(chunk.tobytes())
                        at, size, piece = at + size, capacity, piece + 1
                size = np.array(lengths, np.int64)
                order = np.argsort(size, kind="stable")
                first = np.searchsorted(size[order], size[order])
                nth = np.empty(len(size), np.int64)
                nth[order] = np.arange(len(size)) - first + seen[size[order]]
                seen += np.bincount(size, minlength=capacity + 1)
                cols = [some.column("doc_id").take(pa.array(docs_at, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(size), pa.array(sums, pa.int64()), pa.array(np.full(len(size), part, np.int32)), pa.array(nth)]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(ids_of, pa.binary())] * with_ids, names)

    return src.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, batch: int = 256, planned: int = PLANNED) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with with_ids its ids (little-endian, 32 bits)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.put(cut(docs, path, capacity, with_ids, batch), "pieces")
    counts = scratch.put(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    total = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        total[r["length"]] = r["n"]
    # a row per task is all that a length's window holds
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    shared = spark.sparkContext.broadcast(plan(total, capacity, planned)[:3])
    ranked = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    names, more = ["doc_id", "piece", "start", "length", "ids_crc32"], ["ids"] * with_ids
    src = ranked.select(*names, "rank", *more)
    kinds = {f.name: f.dataType.simpleString() for f in src.schema}

    def place(batches):
        import pyarrow as pa

        keys, firsts, offsets = shared.value
        for b in batches:
            rank = b.column("length").to_numpy() * RANKS + b.column("rank").to_numpy()
            k = np.searchsorted(keys, rank, "right") - 1
            cols = [*(b.column(c) for c in names), pa.array(firsts[k] + rank - keys[k]), pa.array(offsets[k])]
            yield pa.RecordBatch.from_arrays(cols + [b.column(c) for c in more], [*names, "sequence_id", "offset", *more])

    return src.mapInArrow(place, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", sequence_id long, offset long" + (", ids binary" if with_ids else ""))
