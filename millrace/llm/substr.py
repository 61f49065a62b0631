"""Removal of repeated substrings by suffix order.

Every byte goes that is covered by a SPAN-byte string which also starts elsewhere, in
the same or another text. Strings are judged on the input; none crosses texts.

1. Anchors. In each string of SPAN bytes the least-hashed word of ANCHOR bytes (the first
   of equals) depends on the string alone. Successive strings with the same anchor form
   a segment; a text becomes one segment per some 75 bytes, with hashes of its anchor and
   of its bytes.
2. Only segments whose anchor is there twice can hold repeated strings. Where all
   segments of an anchor are equal, so are all their strings.
3. The other segments, one for each different content, go to shards by their anchor, so
   that equal strings meet. An anchor with more than CROWD different segments is cut
   further: the strings of a segment are split by how far before the anchor they start,
   and each half is dealt by the bytes that all strings of that half have in common;
   this goes on until a group is small or its strings are single, and then equal.
4. Each shard is sorted by external induced sorting (suffixsort), whose queues carry
   common-prefix values; neighbours that share SPAN bytes are repeats.
5. The covered stretches go back to their texts.

A text of fewer than SPAN bytes loses nothing; null is empty. Texts are matched by 96 bits of
two hashes of their id and bytes, so equal rows, ids that repeat and null ids are told apart
by content, and each of two equal rows loses what repeats. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, dealt_join
from millrace.llm.suffixsort import Store, suffixes

SPAN, ANCHOR = 200, 48
WINDOWS = SPAN - ANCHOR + 1
CROWD = 256
CHUNK = 1 << 19
#: Bytes of pieces that a shard holds about.
SHARD = 8 << 20
#: Bytes that the sort of a shard may hold; what is larger lies in files.
MEMORY = 192 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
TABLE = np.random.default_rng(42).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK + 1)
        for name, base in (("up", BASE), ("down", INVERSE)):
            with np.errstate(over="ignore"):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w successive values."""
    n = len(x) - w + 1
    rows = -(-len(x) // w)
    y = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    y[: len(x)] = x
    y = y.reshape(rows, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def segments(t: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of concatenated texts: the start, string count, distance to the anchor, anchor's and content's hash of each segment."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if len(t) < SPAN:
        return none
    up, down = powers(len(t) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(TABLE[t] * up[: len(t)], dtype=np.uint64)))
    n = len(t) - ANCHOR + 1
    anchor = mix((sums[ANCHOR:] - sums[:n]) * down[:n])
    key = (anchor & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    place = (sliding_min(key, WINDOWS) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ok = np.ones(len(place), bool)
    for e in ends[:-1].tolist():
        ok[max(0, e - SPAN + 1) : e] = False
    starts = np.flatnonzero(ok)
    if not len(starts):
        return none
    first = np.flatnonzero((np.diff(place[starts], prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
    count = np.diff(np.append(first, len(starts)))
    at = starts[first]
    p = place[at]
    stop = at + count - 1 + SPAN
    content = (sums[stop] - sums[at]) * down[at]
    content = mix(content ^ mix(count.astype(np.uint64) * np.uint64(1009) + (p - at).astype(np.uint64)))
    return at, count, p - at, anchor[p].view(np.int64), content.view(np.int64)


SEGMENT = "row long, row2 int, at long, n int, lead int, anchor long, content long"


def find_segments(docs: DataFrame) -> DataFrame:
    """docs: row, row2, raw. A row per segment."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows, rows2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("row", "row2"))
            raw = b.column("raw")
            data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
            wide = raw.type == pa.large_binary()
            offsets = np.frombuffer(raw.buffers()[1], np.int64 if wide else np.int32)[raw.offset : raw.offset + b.num_rows + 1].astype(np.int64)
            i = 0
            while i < b.num_rows:
                j = int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1
                j = min(max(j, i + 1), b.num_rows)
                base = offsets[i]
                at, n, lead, anchor, content = segments(data[base : offsets[j]], offsets[i + 1 : j + 1] - base)
                if len(at):
                    k = np.searchsorted(offsets[i + 1 : j + 1] - base, at, "right")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[i + k]), pa.array(rows2[i + k]), pa.array(at - (offsets[i + k] - base)), pa.array(n.astype(np.int32)), pa.array(lead.astype(np.int32)), pa.array(anchor), pa.array(content)],
                        ["row", "row2", "at", "n", "lead", "anchor", "content"],
                    )
                i = j

    return docs.mapInArrow(run, SEGMENT)


#: A piece of a segment: its strings start `low` to `high` bytes before the anchor's place.
PIECE = "anchor long, content long, times long, lead int, n int, raw binary, low int, high int, key binary"


def cut_texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """The bytes of the wanted segments (row, row2, at, n and what else is in PIECE), from docs (row, row2, raw)."""
    lists = wanted.groupBy("row", "row2").agg(F.collect_list(F.struct("at", "n", "lead", "anchor", "content", "times")).alias("segs"))
    # equal rows hold equal bytes: one serves
    both = docs.join(lists, ["row", "row2"]).select("row", "row2", "raw", "segs")

    def run(batches):
        import pyarrow as pa

        done = None
        for b in batches:
            out = {k: [] for k in ("anchor", "content", "times", "lead", "n", "raw", "low", "high", "key")}
            for row, row2, raw, segs in zip(*(b.column(c).to_pylist() for c in ("row", "row2", "raw", "segs"))):
                if (row, row2) == done:
                    continue
                done = row, row2
                for s in segs:
                    x = raw[s["at"] : s["at"] + s["n"] - 1 + SPAN]
                    for k in ("anchor", "content", "times", "lead", "n"):
                        out[k].append(s[k])
                    out["raw"].append(x)
                    out["low"].append(0)
                    out["high"].append(WINDOWS - 1)
                    out["key"].append(x[s["lead"] : s["lead"] + ANCHOR])
            yield pa.RecordBatch.from_pydict(out, schema=arrow_piece())

    return both.mapInArrow(run, PIECE)


def arrow_piece():
    import pyarrow as pa

    return pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("times", pa.int64()), ("lead", pa.int32()), ("n", pa.int32()), ("raw", pa.binary()), ("low", pa.int32()), ("high", pa.int32()), ("key", pa.binary())])


def split_pieces(pieces: DataFrame) -> DataFrame:
    """Each piece as two: the strings of the lower and of the upper half of its starts before the anchor."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = {k: [] for k in arrow_piece().names}
            for r in b.to_pylist():
                mid = (r["low"] + r["high"]) // 2
                for low, high in ((r["low"], mid), (mid + 1, r["high"])):
                    # starts before the anchor that the segment has: lead down to lead - n + 1
                    a, z = min(r["lead"], high), max(r["lead"] - r["n"] + 1, low)
                    if low > high or a < z:
                        continue
                    skip = r["lead"] - a
                    raw = r["raw"][skip : r["lead"] - z + SPAN]
                    # what all strings that start low to high before the anchor have in common
                    key = raw[a - low : a - high + SPAN]
                    out["raw"].append(raw)
                    out["lead"].append(a)
                    out["n"].append(a - z + 1)
                    out["low"].append(low)
                    out["high"].append(high)
                    out["key"].append(key)
                    for k in ("anchor", "content", "times"):
                        out[k].append(r[k])
            yield pa.RecordBatch.from_pydict(out, schema=arrow_piece())

    return pieces.mapInArrow(run, PIECE)


class Spool:
    """Bytes one after the other: in memory, beyond a size in a file without a name."""

    def __init__(self, most: int):
        self.most, self.held, self.parts, self.file = most, 0, [], None

    def add(self, parts: list[bytes]) -> None:
        self.parts += parts
        self.held += sum(map(len, parts))
        if self.held > self.most:
            self.file = self.file or tempfile.TemporaryFile()
            self.file.writelines(self.parts)
            self.parts, self.held = [], 0

    def array(self) -> np.ndarray:
        if self.file is None:
            return np.frombuffer(b"".join(self.parts), np.uint8)
        self.file.writelines(self.parts)
        self.parts = []
        self.file.flush()
        return np.memmap(self.file, np.uint8, "r")


def sort_shards(pieces: DataFrame, memory: int) -> DataFrame:
    """anchor, content, lead of the piece's first string, and the stretches of repeated strings (from, to) as distances before the anchor."""

    def run(batches):
        import pyarrow as pa

        heads, sizes = [], []
        store, spool = Store(memory), Spool(memory // 16)
        for b in batches:
            heads.append(b.select(["anchor", "content", "lead", "n", "times"]))
            raw = b.column("raw").to_pylist()
            sizes += map(len, raw)
            spool.add(raw)
        if not sizes:
            return
        every = pa.Table.from_batches(heads)
        lead, n, times = (every.column(c).to_numpy() for c in ("lead", "n", "times"))
        text = spool.array()
        begins = np.concatenate(([0], np.cumsum(sizes)))
        valid, repeated = store.array(len(text), bool), store.array(len(text), bool)
        for i, z, many in zip(begins.tolist(), (begins[:-1] + n).tolist(), (times > 1).tolist()):
            valid[i:z] = True
            if many:  # what several equal segments hold is repeated anyway
                repeated[i:z] = True
        # valid places of the group that the block before has left open at its start, and the one if there is but one
        open_n, open_at = 0, None
        for pos, lcp in suffixes(text, memory):
            group = np.cumsum(lcp < SPAN)
            keep = valid[pos]
            p, g = pos[keep], group[keep]
            last = int(group[-1])
            size = np.bincount(g, minlength=last + 1)
            total = size.copy()
            total[last] += open_n
            repeated[p[total[g] > 1]] = True
            if open_n == 1 and total[last] > 1:
                repeated[open_at] = True
            if lcp[0] >= SPAN:
                open_at = int(p[0]) if size[0] else open_at if last == 0 else None
                open_n = int(total[0])
            else:
                open_n, open_at = 0, None
        a, z, before = [], [], False
        for i, j in store.blocks(len(text)):
            on = np.asarray(repeated[i:j] & valid[i:j])
            edge = np.diff(np.concatenate(([before], on)).astype(np.int8))
            a.append(np.flatnonzero(edge == 1) + i)
            z.append(np.flatnonzero(edge == -1) + i - 1)
            before = bool(on[-1])
        # strings of two pieces never touch, as a piece's last bytes start no string of it
        a, z = np.concatenate(a), np.concatenate(z)
        k = np.searchsorted(begins, a, "right") - 1
        yield from pa.table(
            [every.column("anchor").take(pa.array(k)), every.column("content").take(pa.array(k)), pa.array((lead[k] - (a - begins[k])).astype(np.int32)), pa.array((lead[k] - (z - begins[k])).astype(np.int32))],
            ["anchor", "content", "first", "last"],
        ).to_batches(max_chunksize=10_000)

    return pieces.mapInArrow(run, "anchor long, content long, first int, last int")


def repeated_stretches(docs: DataFrame, scratch: Scratch, crowd: int = CROWD, memory: int = MEMORY) -> DataFrame:
    """docs: row, row2, raw. Gives row, row2 and their stretches (a, b) of bytes to remove, unmerged."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    segs = scratch.put(find_segments(docs), "segments")
    anchors = segs.groupBy("anchor").agg(F.count("*").alias("c"), F.min("content").alias("x"), F.max("content").alias("y")).filter("c > 1").select("anchor", "c", (F.col("x") != F.col("y")).alias("mixed"))
    anchors = scratch.put(anchors, "anchors")
    twice = scratch.put(dealt_join(segs, anchors.drop("c"), ["anchor"], anchors, ["row", "at"]), "twice")
    scratch.drop("segments", "anchors")
    mixed = twice.filter("mixed")
    # one segment for each content
    kinds = mixed.groupBy("anchor", "content").agg(F.count("*").alias("times"), F.min(F.struct("row", "row2", "at", "n", "lead")).alias("s"))
    kinds = scratch.put(kinds.select("anchor", "content", "times", "s.*"), "kinds")
    level = 0
    live = scratch.put(cut_texts(kinds, docs), "pieces0")
    ready, equal = [], []
    while True:
        sizes = live.groupBy("anchor", "low", "key").agg(F.count("*").alias("c"))
        big = scratch.put(sizes.filter(F.col("c") > crowd), f"big{level}")
        if level >= WINDOWS.bit_length() or big.isEmpty():
            ready.append(live)
            break
        told = dealt_join(live, big.drop("c").withColumn("__big", F.lit(True)), ["anchor", "low", "key"], big, ["content", "lead"], "left")
        told = scratch.put(told.select(*live.columns, F.col("__big").isNotNull().alias("__big")), f"told{level}")
        ready.append(told.filter("not __big").drop("__big"))
        split = split_pieces(told.filter("__big").drop("__big"))
        level += 1
        split = scratch.put(split.withColumn("same", F.xxhash64("raw")), f"split{level}")
        # pieces of different segments may have become equal: all their strings repeat, and one of them goes on
        alike = ["anchor", "low", "lead", "n", "same"]
        copies = split.groupBy(*alike).agg(F.count("*").alias("copies"), F.min("content").alias("one")).filter("copies > 1")
        copies = scratch.put(copies, f"copies{level}")
        marked = scratch.put(dealt_join(split, copies, alike, copies.withColumnRenamed("copies", "c"), ["content"], "left"), f"marked{level}")
        equal.append(marked.filter("copies is not null").select("anchor", "content", F.col("lead").alias("first"), (F.col("lead") - F.col("n") + 1).alias("last")))
        live = marked.filter("copies is null or content = one").withColumn("times", F.coalesce("copies", "times"))
        live = scratch.put(live.select(*ready[0].columns), f"pieces{level}")
        scratch.drop(f"split{level}", f"copies{level}", f"pieces{level - 1}", f"big{level - 1}")
    every = ready[0]
    for r in ready[1:]:
        every = every.unionByName(r)
    shards = max(n, -(-(every.agg(F.sum(F.length("raw"))).first()[0] or 0) // SHARD))
    stretches = sort_shards(every.repartition(shards, "anchor", "low", "key"), memory)
    for e in equal:
        stretches = stretches.unionByName(e)
    found = scratch.put(stretches, "found")
    hits = dealt_join(mixed, found, ["anchor", "content"], kinds.select("anchor", "content", F.col("times").alias("c")), ["row", "at"]).select("row", "row2", (F.col("at") + F.col("lead") - F.col("first")).alias("a"), (F.col("at") + F.col("lead") - F.col("last") + SPAN).alias("b"))
    whole = twice.filter(~F.col("mixed")).select("row", "row2", F.col("at").alias("a"), (F.col("at") + F.col("n") - 1 + SPAN).alias("b"))
    scratch.drop(*[f"{k}{i}" for i in range(level + 1) for k in ("pieces", "big", "told", "marked")])
    return hits.unionByName(whole)


def keyed(docs: DataFrame, names: list[str]) -> DataFrame:
    """A struct __keep of the columns named, row and row2 (hashes of id and text) and raw (the text's bytes)."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    told = F.coalesce(F.col("doc_id").cast("string"), F.lit("\0"))
    return docs.select(F.struct(*[F.col(c) for c in names]).alias("__keep"), F.xxhash64(told, raw).alias("row"), F.hash(raw, told).alias("row2"), raw.alias("raw"))


def removals(docs: DataFrame, names: list[str], **options) -> DataFrame:
    """A struct __keep of the columns named, raw, and got: the stretches of bytes to remove, unmerged."""
    scratch = Scratch(docs.sparkSession, "substr")
    base = keyed(docs, names)
    got = repeated_stretches(base.select("row", "row2", "raw"), scratch, **options)
    lists = scratch.put(got.groupBy("row", "row2").agg(F.collect_set(F.struct("a", "b")).alias("got")), "lists")
    scratch.drop("twice", "found", "kinds")
    return base.join(lists, ["row", "row2"], "left")


def merged(got) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in got or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def remains(raw: bytes, spans: list) -> bytes:
    keep, last = [], 0
    for a, b in spans:
        keep.append(raw[last:a])
        last = b
    return b"".join([*keep, raw[last:]]) if spans else raw


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    src = removals(docs, ["doc_id"], **options).select("__keep.doc_id", "raw", "got")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            sizes, gone, runs, digests = [], [], [], []
            for raw, got in zip(b.column("raw").to_pylist(), b.column("got").to_pylist()):
                spans = merged(got)
                sizes.append(len(raw))
                gone.append(sum(z - a for a, z in spans))
                runs.append(len(spans))
                digests.append(hashlib.sha256(remains(raw, spans)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, gone, runs)), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def clean(docs: DataFrame, **options) -> DataFrame:
    """docs with the remaining text (cut characters go as a whole) and its n_chars; documents left without text go. docs' columns."""
    names = docs.columns
    others = [c for c in names if c != "text"]
    src = removals(docs, others, **options).select("__keep", "raw", "got")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [remains(raw, merged(got)).decode("utf-8", "ignore") for raw, got in zip(b.column("raw").to_pylist(), b.column("got").to_pylist())]
            keep = pa.array([x.strip() != "" for x in texts])
            kept = dict(zip(others, b.column("__keep").flatten()))
            cols = [pa.array(texts, pa.string()) if c == "text" else pa.array(map(len, texts), pa.int64()).cast(kept[c].type) if c == "n_chars" else kept[c] for c in names]
            yield pa.RecordBatch.from_arrays(cols, names).filter(keep)

    return src.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names))
