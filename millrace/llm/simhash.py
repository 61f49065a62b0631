"""Near-duplicates by SimHash and tiled exact comparison.

Fingerprints of 64 bits over 3-word shingles (XXH64, seed 42). Distinct fingerprints are
cut into tiles by the population counts of their two halves; tiles whose counts differ
by more than the radius are never paired. A pair of tiles is compared by numpy
exclusive-or and bit counts, again only between the parts whose population counts (of
the four 16-bit words) are within the radius, so no link is missed. A pair of tiles
gives a spanning forest of its links, and components come from those forests.

Tiles have TILE fingerprints at least and a PARTS-th of all, LARGEST_TILE at most: two tiles
are what a task holds, and their comparison bounds how long it runs. So beyond PARTS times
LARGEST_TILE fingerprints, the copies of tiles grow with the square as the comparisons do,
at four megabytes for some 10^10 comparisons. Copies of a text share one fingerprint and are
compared once, however many they are; rows of a fingerprint that many rows share are dealt
over several tasks where they get their component.

Null and empty texts, and those without a word, have fingerprint zero and are linked
like any other. Rows without a doc_id count for no id; their component_id is the least
id that they reach, null if there is none. Repeated rows stay in the report. Only doc_id and
text are read. keep_first keeps one row of each component: that of the least doc_id (rows
without one come last; ties by a hash of id and text), one of equal rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, dealt_join
from millrace.llm.components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
TILE, LARGEST_TILE, PARTS = 2048, 262_144, 64
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None) -> int:
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split() if text else []
    if not words:
        return 0
    flat = b" ".join(words)
    n = len(words)
    if n <= SHINGLE:
        h = np.array([xxh64_intdigest(flat, SEED)], np.uint64)
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate(([0], ends[:-1]))[: n - SHINGLE + 1].tolist()
        h = np.array([xxh64_intdigest(flat[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        ones += np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs' columns but text, and fp (the 64 bits as a long)."""
    names = [c for c in docs.columns if c != "text"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(got.view(np.int64))], [*names, "fp"])

    return docs.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", fp long")


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (child, root) of links a-b between nodes 0..n-1, roots being least."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        if (x == y).all():
            break
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def sections(fps: np.ndarray) -> tuple[np.ndarray, list[tuple[tuple[int, ...], int, int]]]:
    """The fingerprints by population counts of their words, and each section's counts and bounds."""
    pops = np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int64)
    key = pops @ np.array([17**3, 17**2, 17, 1])
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.diff(key[order], prepend=-1)).tolist() + [len(fps)]
    return order, [(tuple(pops[order[i]].tolist()), i, j) for i, j in zip(cut, cut[1:])]


def links(x: np.ndarray, y: np.ndarray | None, radius: int = RADIUS, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within x (y is None) or between x and y, as two arrays of fingerprints."""
    ox, sx = sections(x)
    same = y is None
    oy, sy = (ox, sx) if same else sections(y)
    xs, ys = x[ox], (x[ox] if same else y[oy])
    every = xs if same else np.concatenate([xs, ys])
    shift = 0 if same else len(xs)
    counts = np.array([k for k, _, _ in sy])
    got_a, got_b, held = [], [], 0
    for i, (k, a0, a1) in enumerate(sx):
        near = np.flatnonzero(np.abs(counts - np.array(k)).sum(axis=1) <= radius)
        if same:
            near = near[near >= i]
        if not len(near):
            continue
        other = np.concatenate([np.arange(sy[j][1], sy[j][2]) for j in near.tolist()])
        step = max(1, 2_000_000 // len(other))
        for c in range(a0, a1, step):
            r, s = np.nonzero(np.bitwise_count(xs[c : min(a1, c + step), None] ^ ys[None, other]) <= radius)
            if len(r):
                got_a.append(r + c)
                got_b.append(other[s] + shift)
                held += len(r)
                if held > most:
                    fa, fb = forest(np.concatenate(got_a), np.concatenate(got_b), len(every))
                    got_a, got_b, held = [fa], [fb], 0
    if not got_a:
        return np.array([], np.uint64), np.array([], np.uint64)
    fa, fb = forest(np.concatenate(got_a), np.concatenate(got_b), len(every))
    return every[fa], every[fb]


def tiles(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """fps: distinct fp. One row per tile: its number, the halves' counts, the fingerprints as bytes."""
    # at most 33 x 33 cells
    cells = fps.withColumn("h", F.bit_count(F.shiftrightunsigned("fp", 32))).withColumn("l", F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))))
    sizes = cells.groupBy("h", "l").agg(F.count("*").alias("n")).orderBy("h", "l").collect()
    total = sum(r["n"] for r in sizes)
    size = min(max(tile, total // PARTS), LARGEST_TILE)
    parts = {(r["h"], r["l"]): -(-r["n"] // size) for r in sizes}
    many = F.create_map(*[x for (h, l), n in parts.items() for x in (F.lit(h * 64 + l), F.lit(n))]) if parts else F.create_map(F.lit(0), F.lit(1))
    numbered = cells.withColumn("part", F.pmod(F.xxhash64("fp"), F.coalesce(F.try_element_at(many, (F.col("h") * 64 + F.col("l")).cast("int")), F.lit(1))).cast("int"))

    def gather(key, rows):
        import pyarrow as pa

        raw = rows.column("fp").to_numpy().tobytes()
        return pa.table([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([raw], pa.binary())], ["h", "l", "part", "raw"])

    return numbered.groupBy("h", "l", "part").applyInArrow(gather, "h int, l int, part int, raw binary")


def link_fingerprints(fps: DataFrame, scratch: Scratch, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges a, b between distinct fingerprints: forests with the components of all links."""
    made = scratch.put(tiles(fps, radius, tile).withColumn("id", (F.col("h") * 64 + F.col("l")).cast("long") * 2**32 + F.col("part")), "tiles")
    near = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius]
    # a tile meets those of the cells around its own; the pair is dealt out by its two numbers
    places = made.groupBy("h", "l").agg((F.max("part") + 1).alias("n"))
    around = places.select("h", "l", "n", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in near])).alias("d"))
    around = around.select(F.col("h").alias("h2"), F.col("l").alias("l2"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part2"), (F.col("h") + F.col("d.i")).alias("h"), (F.col("l") + F.col("d.j")).alias("l"))
    other = (F.col("h2") * 64 + F.col("l2")).cast("long") * 2**32 + F.col("part2")
    pairs = made.select("id", "h", "l").join(around, ["h", "l"]).withColumn("id2", other).filter("id <= id2").select("id", "id2")
    both = pairs.join(made.select("id", "raw"), "id").join(made.select(F.col("id").alias("id2"), F.col("raw").alias("raw2")), "id2")

    def compare(batches):
        import pyarrow as pa

        for b in batches:
            for i, j, x, y in zip(*(b.column(c).to_pylist() for c in ("id", "id2", "raw", "raw2"))):
                fa, fb = links(np.frombuffer(x, np.uint64), None if i == j else np.frombuffer(y, np.uint64), radius)
                if len(fa):
                    yield pa.RecordBatch.from_arrays([pa.array(fa.view(np.int64)), pa.array(fb.view(np.int64))], ["a", "b"])

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(4 * n).mapInArrow(compare, "a long, b long")


def rooted(marked: DataFrame, scratch: Scratch, radius: int, tile: int) -> DataFrame:
    """The fingerprints of marked (doc_id, fp): fp, root (of its component), first (least doc_id of fp), c (rows of fp)."""
    distinct = scratch.put(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("c")), "distinct")
    edges = scratch.put(link_fingerprints(distinct.select("fp"), scratch, radius, tile), "edges")
    roots = components(edges, scratch).select(F.col("node").alias("fp"), "root")
    out = scratch.put(distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first", "c"), "rooted")
    scratch.drop("tiles", "edges", "distinct")
    return out


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (hex), component_id."""
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.put(fingerprints(docs.select("doc_id", "text")), "marked")
    roots = rooted(marked, scratch, radius, tile)
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = scratch.put(roots.join(least, "root").select("fp", "component_id", "c"), "named")
    scratch.drop("rooted")
    # by place in the written table, as ids may be null or equal
    placed = marked.withColumn("__place", F.monotonically_increasing_id())
    told = dealt_join(placed, named.drop("c"), ["fp"], named.select("fp", "c"), ["__place"], "left")
    return told.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row of each component, that of its least doc_id; docs' columns."""
    scratch = Scratch(docs.sparkSession, "simhash")
    # a row by 96 bits of its id and text
    told, text = F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")), F.coalesce("text", F.lit("\0"))
    keys = {"__r1": F.xxhash64(told, text), "__r2": F.hash(text, told)}
    marked = scratch.put(fingerprints(docs.select("doc_id", "text", *[v.alias(k) for k, v in keys.items()])), "marked")
    roots = rooted(marked.select("doc_id", "fp"), scratch, radius, tile)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *keys)
    least = marked.groupBy("fp").agg(F.min(row).alias("row")).join(roots.select("fp", "root"), "fp").groupBy("root").agg(F.min("row").alias("row"))
    least = scratch.put(least.select("row.__r1", "row.__r2").distinct(), "least")
    scratch.drop("marked", "rooted")
    return docs.withColumns(keys).join(least, list(keys), "left_semi").dropDuplicates(list(keys)).select(*[F.col(f"`{c}`") for c in docs.columns])
