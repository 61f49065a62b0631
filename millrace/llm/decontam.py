"""Benchmark decontamination by n-gram windows.

The windows of the benchmark (N consecutive words; a shorter item is one window) form
a hash set that every task gets as a broadcast. The set's size is checked first: items
are split into blocks of about BLOCK_WORDS words (some 0.1 GB in a worker); with several,
the documents are numbered and written once, each block is broadcast and scanned for on its
own, and only the numbers of documents with hits and their spans meet again; so a benchmark
of any size keeps the broadcast bounded. Documents are scanned whole. Words outside the
block's vocabulary end a run, so only runs of known words are looked up, and a window
counts only if its words are equal (no hash is trusted).

Null or empty texts have no words, no hits, and stay. Repeated rows get equal results;
repeated item ids count once. Only doc_id and text (item_id and text) are read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch

N = 10
#: Words of the items in one broadcast.
BLOCK_WORDS = 400_000
#: A document with more than this share of its words hit goes as a whole; otherwise the hit spans go.
MAX_SHARE = 0.5

KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(KEEP).split() if text else []


def blocks(bench: DataFrame, n: int, block_words: int):
    """Index blocks: (vocabulary, windows by length). Rows arrive one partition at a time."""
    seen, vocab, windows, size = False, {}, {}, 0
    for row in bench.select("item_id", "text").toLocalIterator():
        ids = [vocab.setdefault(w, len(vocab)) for w in words_of(row.text)]
        if not ids:
            continue
        k = min(n, len(ids))
        table = windows.setdefault(k, {})
        for i in range(len(ids) - k + 1):
            items = table.setdefault(tuple(ids[i : i + k]), [])
            if row.item_id not in items[-1:]:
                items.append(row.item_id)
        size += len(ids)
        seen = True
        if size >= block_words:
            yield vocab, windows
            vocab, windows, size, seen = {}, {}, 0, False
    if seen:
        yield vocab, windows


def scan(words: list[bytes], vocab: dict, windows: dict) -> tuple[list[tuple[int, int]], set]:
    """Hit spans [start, end) of words, ascending and disjoint, and the item ids."""
    get = vocab.get
    ids = [get(w, -1) for w in words]
    least = min(windows)
    hits, items = [], set()
    start, total = 0, len(ids)
    while start < total:
        try:
            end = ids.index(-1, start)
        except ValueError:
            end = total
        if end - start >= least:
            for k, table in windows.items():
                for i in range(start, end - k + 1):
                    found = table.get(tuple(ids[i : i + k]))
                    if found:
                        hits.append((i, i + k))
                        items.update(found)
        start = end + 1
        # long stretches without a known word are skipped quickly
        while start < total and ids[start] < 0:
            start += 1
    return merge(hits), items


def merge(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = "array<struct<a:int,b:int>>"


def report_rows(b, texts, hits):
    """Arrow columns n_words, n_hit, n_items, items_sha256, contaminated of a batch. hits: spans and items of each text."""
    import pyarrow as pa

    n_hit = [sum(z - a for a, z in spans) for spans, _ in hits]
    digests = [hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest() for _, items in hits]
    return [pa.array([len(words_of(t)) for t in texts], pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(i) for _, i in hits], pa.int64()), pa.array(digests, pa.string()), pa.array([n > 0 for n in n_hit])]


def scan_blocks(docs: DataFrame, bench: DataFrame, n: int, block_words: int, carry: list[str], emit, schema: str) -> DataFrame:
    """emit(batch, hits by row) over the documents; docs' columns in carry are in the batch as the struct __keep, beside text."""
    spark = docs.sparkSession
    src = docs.select(F.struct(*[F.col(c) for c in carry]).alias("__keep"), "text")
    parts = [spark.sparkContext.broadcast(x) for x in blocks(bench, n, block_words)]

    def find(index, text):
        vocab, windows = index
        words = words_of(text)
        return scan(words, vocab, windows) if words and windows else ([], set())

    if len(parts) <= 1:
        only = parts[0] if parts else spark.sparkContext.broadcast(({}, {}))

        def run(batches):
            for b in batches:
                yield from emit(b, [find(only.value, t) for t in b.column("text").to_pylist()])

        return src.mapInArrow(run, schema)
    scratch = Scratch(spark, "decontam")
    numbered = scratch.put(src.withColumn("__row", F.monotonically_increasing_id()), "numbered")

    def over(index):
        def run(batches):
            import pyarrow as pa

            for b in batches:
                got = [(i, *find(index.value, t)) for i, t in zip(b.column("__row").to_pylist(), b.column("text").to_pylist())]
                got = [(i, [{"a": a, "b": z} for a, z in spans], [str(x) for x in items]) for i, spans, items in got if spans]
                cols = [pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array([g[2] for g in got], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, ["__row", "spans", "items"])

        return numbered.select("__row", "text").mapInArrow(run, f"__row long, spans {SPANS}, items array<string>")

    every = over(parts[0])
    for p in parts[1:]:
        every = every.unionByName(over(p))
    hits = scratch.put(every.groupBy("__row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")), "hits")

    def run(batches):
        for b in batches:
            found = zip(b.column("spans").to_pylist(), b.column("items").to_pylist())
            yield from emit(b, [(merge([(s["a"], s["b"]) for s in spans or ()]), set(items or ())) for spans, items in found])

    return numbered.join(hits, "__row", "left").select("__keep", "text", "spans", "items").mapInArrow(run, schema)


def report(docs: DataFrame, bench: DataFrame, n: int = N, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]

    def emit(b, hits):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([b.column("__keep").flatten()[0], *report_rows(b, b.column("text").to_pylist(), hits)], names)

    return scan_blocks(docs, bench, n, block_words, ["doc_id"], emit, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def clean(docs: DataFrame, bench: DataFrame, n: int = N, max_share: float = MAX_SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the hit spans, and without documents of which more than max_share was hit. n_chars follows the text."""
    names = docs.columns
    others = [c for c in names if c != "text"]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def emit(b, hits):
        import pyarrow as pa

        texts = b.column("text").to_pylist()
        kept = dict(zip(others, b.column("__keep").flatten()))
        stays, sizes = [True] * len(texts), kept["n_chars"].to_pylist() if "n_chars" in kept else None
        for i, (spans, _) in enumerate(hits):
            if spans:
                stays[i] = sum(z - a for a, z in spans) <= len(words_of(texts[i])) * max_share
                texts[i] = cut_spans(texts[i], spans)
                if sizes:
                    sizes[i] = len(texts[i])
        if sizes:
            kept["n_chars"] = pa.array(sizes, kept["n_chars"].type)
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else kept[c] for c in names], names).filter(pa.array(stays))

    return scan_blocks(docs, bench, n, block_words, others, emit, ", ".join(f"`{c}` {kinds[c]}" for c in names))


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between two of one span."""
    raw = text.encode("utf-8", "surrogatepass")
    flat = raw.translate(KEEP)
    at, i, n = [], 0, len(flat)
    while i < n:
        if flat[i] == 32:
            i += 1
            continue
        j = flat.find(b" ", i)
        j = n if j < 0 else j
        at.append((i, j))
        i = j
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT k FROM k),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, n WHERE len(w) >= k)),
h AS (SELECT dw.doc_id, dw.i, dw.k, k.item_id FROM dw JOIN k USING (k, s)),
c AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
