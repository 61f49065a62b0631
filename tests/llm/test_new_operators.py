"""Fill-in-middle, compression classifier and whitening: brute force, and nulls, empty texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from millrace.llm import compressed, fim, whitening

KIND = "doc_id long, text string, lang string, output string, form string, score double, fim long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y", 1.0, 3) for i, t in rows], KIND)


def texts():
    rng = random.Random(3)
    out = [None, "", " ", "a", "abc", "<P> in it", "x<S>", "<M>", "<", "a<P", ">b<", "\x01\x02\x020\x021\x01", "\x02", "a\x02b1", "line\nline\r\n\ttab", "ünï cödé 漢字 😀x😀", "$1 \\1 $0", "é" * 50, "word " * 20_000]
    out += ["".join(rng.choice("ab c.<>PSM\x01\x02é\n😀01") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    return out


def brute_fim(doc_id, text):
    t = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    if h[3] % 100 < 20:
        return n, "spm", pre, mid, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", pre, mid, f"<P>{pre}<S>{suf}<M>{mid}"


def test_fim_against_brute_force(spark):
    rows = [*enumerate(texts()), (None, "null id"), (3, "abc def"), (3, "abc def")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = sorted(map(tuple, fim.report(frame(spark, rows)).collect()), key=repr)
    want = []
    for i, t in rows:
        n, form, pre, mid, out = brute_fim(i, t)
        want.append((i, n, form, None if pre is None else len(pre), None if mid is None else len(mid), sha(out), sha(t or "")))
    assert got == sorted(want, key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_fim_transform_carries_columns_and_options(spark):
    rows = list(enumerate(texts()))
    out = fim.transform(frame(spark, rows), fim=100, spm=100, name="made")
    assert out.columns == [*frame(spark, []).columns, "made"]
    for r in out.collect():
        held = not r.text or any(m in r.text for m in ("<P>", "<S>", "<M>"))
        assert r.made.form == ("plain" if held else "spm")
        assert held or r.made.prefix + r.made.middle + r.made.suffix == r.text
    assert fim.transform(frame(spark, [])).count() == 0 and fim.report(frame(spark, [])).count() == 0


def test_fim_sql(spark):
    rows = [*enumerate(texts()), (None, "null id")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = fim.report(frame(spark, rows))
    want = con.execute(fim.ORACLE)
    assert [c[0] for c in want.description] == got.columns
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in got.collect())


def test_fim_is_built_in_functions_only(spark):
    plan = fim.report(frame(spark, []))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(500)]

    def good():
        return " ".join(rng.choice(words) for _ in range(rng.randint(20, 400))) + "."

    def bad():
        kind = rng.randrange(3)
        if kind == 0:
            return " | ".join(rng.choice(words) for _ in range(rng.randint(20, 300)))
        if kind == 1:
            return " ".join(rng.choice(words).upper() + "!!" for _ in range(rng.randint(20, 300)))
        return " ".join([rng.choice(words)] * rng.randint(20, 300))

    docs = [(i, bad() if i % 5 == 0 else good()) for i in range(900)]
    labels = [(i, int(i % 5 != 0), 0) for i in range(900)]
    return docs, labels


LABELS = "doc_id long, quality int, toxic int"


def test_compression_on_held_out_texts(spark, graded):
    docs, labels = graded
    got = {r.doc_id: r for r in compressed.score(frame(spark, [*docs, (9001, None), (9002, ""), (None, "no id"), (9003, "long text " * 100_000)]), spark.createDataFrame([*labels, labels[1], (5, None, 1), (None, 1, 0)], LABELS)).collect()}
    held = [i for i, _ in docs if got[i].held_out]
    assert 100 < len(held) < 300
    right = [got[i].predicted == labels[i][1] for i in held]
    assert sum(right) / len(right) > 0.97
    assert len(got) == 904 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert got[9001].score == got[9002].score and not got[None].held_out
    # calibrated: the mean score of all is near the share of label 1
    assert abs(np.mean([got[i].score for i in held]) - np.mean([labels[i][1] for i in held])) < 0.05


def test_compression_margin_by_hand():
    bad, good = compressed.compressors([b"junk | junk | junk | junk | " * 50, b"plain words of a good text. " * 50])
    text = "plain words of a good text. " * 90
    raw = text.encode()
    want = sum(len(bad.compress(raw[i : i + 1024])) - len(good.compress(raw[i : i + 1024])) for i in range(0, len(raw), 1024))
    assert compressed.margin(text, bad, good) == want / (len(raw) + 64) > 0
    assert compressed.margin("junk | " * 300, bad, good) < 0 and compressed.margin(None, bad, good) == 0


def test_compression_curve_is_the_minimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-(2 * x - 1)))).astype(int)
    a, b = compressed.curve(x, y, np.ones(500))
    assert abs(a - 2) < 0.6 and abs(b + 1) < 0.4

    def value(a, b):
        n1, n0 = y.sum(), (1 - y).sum()
        t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        z = a * x + b
        return float(np.sum(np.logaddexp(0, z) - t * z))

    assert all(value(a, b) <= value(a + da, b + db) + 1e-2 for da, db in ((0.1, 0), (-0.1, 0), (0, 0.1), (0, -0.1)))


def test_compression_without_labels_or_documents(spark, graded):
    docs, labels = graded
    empty, of = spark.createDataFrame([], LABELS), lambda rows: spark.createDataFrame(rows, LABELS)
    few = frame(spark, docs[:20])
    assert {r.score for r in compressed.score(few, empty).collect()} == {0.5}
    assert all(r.score > 0.99 for r in compressed.score(few, of([x for x in labels if x[1] == 1])).collect())
    assert all(r.score < 0.01 for r in compressed.score(few, of([x for x in labels if x[1] == 0])).collect())
    assert compressed.score(frame(spark, []), of(labels)).count() == 0
    # texts too few to train on serve as they are
    assert compressed.score(few, of(labels[:20])).count() == 20


def test_compression_bounds_the_blocks(spark, graded):
    docs, labels = graded
    texts = []
    made = compressed.dictionary

    def told(samples, size=compressed.DICTIONARY):
        texts.append(samples)
        return made(samples, size)

    compressed.dictionary, before = told, compressed.dictionary
    try:
        compressed.learn(frame(spark, docs), spark.createDataFrame(labels, LABELS), most=40)
    finally:
        compressed.dictionary = before
    assert all(0 < len(s) < 120 and max(map(len, s)) <= compressed.BLOCK for s in texts)


VECTORS = "vec_id long, embedding array<float>, label int, n long, component string"


def vecs(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, "c") for i, v in rows], VECTORS)


def exact(rows):
    """By fractions: n, deviations, covariance, integer vectors by row."""
    kept = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    d = max(len(v) for _, v in kept)
    xs = [(i, tuple(int(np.floor(64 * c)) + 1_000_000 for c in [*v, *[0.0] * (d - len(v))])) for i, v in kept]
    fit = sorted({x for _, x in xs})
    n = len(fit)
    s = [sum(x[k] for x in fit) for k in range(d)]
    cov = [[sum((Fraction(x[i]) - Fraction(s[i], n)) * (Fraction(x[j]) - Fraction(s[j], n)) for x in fit) / n for j in range(d)] for i in range(d)]
    return n, s, np.array([[float(v) for v in r] for r in cov]), xs, fit


@pytest.mark.parametrize("spread", [1.0, 1e7])
def test_whitening_against_fractions(spark, spread):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5)) * spread + 3
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(60, rows[0][1]), (60, rows[0][1]), (None, rows[1][1]), (61, None), (62, [1.0, None, 2.0, 3.0, 4.0]), (63, [1.0, float("nan"), 2.0, 3.0, 4.0]), (64, [float("inf")] * 5), (65, [1.0]), (66, [])]
    n, s, cov, xs, fit = exact(rows)
    got = whitening.report(vecs(spark, rows)).collect()
    values = np.linalg.eigvalsh(cov)[::-1]
    assert len(got) == len(xs) * 5 and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-6
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, set()).add((r.deviation, round(r.whitened, 9)))
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9
    mean = np.array([float(Fraction(v, n)) for v in s])
    for i, x in xs:
        deviation = sum((n * a - b) ** 2 for a, b in zip(x, s))
        assert {v[0] for v in by[i][1]} == {deviation if deviation < 1 << 63 else None}
    # distances between whitened rows do not depend on signs
    inverse = np.linalg.inv(cov)
    whole = {i: np.array([next(iter(by[i][k]))[1] for k in range(1, 6)]) for i, _ in xs if i is not None}
    for i, x in xs[:20]:
        y = np.array(x) - mean
        assert abs(whole[i] @ whole[i] - y @ inverse @ y) < 1e-6 * max(1, y @ inverse @ y)


def test_whitening_products_are_exact():
    rng = np.random.default_rng(4)
    for top in (10, 1 << 20, 1 << 40, 1 << 62):
        x = rng.integers(-top, top, (300, 4))
        gram = whitening.Gram(4)
        for part in np.array_split(x, 7):
            gram.add(part)
        want = x.astype(object).T @ x.astype(object)
        total = {}
        for i, j, place, digit in gram.digits():
            total[i, j] = total.get((i, j), 0) + (digit << (whitening.DIGIT * place))
        assert total == {(i, j): want[i, j] for i in range(4) for j in range(i, 4)}


def test_whitening_folds_before_products_lose_bits(monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 8)
    x = np.full((100, 2), (1 << 62) - 1)
    gram = whitening.Gram(2)
    gram.add(x)
    assert sum(d << (whitening.DIGIT * p) for i, j, p, d in gram.digits() if (i, j) == (0, 1)) == 100 * ((1 << 62) - 1) ** 2


def test_whitening_without_variance(spark):
    assert whitening.report(vecs(spark, [])).count() == 0
    assert whitening.report(vecs(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.report(vecs(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    # one of three directions is constant, and two vectors span one line only
    out = whitening.report(vecs(spark, [(1, [1.0, 0.0, 5.0]), (2, [2.0, 0.0, 5.0]), (3, [2.0, 1.0, 5.0])])).collect()
    assert sorted({r.component for r in out}) == [1, 2] and abs(sum({r.component: r.explained for r in out}.values()) - 1) < 1e-12
    out = whitening.report(vecs(spark, [(1, [1e30, 0.0]), (2, [-1e30, 0.0])])).collect()
    assert [r.component for r in out] == [1, 1] and out[0].deviation is None and abs(abs(out[0].whitened) - 1) < 1e-9
