"""Edges, joined components, lines and stems on small pictures."""

import numpy as np
import pytest

from millrace.operators import stems


def flooded(weak, strong):
    out, stack = np.zeros_like(weak), [tuple(p) for p in np.argwhere(strong)]
    while stack:
        i, j = stack.pop()
        if 0 <= i < weak.shape[0] and 0 <= j < weak.shape[1] and weak[i, j] and not out[i, j]:
            out[i, j] = True
            stack += [(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    return out


def test_components_are_those_of_a_flood():
    rng = np.random.default_rng(1)
    for share in (0.0, 0.2, 0.4, 0.6, 1.0):
        weak = rng.random((40, 50)) < share
        strong = weak & (rng.random(weak.shape) < 0.02)
        assert (stems.joined(weak, strong) == flooded(weak, strong)).all()
    spiral = np.zeros((30, 30), bool)
    for k in range(0, 14, 2):
        spiral[k, k : 30 - k] = spiral[k : 30 - k, 29 - k] = spiral[29 - k, k : 30 - k] = True
    strong = np.zeros_like(spiral)
    strong[0, 0] = True
    assert (stems.joined(spiral, strong) == flooded(spiral, strong)).all()


def test_edges_are_one_pixel_wide_and_need_a_strong_place():
    x = np.full((20, 20), 50, np.uint8)
    x[:, 10:] = 200
    e = stems.edges(x)
    assert (e.sum(axis=1) == 1).all() and (np.argmax(e, axis=1) == e[0].argmax()).all() and e[0].argmax() in (9, 10)
    assert (stems.edges(x.T) == e.T).all()
    faint = np.full((20, 20), 50, np.uint8)
    faint[:, 10:] = 80  # a gradient of 120: weak all along
    assert not stems.edges(faint).any()
    faint[0, 10:] = 200
    assert stems.edges(faint)[:, 8:12].any(axis=1).all()


def test_closing_fills_gaps():
    x = np.zeros((9, 12), bool)
    x[4, [3, 4, 7, 8]] = True
    assert stems.closed(x)[4].nonzero()[0].tolist() == [3, 4, 5, 6, 7, 8] and stems.closed(x).sum() == 6
    assert not stems.closed(np.zeros((3, 3), bool)).any() and stems.closed(np.ones((3, 3), bool)).all()


@pytest.mark.parametrize("tilt", [-30, -17, 0, 1, 45, 90])
def test_lines_are_found_and_give_their_votes_back(tilt):
    x = np.zeros((200, 200), bool)
    t = np.arange(-80, 81)
    x[np.rint(100 + t * np.cos(np.radians(tilt))).astype(int), np.rint(100 + t * np.sin(np.radians(tilt))).astype(int)] = True
    found = stems.lines(x, 60, least=60)
    assert len(found) == 1
    x1, y1, x2, y2 = found[0]
    assert abs(np.hypot(x2 - x1, y2 - y1) - 160) < 4
    off = abs((x1 - 100) * np.cos(np.radians(tilt)) - (y1 - 100) * np.sin(np.radians(tilt)))
    assert off < 1.5


def test_gaps_split_lines():
    x = np.zeros((300, 40), bool)
    x[10:110, 20] = x[115:135, 20] = x[170:290, 20] = True
    assert sorted(stems.lines(x, 100, least=50)) == [(20, 10, 20, 134), (20, 170, 20, 289)]
    assert stems.lines(x, 100, least=121) == [(20, 10, 20, 134)] and stems.lines(np.zeros((5, 5), bool)) == []


def test_the_best_stem_by_its_score():
    upright, tilted, level, middle = (10, 0, 10, 99), (0, 0, 50, 99), (0, 5, 99, 5), (50, 0, 50, 99)
    assert stems.best_stem([level, middle, upright], 100, 100) == upright and stems.best_stem([level], 100, 100) is None
    assert stems.best_stem([tilted, level], 100, 100) == tilted and stems.best_stem([(0, 0, 80, 99)], 100, 100) is None
    # equal scores: the first
    assert stems.best_stem([(20, 0, 20, 99), (80, 0, 80, 99)], 100, 100) == (20, 0, 20, 99)


def test_reports(spark):
    plain, half = np.full((160, 200, 3), 90, np.uint8), np.full((160, 200, 3), 60, np.uint8)
    half[:, 70:] = 200
    rows = [(1, 160, 200, 3, plain.tobytes()), (2, 160, 200, 3, half.tobytes()), (3, 160, 200, 3, b"short"), (4, None, 200, 3, b"")]
    got = {r.id: r for r in stems.crop_reports(spark.createDataFrame(rows, "id int, height int, width int, channels int, pixels binary")).collect()}
    assert (got[1].confidence, got[1].box, got[1].stem, got[1].needs_review) == ("low", [20, 0, 180, 160], None, True)
    assert got[2].confidence == "high" and abs(got[2].stem[0] - 70) <= 1 and got[2].box == [got[2].stem[0] - 50, 0, got[2].stem[0] + 50, 160]
    assert got[3].error.startswith("ValueError") and got[3].box is None and got[4].error and not got[4].detected
