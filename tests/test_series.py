"""Streams with state: any cut of a log gives what one pass gives; a stopped stream goes on; late rows are told."""

import json
import os
import random

import pytest

from millrace.streaming import series

ROW = "key string, step long, value double"


def log(seed=1):
    rng = random.Random(seed)
    return [(k, i, None if rng.random() < 0.1 else round(rng.random() * (1 if i < 20 else 0.0005), 6)) for i in range(40) for k in "ab"]


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    path = folder / f"{name}.json"
    path.write_text("\n".join(json.dumps({"key": k, "step": i, **({} if v is None else {"value": v})}) for k, i, v in rows))
    os.utime(path, (1e9 + int(name), 1e9 + int(name)))  # files come by their time


def stream(spark, folder):
    return spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).json(str(folder))


def plain_progress(rows, patience=5, window=10, spread=0.001):
    state, out = {}, []
    for k, i, v in rows:
        s = state.setdefault(k, dict(best=None, stale=0, stopped=False, values=[]))
        improved = v is not None and (s["best"] is None or v < s["best"])
        s["best"], s["stale"] = (v, 0) if improved else (s["best"], s["stale"] + 1)
        s["stopped"] = s["stopped"] or s["stale"] >= patience
        s["values"] += [v] if v is not None else []
        last = s["values"][-window:]
        out.append((k, i, False, s["best"], improved, s["stale"], s["stopped"], len(s["values"]) > window and max(last) - min(last) < spread))
    return out


@pytest.mark.parametrize("cuts", [[], [10], [1, 2, 40, 41]])
def test_progress_over_any_cut(spark, tmp_path, cuts):
    rows = log()
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        put(tmp_path / "in", f"{n:03d}", rows[a:b][::-1])  # within a batch the order is that of the steps
        # a stream that ends after each file and is started again
        got = series.run_to_end(series.followed(stream(spark, tmp_path / "in"), series.Progress), str(tmp_path / "out"), str(tmp_path / "state"))
    want = plain_progress(rows)
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(w[7] for w in want) and any(w[6] for w in want)


def test_replayed_rows_are_late(spark, tmp_path):
    rows = log()
    put(tmp_path / "in", "0", rows[:30])
    put(tmp_path / "in", "1", rows[20:])
    got = series.run_to_end(series.followed(stream(spark, tmp_path / "in"), series.Progress), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    assert sum(r.late for r in got) == 10 and sorted(tuple(r) for r in got if not r.late) == sorted(plain_progress(rows))


def test_misses_and_quota(spark, tmp_path):
    hits = [("a", i, float(i % 7 == 0 and i < 20)) for i in range(40)] + [("b", i, 1.0) for i in range(12)]
    put(tmp_path / "in", "0", hits[:25])
    put(tmp_path / "in", "1", hits[25:])
    got = {(r.key, r.step): r.probed for r in series.run_to_end(series.followed(stream(spark, tmp_path / "in"), series.Misses, most=10), str(tmp_path / "out"), str(tmp_path / "state")).collect()}
    # the last hit is 14, so 24 is the tenth miss
    assert [i for i in range(40) if got["a", i]] == list(range(25)) and all(got["b", i] for i in range(12))
    lengths = [("s", i, float(i % 13)) for i in range(30)]
    put(tmp_path / "in2", "0", lengths[:7])
    put(tmp_path / "in2", "1", lengths[7:])
    parts = {r.step: r.part for r in series.run_to_end(series.followed(stream(spark, tmp_path / "in2"), series.Quota, rows=25, few=2, test=5), str(tmp_path / "out2"), str(tmp_path / "state2")).collect()}
    fit = [i for i in range(25) if 5 <= i % 13 <= 30]
    assert [i for i in range(30) if parts[i] == "few_shot"] == fit[:2] and [i for i in range(30) if parts[i] == "test"] == fit[2:7]


def test_state_is_forgotten_after_its_time(spark, tmp_path):
    import time

    put(tmp_path / "in", "0", [("a", 1, 5.0)])
    told = lambda: series.followed(stream(spark, tmp_path / "in"), series.Progress, keep=1)
    series.run_to_end(told(), str(tmp_path / "out"), str(tmp_path / "state"), one_batch=True)
    time.sleep(0.1)
    put(tmp_path / "in", "1", [("a", 2, 9.0)])
    got = {r.step: r for r in series.run_to_end(told(), str(tmp_path / "out"), str(tmp_path / "state"), one_batch=True).collect()}
    assert got[2].best == 9.0 and got[2].improved
