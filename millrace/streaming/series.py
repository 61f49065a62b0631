"""Append logs as streams with state: progress of a series, consecutive misses, quotas.

Each key has one small state, whatever the number of its rows, and loses it when nothing has
come for `keep` (a time to live, None for never). Rows of one batch are taken by their step; a row whose step isn't
beyond the last one taken changes nothing and is told as late, so a log that is replayed or
cut anywhere between its steps gives what one pass over it gives. Keys are dealt over the tasks of
the shuffle; a batch of one key is read in pieces, sorted by step, and never held elsewhere.

These need a state store that holds several states for each key: within() sets it for a query.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Epochs without improvement, values of a plateau and their spread, misses in a row, rows looked at and lengths and sizes of the two parts.
PATIENCE, WINDOW, SPREAD, MISSES = 5, 10, 0.001, 10
ROWS, SHORTEST, LONGEST, FEW, TEST = 500, 5, 30, 3, 30


@contextlib.contextmanager
def within(spark: SparkSession):
    """Streams that start in this block keep their state in a store that can hold these."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


class Taken(StatefulProcessor):
    """One value state a key, a row of `fields` with the last step first; start() gives it for a new key, take() moves it on by a row."""

    fields = ""
    names: tuple[str, ...] = ()

    def __init__(self, keep: int | None):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("series", self.fields, self.keep)

    def start(self) -> list:
        raise NotImplementedError

    def take(self, state: list, step: int, value) -> tuple:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import numpy as np
        import pandas as pd

        # a key has few rows: what a frame costs counts more than they do
        frames = list(rows)
        steps, values = ([x for f in frames for x in f[c].tolist()] for c in ("step", "value"))
        order = sorted(range(len(steps)), key=steps.__getitem__)
        state = list(self.state.get()) if self.state.exists() else self.start()
        out = []
        for step, value in ((steps[i], values[i]) for i in order):
            late = state[0] is not None and step <= state[0]
            if late:
                out.append((key[0], step, True, *[None] * len(self.names)))
            else:
                state[0] = step
                out.append((key[0], step, False, *self.take(state, step, None if value != value else value)))
        self.state.update(tuple(state))
        columns = {}
        for name, column in zip(("key", "step", "late", *self.names), zip(*out)):
            columns[name] = np.empty(len(out), object)
            columns[name][:] = column
        yield pd.DataFrame(columns, copy=False)

    def close(self) -> None:
        pass


class Progress(Taken):
    """Best value so far (the least), whether the row improved it, rows since, whether patience has run out, and whether the last values lie on a plateau."""

    fields = "step long, best double, stale long, stopped boolean, seen long, recent array<double>"
    names = ("best", "improved", "stale", "stopped", "plateau")
    returns = "best double, improved boolean, stale long, stopped boolean, plateau boolean"

    def __init__(self, keep, patience: int = PATIENCE, window: int = WINDOW, spread: float = SPREAD):
        super().__init__(keep)
        self.patience, self.window, self.spread = patience, window, spread

    def start(self):
        return [None, None, 0, False, 0, []]

    def take(self, state, step, value):
        _, best, stale, stopped, seen, recent = state
        improved = value is not None and (best is None or value < best)
        best, stale = (value, 0) if improved else (best, stale + 1)
        stopped = stopped or stale >= self.patience
        if value is not None:
            seen, recent = seen + 1, [*list(recent)[-self.window + 1 :], value]
        state[1:] = [best, stale, stopped, seen, list(recent)]
        return best, improved, stale, stopped, seen > self.window and max(recent) - min(recent) < self.spread


class Misses(Taken):
    """Whether a probe (value: 1 for a hit, else 0) is made at all: not after so many misses in a row."""

    fields = "step long, misses long, over boolean"
    names = ("probed", "misses")
    returns = "probed boolean, misses long"

    def __init__(self, keep, most: int = MISSES):
        super().__init__(keep)
        self.most = most

    def start(self):
        return [None, 0, False]

    def take(self, state, step, value):
        if state[2]:
            return False, state[1]
        state[1] = 0 if value else state[1] + 1
        state[2] = state[1] >= self.most
        return True, state[1]


class Quota(Taken):
    """The part a row goes to by its length (value): of the first rows those of a fit length, some to the examples, the next ones to the test."""

    fields = "step long, seen long, fit long"
    names = ("part",)
    returns = "part string"

    def __init__(self, keep, rows: int = ROWS, shortest: int = SHORTEST, longest: int = LONGEST, few: int = FEW, test: int = TEST):
        super().__init__(keep)
        self.rows, self.shortest, self.longest, self.few, self.test = rows, shortest, longest, few, test

    def start(self):
        return [None, 0, 0]

    def take(self, state, step, value):
        state[1] += 1
        if state[1] > self.rows or value is None or not self.shortest <= value <= self.longest:
            return (None,)
        state[2] += 1
        return ("few_shot" if state[2] <= self.few else "test" if state[2] <= self.few + self.test else None,)


def followed(log: DataFrame, kind: type[Taken], keep: int | None = None, **options) -> DataFrame:
    """log (a stream, or a table): key, step, value. A row for each of them: key, step, late and what the processor tells. keep: milliseconds."""
    schema = f"key {log.schema['key'].dataType.simpleString()}, step long, late boolean, {kind.returns}"
    src = log.selectExpr("key", "CAST(step AS LONG) AS step", "CAST(value AS DOUBLE) AS value")
    return src.groupBy("key").transformWithStateInPandas(kind(keep, **options), schema, "Append", "None" if keep is None else "ProcessingTime")


def run_to_end(stream: DataFrame, at: str, state: str, one_batch: bool = False) -> DataFrame:
    """What the stream gives for all that there is now, as a table below `at`; a later call with the same folders goes on where this one ended.

    A stream whose state has a time to live always has another batch to come, so it doesn't end by itself: one_batch ends it after one.
    """
    spark = stream.sparkSession
    with within(spark):
        stream.writeStream.format("parquet").option("path", at).option("checkpointLocation", state).outputMode("append").trigger(**({"once": True} if one_batch else {"availableNow": True})).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(at)
