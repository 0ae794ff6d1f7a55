"""User-defined aggregates that merge: partial states in the map side, merged by key.

An aggregate is a class with four methods.  A state may be anything that can
be pickled and should stay of bounded size:

    init()                  an empty state
    update(state, values)   the state with an array of values (a NumPy array, without nulls)
    merge(a, b)             one state of two
    finish(state)           the result, a number or None
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys whose states a task holds before it sends them on.
HELD = 50_000
#: States of a key are merged in so many parts first, so that no task gets one from each task of the map side.
PARTS = 16


class Aggregate(Protocol):
    def init(self) -> Any: ...
    def update(self, state: Any, values: np.ndarray) -> Any: ...
    def merge(self, a: Any, b: Any) -> Any: ...
    def finish(self, state: Any) -> float | None: ...


class Range:
    """Largest less smallest; null without values."""

    def init(self):
        return None

    def update(self, state, values):
        own = (float(values.min()), float(values.max()))
        return own if state is None else self.merge(state, own)

    def merge(self, a, b):
        if a is None or b is None:
            return a or b
        return min(a[0], b[0]), max(a[1], b[1])

    def finish(self, state):
        return None if state is None else state[1] - state[0]


class Mean:
    """Mean by the sum and the number of values; null without values."""

    def init(self):
        return 0.0, 0

    def update(self, state, values):
        return state[0] + float(values.sum()), state[1] + len(values)

    def merge(self, a, b):
        return a[0] + b[0], a[1] + b[1]

    def finish(self, state):
        return state[0] / state[1] if state[1] else None


class TrimmedMean:
    """Mean without the k smallest and the k largest values; null for 2 k values or fewer."""

    def __init__(self, k: int):
        self.k = k

    def init(self):
        return 0.0, 0, np.zeros(0), np.zeros(0)

    def update(self, state, values):
        return self.merge(state, (float(values.sum()), len(values), values, values))

    def merge(self, a, b):
        low, high = np.sort(np.concatenate([a[2], b[2]])), np.sort(np.concatenate([a[3], b[3]]))
        return a[0] + b[0], a[1] + b[1], low[: self.k], high[max(len(high) - self.k, 0) :]

    def finish(self, state):
        total, n, low, high = state
        return (total - float(low.sum()) - float(high.sum())) / (n - 2 * self.k) if n > 2 * self.k else None


def aggregate(df: DataFrame, aggregates: dict[str, tuple[Aggregate, str]], *keys: str) -> DataFrame:
    """(keys, one column for each name): the named aggregates, each of a column of numbers.

    Nulls do not reach an aggregate; NaN do.  A group without values has what
    ``finish(init())`` gives; null keys are a group; an empty table has no
    rows, also without keys.  States are merged in an order that may differ
    between runs.
    """
    names = [f"k{i}_" for i in range(len(keys))]
    columns = [f"v{i}_" for i in range(len(aggregates))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], *[F.col(c).cast("double").alias(v) for (_, c), v in zip(aggregates.values(), columns, strict=True)])
    if not keys:
        names, rows = ["k0_"], rows.withColumn("k0_", F.lit(0))
    made = [a for a, _ in aggregates.values()]
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        types: list[pa.DataType] = []

        def sent() -> pa.RecordBatch:
            cols = [pa.array([k[i] for k in held], types[i]) for i in range(len(names))]
            return pa.RecordBatch.from_arrays([*cols, pa.array([pickle.dumps(s) for s in held.values()], pa.binary())], [*names, "state"])

        for batch in batches:
            if not batch.num_rows:
                continue
            types[:] = [batch.schema.field(n).type for n in names]
            of = list(zip(*[batch[n].to_pylist() for n in names], strict=True))
            places = {k: i for i, k in enumerate(dict.fromkeys(of))}
            group = np.fromiter((places[k] for k in of), np.int64, len(of))
            order = np.argsort(group, kind="stable")
            cuts = np.searchsorted(group[order], np.arange(len(places) + 1))
            values = [batch[v].to_numpy(zero_copy_only=False)[order] for v in columns]
            there = [~batch[v].is_null().to_numpy(zero_copy_only=False)[order] for v in columns]
            for k, i in places.items():
                states = held.setdefault(k, [a.init() for a in made])
                cut = slice(cuts[i], cuts[i + 1])
                for j, a in enumerate(made):
                    x = values[j][cut][there[j][cut]]
                    if len(x):
                        states[j] = a.update(states[j], x)
            if len(held) >= HELD:
                yield sent()
                held.clear()
        if held:
            yield sent()

    def merged(states: pd.Series) -> list:
        out = [a.init() for a in made]
        for s in states:
            out = [a.merge(x, y) for a, x, y in zip(made, out, pickle.loads(s), strict=True)]
        return out

    def middle(part: pd.DataFrame) -> pd.DataFrame:
        return part.iloc[:1].assign(state=[pickle.dumps(merged(part["state"]))])[[*names, "state"]]

    def last(part: pd.DataFrame) -> pd.DataFrame:
        done = [a.finish(s) for a, s in zip(made, merged(part["state"]), strict=True)]
        return part.iloc[:1][names].assign(**{v: [None if x is None else float(x)] for v, x in zip(columns, done, strict=True)})

    states = rows.mapInArrow(partial, f"{kinds}, state binary").withColumn("part_", F.spark_partition_id() % PARTS)
    states = states.groupBy(*names, "part_").applyInPandas(middle, f"{kinds}, state binary")
    out = states.groupBy(*names).applyInPandas(last, f"{kinds}, " + ", ".join(f"{v} double" for v in columns))
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=False)], *[F.col(v).alias(n) for n, v in zip(aggregates, columns, strict=True)])
