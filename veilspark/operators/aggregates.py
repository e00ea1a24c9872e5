"""Aggregates that a caller supplies: a state per group that is added to by batches and merged over partitions.

A metric has four functions: `zero` gives a state, `add` takes a batch of a group's rows, `merge` joins two states and
`result` tells the columns of `schema`. Each task adds up its own states, so only states are shuffled: at most one for each
task and group, or more where a task has over GROUPS groups and hands on what it has.

Defined results: null keys are a group; a group whose values are all null has the result of its zero state; an empty table
gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups whose states a task holds at a time.
GROUPS = 10_000


class Metric(Protocol):
    schema: str

    def zero(self) -> Any: ...
    def add(self, state: Any, rows: pd.DataFrame) -> Any: ...
    def merge(self, a: Any, b: Any) -> Any: ...
    def result(self, state: Any) -> tuple: ...


@dataclass(frozen=True)
class Summary:
    """How many values a column has, their sum, mean, least and greatest."""

    column: str

    @property
    def schema(self) -> str:
        return f"{self.column}_n long, {self.column}_sum double, {self.column}_mean double, {self.column}_min double, {self.column}_max double"

    def zero(self) -> tuple:
        return 0, 0.0, None, None

    def add(self, state: tuple, rows: pd.DataFrame) -> tuple:
        x = rows[self.column].dropna()
        return self.merge(state, (len(x), float(x.sum()), float(x.min()), float(x.max()))) if len(x) else state

    def merge(self, a: tuple, b: tuple) -> tuple:
        if not a[0] or not b[0]:
            return a if a[0] else b
        return a[0] + b[0], a[1] + b[1], min(a[2], b[2]), max(a[3], b[3])

    def result(self, state: tuple) -> tuple:
        n, total, low, high = state
        return n, total, total / n if n else None, low, high


def summarized(df: DataFrame, keys: list[str], *metrics: Metric, groups: int = GROUPS) -> DataFrame:
    """(keys, the metrics' columns): a row for each group. `groups`: how many a task holds at a time."""
    key_types = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name in keys}
    head = ", ".join(f"`{k}` {key_types[k]}" for k in keys)
    names = [c.strip().split()[0] for m in metrics for c in m.schema.split(",")]

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(*k, pickle.dumps(s)) for k, s in held.items()], columns=[*keys, "state"])
            held.clear()
            return out

        for frame in frames:
            for k, rows in frame.groupby(keys, dropna=False, sort=False):
                k = tuple(None if pd.isna(v) else v for v in k)
                states = held.get(k) or [m.zero() for m in metrics]
                held[k] = [m.add(s, rows) for m, s in zip(metrics, states, strict=True)]
            if len(held) > groups:
                yield flush()
        if held:
            yield flush()

    def total(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        states = [m.zero() for m in metrics]
        for raw in rows["state"]:
            states = [m.merge(a, b) for m, a, b in zip(metrics, states, pickle.loads(raw), strict=True)]
        values = [v for m, s in zip(metrics, states, strict=True) for v in m.result(s)]
        return pd.DataFrame([[*(rows[c].iloc[0] for c in keys), *values]], columns=[*keys, *names])

    states = df.mapInPandas(partial, f"{head}, state binary")
    return states.groupBy(*(F.col(k) for k in keys)).applyInPandas(total, f"{head}, {', '.join(m.schema for m in metrics)}")
