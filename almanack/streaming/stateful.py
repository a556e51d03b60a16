"""Keyed state over streams: first seen and strike counts, kept by key with a time-out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_seen(df: DataFrame, key: str, time: str = "ts", hours: int | None = None) -> DataFrame:
    """For each batch and key: key, first_seen (the least time ever met), n (rows so far). A key is forgotten ``hours`` after its last row, if that is given (for streams without an end: time-outs keep a query alive)."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, n = state.get if state.exists else (None, 0)
        for frame in frames:
            low = frame[time].min()
            first = low.value if first is None else min(first, low.value)
            n += len(frame)
        state.update((first, n))
        if hours is not None:
            state.setTimeoutDuration(hours * 3_600_000)
        yield pd.DataFrame({key: [k[0]], "first_seen": [pd.Timestamp(first)], "n": [n]})

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, first_seen timestamp, n long", "first long, n long", "append", GroupStateTimeout.NoTimeout if hours is None else GroupStateTimeout.ProcessingTimeTimeout)


def strikes(df: DataFrame, key: str, outcome: str, transient: list[str], dead_at: int = 3, time: str = "ts") -> DataFrame:
    """For each batch and key: key, strikes, dead. Permanent failures count up, a success resets, transient ones do nothing; rows of a batch in order of time."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for value in pd.concat(list(frames)).sort_values(time, kind="stable")[outcome]:
            if value == "ok":
                n = 0
            elif value not in transient:
                n += 1
        state.update((n,))
        yield pd.DataFrame({key: [k[0]], "strikes": [n], "dead": [n >= dead_at]})

    kind = df.schema[key].dataType.simpleString()
    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, strikes long, dead boolean", "n long", "append", GroupStateTimeout.NoTimeout)
