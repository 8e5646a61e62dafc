"""The stateful rules as Structured Streaming jobs; the batch forms are in operators.state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_ledger(events: DataFrame, time: str, keys: list[str], value: str, late: str = "1 hour") -> DataFrame:
    """Requests and the sum of ``value`` by UTC day and key; events later than ``late`` are dropped by the watermark."""
    day = F.window(time, "1 day").alias("day")
    return events.withWatermark(time, late).groupBy(day, *keys).agg(F.count("*").alias("requests"), F.sum(value).alias("used"))


def failure_streaks(events: DataFrame, key: str, time: str, failed: str) -> DataFrame:
    """key, time, streak after each micro-batch: failures since the last success, state kept for each key alone."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        last = None
        for row in pd.concat(list(frames)).sort_values(time).itertuples(index=False):
            streak = streak + 1 if getattr(row, failed) else 0
            last = getattr(row, time)
        state.update((streak,))
        yield pd.DataFrame({key: [k[0]], time: [last], "streak": [streak]})

    kinds = dict(events.dtypes)
    schema = f"{key} {kinds[key]}, {time} {kinds[time]}, streak long"
    grouped = events.select(key, time, failed).groupBy(key)
    return grouped.applyInPandasWithState(step, schema, "streak long", "update", GroupStateTimeout.NoTimeout)
