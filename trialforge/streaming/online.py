"""Streams of samples: windows of a trial as they arrive, and a recursion with a history per node kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Count and sum of value per event_type and tumbling window of ts; rows later than `late` are dropped."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def leaky_history(events: DataFrame, key: str = "user_id", tau: float = 5.0, delay: int = 3) -> DataFrame:
    """key, event_id, value, filtered, delayed: a first-order filter per key, one step per event in event_id order, and its
    value so many steps before, the first value before the start. The filter's value and ring are the key's state."""
    keep = float(np.exp(-1 / tau))

    def work(key_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("event_id")
        if state.exists:
            now, at, ring = state.get
            ring = list(ring)
        else:
            now, at, ring = float(rows["value"].iloc[0]), 0, [float(rows["value"].iloc[0])] * (delay + 1)
        filtered, delayed = [], []
        for x in rows["value"]:
            now = x + (now - x) * keep
            ring[at % (delay + 1)] = now
            filtered.append(now)
            delayed.append(ring[(at - delay) % (delay + 1)])
            at += 1
        state.update((now, at, ring))
        yield pd.DataFrame({key: rows[key], "event_id": rows["event_id"], "value": rows["value"], "filtered": filtered, "delayed": delayed})

    kind = dict(events.dtypes)[key]
    return events.select(key, "event_id", "value").groupBy(key).applyInPandasWithState(work, f"{key} {kind}, event_id long, value double, filtered double, delayed double", "now double, at long, ring array<double>", "append", GroupStateTimeout.NoTimeout)
