"""Streaming forms of operators that look only backward: windowed error rates, and causal scores with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def windowed_rates(stream: DataFrame, keys: list[str], time: str, value: str, threshold: float, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(keys, window, n, crossings, mean) of tumbling event-time windows; later rows than the watermark are left out."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(*keys, F.window(time, width).alias("window")).agg(F.count("*").alias("n"), F.count_if(F.col(value) >= threshold).alias("crossings"), F.avg(value).alias("mean"))


def causal_scores(stream: DataFrame, key: str, value: str, order_n: int = 8, time: str = "ts") -> DataFrame:
    """(key, ts, value, score): the squared distance to the mean of the ``order_n`` values before, 0 until there are so
    many; the values a key still needs are its state. Rows of a batch are taken in time order."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(time, kind="stable")
        scores = []
        for v in rows[value].tolist():
            scores.append(0.0 if len(past) < order_n else float((v - np.mean(past)) ** 2))
            past = [*past, v][-order_n:]
        state.update((past,))
        yield pd.DataFrame({key: k[0], time: rows[time].to_numpy(), value: rows[value].to_numpy(), "score": scores})

    kinds = dict(stream.dtypes)
    schema = f"{key} {kinds[key]}, {time} {kinds[time]}, {value} {kinds[value]}, score double"
    return stream.groupBy(key).applyInPandasWithState(step, schema, "past array<double>", "append", "NoTimeout")
