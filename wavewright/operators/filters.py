"""Normalisation and filters on long samples, and blends of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import in_order, robust_scale, whole


def scales(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, center, scale) of each window: its median and robust scale."""
    return df.groupBy(*keys).agg(F.expr(f"percentile({value}, 0.5)").alias("center"), robust_scale(value).alias("scale"))


def with_scale(df: DataFrame, keys: list[str], value: str = "value", name: str = "scale") -> DataFrame:
    """Samples with the robust scale of their window: a window aggregate, so the samples are not joined to
    themselves."""
    w = whole(keys)
    quartile = lambda p: F.expr(f"percentile({value}, {p})").over(w)
    return df.withColumn(name, F.greatest((quartile(0.75) - quartile(0.25)) / 1.349, F.stddev_pop(value).over(w), F.lit(1e-4)))


def normalise(df: DataFrame, keys: list[str], columns: list[str], by: str) -> DataFrame:
    """Columns (v - center) / scale, with the statistics of column ``by``; center and scale stay for restoring."""
    out = df.join(scales(df, keys, by), keys)
    return out.withColumns({c: (F.col(c) - F.col("center")) / F.col("scale") for c in columns})


def restore(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c) * F.col("scale") + F.col("center") for c in columns})


def median3(df: DataFrame, keys: list[str], value: str = "value", name: str = "filtered", order: str = "t") -> DataFrame:
    """Median of three with the ends repeated."""
    w, v = in_order(keys, order), F.col(value)
    left, right = F.coalesce(F.lag(v).over(w), v), F.coalesce(F.lead(v).over(w), v)
    return df.withColumn(name, F.greatest(F.least(left, v), F.least(F.greatest(left, v), right)))


def moving_average(df: DataFrame, keys: list[str], width: int, pad: str, value: str = "value", name: str = "filtered", order: str = "t") -> DataFrame:
    """Centred mean over dense samples 0..n-1. pad ``edge``: the ends are repeated, even widths shrink by one;
    ``reflect``: mirrored without the end sample, even widths shrink by one; ``reflect_odd``: mirrored, even widths
    grow by one, at least 3. Samples near an end also stand in for their images beyond it, in one pass: the
    samples are dealt once and never joined to themselves.
    """
    if pad == "reflect_odd":
        width = max(3, width | 1)
    elif width % 2 == 0 and width > 1:
        width -= 1
    half = width // 2
    if half < 1:
        return df.withColumn(name, F.col(value).cast("double"))
    t, last, none = F.col(order), F.col("__last"), F.expr(f"cast(array() as array<{dict(df.dtypes)[order]}>)")
    if pad == "edge":
        left = F.when(t == 0, F.expr(f"transform(sequence(1, {half}), d -> cast(-d as {dict(df.dtypes)[order]}))")).otherwise(none)
        right = F.when(t == last, F.expr(f"transform(sequence(1, {half}), d -> cast({order} + d as {dict(df.dtypes)[order]}))")).otherwise(none)
    else:
        left = F.when(t.between(1, half), F.array(-t)).otherwise(none)
        right = F.when((t < last) & (t >= last - half), F.array(2 * last - t)).otherwise(none)
    spread = df.withColumn("__last", F.max(order).over(whole(keys))).withColumn("__at", F.explode(F.concat(F.array(t), left, right)))
    return spread.withColumn(name, F.avg(value).over(in_order(keys, "__at").rangeBetween(-half, half))).where(F.col("__at") == t).drop("__at", "__last")


def blend(df: DataFrame, observation: str, candidate: str, beta: Column, name: str = "output") -> DataFrame:
    """candidate + beta * (observation - candidate)."""
    return df.withColumn(name, F.col(candidate) + beta * (F.col(observation) - F.col(candidate)))


def interval_action(df: DataFrame, start: Column, end: Column, action: Column, beta: Column, current: str, observation: str, candidate: str, order: str = "t") -> DataFrame:
    """``current`` with one edit in [start, end): accept takes the candidate, protect the observation, blend their
    mix; never the current edit."""
    o, c = F.col(observation), F.col(candidate)
    new = F.when(action == "accept", c).when(action == "protect", o).when(action == "blend", beta * o + (1 - beta) * c)
    return df.withColumn(current, F.when((F.col(order) >= start) & (F.col(order) < end) & new.isNotNull(), new).otherwise(F.col(current)))


def pass_median(df: DataFrame, keys: list[str], value: str = "value", order: str = "t") -> DataFrame:
    """Pointwise median over stochastic passes: (keys, t, value, pass) -> (keys, t, value) and the median absolute
    deviation ``mad``."""
    mid = df.groupBy(*keys, order).agg(F.expr(f"percentile({value}, 0.5)").alias("__m"))
    near = df.join(mid, [*keys, order]).withColumn("__a", F.abs(F.col(value) - F.col("__m")))
    return near.groupBy(*keys, order).agg(F.first("__m").alias(value), F.expr("percentile(__a, 0.5)").alias("mad"))
