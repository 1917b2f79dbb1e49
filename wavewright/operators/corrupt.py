"""Corruption of windows: PCG64 draws on packed rows (exact), or draws by digest inside the JVM (SQL form)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.columns import in_order, unit_of


def corrupt_packed(df: DataFrame, values: str = "values", family: str = "family", severity: str = "severity", seed: str = "seed", name: str = "observation") -> DataFrame:
    """Packed windows with their corrupted values, each by its own family, severity and seed columns."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, f: pd.Series, s: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([kernels.corrupt(a, b, float(c), int(d)).astype(np.float64) for a, b, c, d in zip(x, f, s, k, strict=True)])

    return df.withColumn(name, run(values, family, severity, seed))


def hashed_gaussian(key: Column) -> Column:
    """A standard normal draw from the SHA-256 of a key, by Box and Muller."""
    digest = F.sha2(key, 256)
    u1, u2 = (unit_of(digest, 1) * 4294967296.0 + 1) / 4294967297.0, unit_of(digest, 9)
    return F.sqrt(-2 * F.log(u1)) * F.cos(2 * np.pi * u2)


def hashed_noise(df: DataFrame, keys: list[str], key: Column, severity: float, value: str = "value", name: str = "observation") -> DataFrame:
    """value + 0.25 * severity * scale * a normal draw; needs ``scale``."""
    return df.withColumn(name, F.col(value) + 0.25 * severity * F.col("scale") * hashed_gaussian(key))


def hashed_impulses(df: DataFrame, keys: list[str], key: Column, severity: float, value: str = "value", name: str = "observation") -> DataFrame:
    """Spikes with probability 0.08 * severity, size (1 + 2 severity) scale * U(0.65, 1), either sign; needs ``scale``."""
    digest = F.sha2(key, 256)
    size = (1 + 2 * severity) * F.col("scale") * (0.65 + 0.35 * unit_of(digest, 17))
    spike = F.when(unit_of(digest, 1) < 0.08 * severity, F.when(unit_of(digest, 9) < 0.5, -size).otherwise(size)).otherwise(0.0)
    return df.withColumn(name, F.col(value) + spike)


def hashed_drift(df: DataFrame, keys: list[str], key: Column, severity: float, length: int, value: str = "value", name: str = "observation", order: str = "i") -> DataFrame:
    """A slow tone and an endpoint-detrended random walk (steps drawn by digest); needs ``scale``. The tone's cycles
    and phase come from the digest of the keys."""
    from pyspark.sql import Window

    w = in_order(keys, order)
    window = F.sha2(F.concat_ws("|", F.lit("drift"), *(F.col(k).cast("string") for k in keys)), 256)
    cycles, phase, tau = 0.35 + 0.9 * unit_of(window, 1), np.pi * (2 * unit_of(window, 9) - 1), F.col(order) / (length - 1.0)
    out = df.withColumn("__walk", F.sum(hashed_gaussian(key)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    both = Window.partitionBy(*keys)
    ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = out.withColumn("__flat", F.col("__walk") - (F.first("__walk").over(ends) * (1 - tau) + F.last("__walk").over(ends) * tau))
    rough = F.col("__flat") / F.greatest(F.stddev_pop("__flat").over(both), F.lit(1e-6))
    return out.withColumn(name, F.col(value) + 0.5 * severity * F.col("scale") * (0.8 * F.sin(2 * np.pi * cycles * tau + phase) + 0.2 * rough)).drop("__walk", "__flat")


def prepare_case(df: DataFrame, keys: list[str], length: int, label: Column, key: Column, severity: float) -> DataFrame:
    """The window of each series around its labels, with a noisy observation."""
    from .filters import with_scale
    from .windows import extract_window

    return hashed_noise(with_scale(extract_window(df, keys, length, label), keys), keys, key, severity)
