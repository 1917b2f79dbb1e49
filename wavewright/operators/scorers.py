"""Scorers over packed windows: a registry of deterministic functions signal -> scores, run in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.errors import AuditError

Scorer = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Witness:
    """A scorer with the threshold and warm-up that its claims hold for."""

    witness_id: str
    scorer: Scorer
    threshold: float
    context_left: int = 0
    context_right: int = 0
    model_sha256: str = "none"
    threshold_source: str = "fixed"

    def __post_init__(self):
        if not self.witness_id.strip() or not callable(self.scorer) or not np.isfinite(self.threshold) or min(self.context_left, self.context_right) < 0:
            raise AuditError("a witness needs an id, a scorer, a finite threshold and contexts of at least 0")


def magnitude(x: np.ndarray) -> np.ndarray:
    return np.abs(np.asarray(x, np.float64))


def linear(weights, bias: float = 0.0) -> Scorer:
    w = np.asarray(weights, np.float64)
    return lambda x: kernels.linear_forecast_score(x, w, bias)


#: Scorers without learned weights, by id.
SCORERS: dict[str, Scorer] = {"magnitude": magnitude, "spectral_residual": kernels.spectral_residual, "last_value": linear([1.0]), "mean_of_8": linear(np.full(8, 0.125))}


def register(name: str, scorer: Scorer) -> None:
    SCORERS[name] = scorer


def checked(scorer: Scorer, x: np.ndarray, twice: bool = True) -> np.ndarray:
    """Scores, or AuditError if they are of another length, not finite, or differ between two runs."""
    s = np.asarray(scorer(x), np.float64)
    if s.shape != np.shape(x) or not np.isfinite(s).all():
        raise AuditError("scores differ in shape or are not finite")
    if twice and np.asarray(scorer(x), np.float64).tobytes() != s.tobytes():
        raise AuditError("scorer is not deterministic")
    return s


def score_packed(df: DataFrame, scorer: Scorer | str, values: str = "values", name: str = "scores", twice: bool = False) -> DataFrame:
    """Packed windows with the array of their scores."""
    fn = SCORERS[scorer] if isinstance(scorer, str) else scorer

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([checked(fn, np.asarray(a, np.float64), twice) for a in x])

    return df.withColumn(name, run(values))


def score_once(df: DataFrame, keys: list[str], scorer: Scorer | str, values: str = "values", name: str = "scores") -> DataFrame:
    """As score_packed, but equal windows are scored once: by the digest of their values."""
    digest = F.sha2(F.array_join(F.transform(values, lambda v: v.cast("string")), ","), 256)
    keyed = df.withColumn("__d", digest)
    once = keyed.groupBy("__d").agg(F.first(values).alias(values))
    return keyed.join(score_packed(once, scorer, values, name).drop(values), "__d").drop("__d")


def forecast_scores(df: DataFrame, keys: list[str], order_n: int, value: str = "value", order: str = "t") -> DataFrame:
    """Long samples with ``score``: the squared distance to the mean of the ``order_n`` samples before, 0 for the first
    ``order_n``; window functions only."""
    from ..functions.columns import in_order

    w = in_order(keys, order)
    before = F.avg(value).over(w.rowsBetween(-order_n, -1))
    seen = F.row_number().over(w) - 1
    return df.withColumn("score", F.when(seen < order_n, 0.0).otherwise(F.pow(F.col(value) - before, 2)))


def fit_forecaster(df: DataFrame, order_n: int, values: str = "values", limit: int = 2000) -> tuple[np.ndarray, float]:
    """Weights of a linear causal forecaster over a bounded sample of packed windows (least by digest)."""
    rows = df.select(values, F.xxhash64(values).alias("h")).orderBy("h").limit(limit).toPandas()
    return kernels.fit_linear_forecaster([np.asarray(x, np.float64) for x in rows[values]], order_n)


def filter_packed(df: DataFrame, fn: Callable[..., np.ndarray], values: str = "values", name: str = "output", **options) -> DataFrame:
    """Packed windows through a kernel such as wavelet_shrink or spectral_gate."""

    @F.arrow_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(*packed_rows(through(fn, unpacked_rows(x), **options)))

    return df.withColumn(name, run(F.col(values).cast("array<double>")))


def unpacked_rows(x: pa.Array) -> list[np.ndarray]:
    flat, ends = x.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(x).to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1]) if len(ends) else []


def packed_rows(rows: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Offsets and values of a list array."""
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0), pa.float64())


#: Cells of the matrices that batched kernels are given.
BATCH_CELLS = 1 << 18


def through(fn: Callable[..., np.ndarray], windows: list[np.ndarray], **options) -> list[np.ndarray]:
    """fn of each window; windows of one length go through a batched kernel together."""
    if not getattr(fn, "batched", False):
        return [np.asarray(fn(np.asarray(w, np.float64), **options), np.float64) for w in windows]
    out: list = [None] * len(windows)
    places: dict[int, list[int]] = {}
    for k, w in enumerate(windows):
        places.setdefault(len(w), []).append(k)
    for size, ks in places.items():
        step = max(1, BATCH_CELLS // max(1, size))
        for at in range(0, len(ks), step):
            some = ks[at : at + step]
            for k, row in zip(some, fn(np.stack([np.asarray(windows[k], np.float64) for k in some]), **options), strict=True):
                out[k] = row
    return out


@kernels.batched
def _unchanged(x) -> np.ndarray:
    return np.asarray(x, np.float64)


@kernels.batched
def _mean_of_nine(x) -> np.ndarray:
    return kernels.moving_average(x, 9, "reflect_odd")


#: Denoisers on packed windows, by name.
METHODS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "corrupted_input": _unchanged,
    "median_w3": kernels.median3,
    "moving_average_w9": _mean_of_nine,
    "wavelet_sym4": kernels.wavelet_shrink,
    "spectral_gating": kernels.spectral_gate,
}


def traces(df: DataFrame, keys: list[str], methods: list[str] | None = None, values: str = "observation", timed: bool = False) -> DataFrame:
    """(keys, method, output[, latency_ms]): every window through every method, one pass over the windows."""
    import time

    names = methods or list(METHODS)
    wanted = [*keys, values]

    def run(batches):
        for pdf in batches:
            parts = []
            for m in names:
                out, took = [], []
                for x in pdf[values]:
                    began = time.perf_counter()
                    out.append(METHODS[m](np.asarray(x, np.float64)))
                    took.append((time.perf_counter() - began) * 1e3)
                part = pdf[keys].assign(method=m, output=out)
                parts.append(part.assign(latency_ms=took) if timed else part)
            yield pd.concat(parts, ignore_index=True)

    kinds = dict(df.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", method string, output array<double>" + (", latency_ms double" if timed else "")
    return df.select(*wanted).mapInPandas(run, schema)
