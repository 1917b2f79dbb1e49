"""The denoiser benchmark as stages: tune, freeze, evaluate, audit. Each reads and writes tables with receipts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.columns import stable_seed
from ..functions.errors import AuditError
from ..operators import corrupt, digests, filters, metrics, scorers, sets, validate, windows
from ..sources import sinks

#: The condition grid.
FAMILIES = ("gaussian", "impulse", "drift", "mixed")
SEVERITIES = (0.25, 0.5, 0.75)
#: Configurations that tuning compares.
WAVELET_GRID = tuple({"wavelet": w, "mode": m, "multiplier": k} for w in ("db2", "db4", "sym4") for m in ("soft", "hard") for k in (0.5, 0.75, 1.0))
SPECTRAL_GRID = tuple({"stationary": s, "decrease": d, "n_fft": n} for s in (True, False) for d in (0.5, 0.75, 1.0) for n in (32, 64))


def conditions(windows_: DataFrame, namespace: str, families=FAMILIES, severities=SEVERITIES, replicates: int = 1) -> DataFrame:
    """Packed windows (group, window_id, values) x the grid, corrupted with seeds that follow from their names."""
    grid = sets.condition_grid(windows_, list(families), list(severities), replicates)
    seed = stable_seed(F.lit(namespace), F.col("window_id").cast("string"), F.col("family"), F.col("severity").cast("string"), F.col("replicate").cast("string"))
    return corrupt.corrupt_packed(grid.withColumn("seed", seed)).withColumn("condition_id", F.concat_ws("|", "window_id", "family", F.col("severity").cast("string"), F.col("replicate").cast("string")))


def tune(conditions_: DataFrame, grid: tuple[dict, ...], kernel: Callable[..., np.ndarray]) -> DataFrame:
    """(config, os_nrmse) of each configuration: error over the observation's scale, mean by group, then over groups.
    All configurations run on a window in one task, so windows are read once."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            references, observed = ([np.asarray(x, np.float64) for x in pdf[c]] for c in ("values", "observation"))
            scales = [float(x[0]) for x in scorers.through(kernels.batched(kernels.robust_scales), observed)]
            for i, config in enumerate(grid):
                made = scorers.through(kernel, observed, **config)
                errors = [float(np.sqrt(np.mean((y - r) ** 2))) / scale for y, r, scale in zip(made, references, scales, strict=True)]
                yield pd.DataFrame({"source_group_id": pdf["source_group_id"].to_numpy(), "config": np.int32(i), "error": errors})

    errors = conditions_.select("source_group_id", "values", "observation").mapInPandas(run, "source_group_id string, config int, error double")
    return metrics.hierarchical_mean(errors, ["source_group_id"], "error", ["config"]).withColumnRenamed("mean", "os_nrmse")


def select(tuned: DataFrame, grid: tuple[dict, ...]) -> dict:
    """The configuration of least error, earlier ones first on ties, with the digest of the choice."""
    best = metrics.grid_argmin(tuned, "os_nrmse", ["config"]).first()
    choice = {"config": grid[best["config"]], "os_nrmse": best["os_nrmse"]}
    return {**choice, "sha256": kernels.json_hash(choice)}


def freeze(tables: dict[str, DataFrame], choices: dict) -> dict:
    """Receipt of every input before evaluation."""
    body = {"inputs": {n: digests.table_digest(t).first()["digest"] for n, t in sorted(tables.items())}, "choices": choices}
    return {**body, "sha256": kernels.json_hash(body)}


def verify_freeze(tables: dict[str, DataFrame], receipt: dict) -> None:
    body = {k: v for k, v in receipt.items() if k != "sha256"}
    if kernels.json_hash(body) != receipt["sha256"] or freeze(tables, receipt["choices"]) != receipt:
        raise AuditError("inputs differ from the frozen receipt")


def waveform_rows(conditions_: DataFrame, methods: list[str] | None = None) -> DataFrame:
    """A row of waveform metrics for each condition and method, from packed windows: one map over the windows
    and array functions, no shuffle."""
    import pandas as pd

    names = methods or list(scorers.METHODS)
    keys = [c for c in ("domain", "condition_id", "source_group_id", "window_id", "family", "severity", "replicate", "identity") if c in conditions_.columns]

    def run(batches):
        for pdf in batches:
            references, observed = ([np.asarray(x, np.float64) for x in pdf[c]] for c in ("values", "observation"))
            labels = [np.asarray(x, bool) for x in pdf["labels"]] if "labels" in pdf else [np.zeros(r.size, bool) for r in references]
            scales = [float(x[0]) for x in scorers.through(kernels.batched(kernels.robust_scales), observed)]
            for m in names:
                rows = []
                for r, o, y, label, scale in zip(references, observed, scorers.through(scorers.METHODS[m], observed), labels, scales, strict=True):
                    e = (y - r) ** 2
                    rows.append((m, float(np.sqrt(e.mean())) / scale, float(np.sqrt(e[label].mean())) / scale if label.any() else None, float(np.sqrt(e.mean())), float(np.abs(y - o).mean()), bool(np.isfinite(y).all()), kernels.array_hash(y)))
                made = pd.DataFrame(rows, columns=["method", "os_nrmse", "anomaly_os_nrmse", "native_rmse", "mean_abs_correction", "finite", "output_sha256"])
                yield pd.concat([pdf[keys].reset_index(drop=True), made], axis=1)

    kinds = dict(conditions_.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", method string, os_nrmse double, anomaly_os_nrmse double, native_rmse double, mean_abs_correction double, finite boolean, output_sha256 string"
    cols = [*keys, "values", "observation", *(["labels"] if "labels" in conditions_.columns else [])]
    return conditions_.select(*cols).mapInPandas(run, schema)


def witness_rows(conditions_: DataFrame, witnesses: list[scorers.Witness], methods: list[str] | None = None, tolerance: int = 8) -> DataFrame:
    """Detector counts for each condition, method and witness (inferred semantics; see metrics.detector_counts)."""
    import pandas as pd

    from ..operators.controller import runs_of

    names = methods or list(scorers.METHODS)
    keys = [c for c in ("domain", "condition_id", "source_group_id") if c in conditions_.columns]

    def run(batches):
        for pdf in batches:
            observed, targets = [np.asarray(x, np.float64) for x in pdf["observation"]], [np.asarray(x, bool) for x in pdf["labels"]]
            outputs = {m: scorers.through(scorers.METHODS[m], observed) for m in names}
            for w in witnesses:
                valid = [np.r_[np.zeros(w.context_left, bool), np.ones(o.size - w.context_left - w.context_right, bool), np.zeros(w.context_right, bool)] for o in observed]
                seen = [(w.scorer(o) >= w.threshold) & v for o, v in zip(observed, valid, strict=True)]
                wide = [np.convolve(x, np.ones(2 * tolerance + 1), "same") > 0 for x in seen]
                for m, made in outputs.items():
                    rows = []
                    for y, s, target, v, near in zip(made, seen, targets, valid, wide, strict=True):
                        mine = (w.scorer(y) >= w.threshold) & v
                        a, b = bool((s & target).any()), bool((mine & target).any())
                        rows.append((m, w.witness_id, int(a), int(b), int(a and not b), sum(not near[x:z].any() for x, z in runs_of(mine))))
                    counts = pd.DataFrame(rows, columns=["method", "scorer", "observation_detectable", "output_detectable", "erased", "output_only"])
                    yield pd.concat([pdf[keys].reset_index(drop=True), counts], axis=1)

    kinds = dict(conditions_.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", method string, scorer string, observation_detectable int, output_detectable int, erased int, output_only int"
    return conditions_.select(*keys, "observation", "labels").mapInPandas(run, schema)


def summary(waveforms: DataFrame) -> DataFrame:
    """(method, overall, anomaly): equal-weight means by condition, group and domain; identity rows do not count."""
    rows = waveforms.where("not identity") if "identity" in waveforms.columns else waveforms
    levels = [c for c in ("domain", "source_group_id") if c in waveforms.columns]
    overall = metrics.hierarchical_mean(rows, levels, "os_nrmse", ["method"]).withColumnRenamed("mean", "overall_os_nrmse")
    anomaly = metrics.hierarchical_mean(rows.where("anomaly_os_nrmse is not null"), levels, "anomaly_os_nrmse", ["method"]).withColumnRenamed("mean", "anomaly_os_nrmse")
    return overall.join(anomaly, "method", "left")


def evidence_summary(witnessed: DataFrame, baseline: str = "corrupted_input") -> DataFrame:
    rows = witnessed.withColumn("kept", F.col("observation_detectable") - F.col("erased"))
    return metrics.pooled_evidence(rows, "method", "kept", "observation_detectable", baseline)


def evaluate(conditions_: DataFrame, witnesses: list[scorers.Witness], path: str) -> dict:
    """Write waveform rows, witness rows and the summary; the receipts of what was written."""
    out = {"waveform_rows": sinks.write_with_receipt(waveform_rows(conditions_), f"{path}/waveform_rows")}
    out["witness_rows"] = sinks.write_with_receipt(witness_rows(conditions_, witnesses), f"{path}/witness_rows")
    spark = conditions_.sparkSession
    out["summary"] = sinks.write_with_receipt(summary(spark.read.parquet(f"{path}/waveform_rows")), f"{path}/summary")
    return out


def audit(spark, receipts: dict) -> None:
    """Read everything again: receipts hold, keys are unique, grids agree, and the summary follows from the rows."""
    for r in receipts.values():
        sinks.verify_receipt(spark, r)
    w, s = spark.read.parquet(receipts["waveform_rows"]["path"]), spark.read.parquet(receipts["summary"]["path"])
    validate.require_unique(w, ["condition_id", "method"])
    v = spark.read.parquet(receipts["witness_rows"]["path"])
    if not sets.grids_equal(w.select("condition_id", "method").distinct(), v.select("condition_id", "method").distinct(), ["condition_id", "method"]):
        raise AuditError("waveform and witness rows differ in their conditions")
    again = parity(summary(w), s, ["method"], {"overall_os_nrmse": 1e-12, "anomaly_os_nrmse": 1e-12})
    validate.require_empty(again, "summary does not follow from its rows")


def parity(found: DataFrame, expected: DataFrame, keys: list[str], tolerances: dict[str, float]) -> DataFrame:
    """Rows in which a metric differs by more than its own tolerance, or that one side lacks."""
    e = expected.select(*keys, *(F.col(c).alias(f"__{c}") for c in tolerances), F.lit(True).alias("__e"))
    both = found.select(*keys, *tolerances, F.lit(True).alias("__f")).join(e, keys, "full_outer")
    off = F.col("__e").isNull() | F.col("__f").isNull()
    for c, tol in tolerances.items():
        off = off | ~F.col(c).eqNullSafe(F.col(f"__{c}")) & ~F.coalesce(F.abs(F.col(c) - F.col(f"__{c}")) <= tol, F.lit(False))
    return both.where(off)


def median_diagnostic(samples: DataFrame, keys: list[str], levels: list[str]) -> DataFrame:
    """Hierarchical error of the median-of-three filter on long samples (reference, observation, label)."""
    out = filters.median3(filters.with_scale(samples, keys, "observation"), keys, "observation", "output")
    rows = metrics.os_nrmse(out, [*levels, *[k for k in keys if k not in levels]], "reference", "output", F.col("label"))
    return metrics.hierarchical_mean(rows, levels, "os_nrmse")


def selected_windows(all_windows: DataFrame) -> DataFrame:
    """One validation window for each group, by least digest."""
    return windows.least_hash_window(all_windows, "source_group_id", "window_id", "benchmark-validation-window")
