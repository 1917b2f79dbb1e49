"""Paired cluster statistics.

Two forms: ``*_exact`` draws as NumPy's PCG64 does, over one bounded table of cluster means; the scalable form
draws by hash inside the JVM and needs no gathering of clusters.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import unit_of
from ..functions.errors import AuditError
from .sets import paired_values

#: Clusters that the exact forms gather into one task.
MAX_CLUSTERS = 100_000
#: Clusters that hashed sign draws hold in one row.
PIECE = 512


def contributions(left: DataFrame, right: DataFrame, keys: list[str], value: str = "value", relative: bool = False) -> DataFrame:
    """(keys, d): right - left of finite pairs, over |left| if relative (pairs with left about zero are left out)."""
    p = paired_values(left, right, keys, value)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    p = p.where(finite(F.col("left")) & finite(F.col("right")))
    if relative:
        p = p.where(F.abs("left") > 2.220446049250313e-16)
        return p.select(*keys, ((F.col("right") - F.col("left")) / F.abs("left")).alias("d"))
    return p.select(*keys, (F.col("right") - F.col("left")).alias("d"))


def _gathered(d: DataFrame, keys: list[str]) -> DataFrame:
    if d.limit(MAX_CLUSTERS + 1).count() > MAX_CLUSTERS:
        raise AuditError(f"more than {MAX_CLUSTERS} clusters: use the hashed form")
    return d.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.concat_ws("\x00", *keys).alias("k"), "d"))).alias("p")).select(F.col("p.d").alias("d"))


def bootstrap_exact(d: DataFrame, keys: list[str], confidence: float = 0.95, replicates: int = 10_000, seed: int = 2026) -> DataFrame:
    """(estimate, lower, upper, clusters): percentile interval of the mean over resampled clusters in key order."""
    if not 0 < confidence < 1 or replicates < 100:
        raise AuditError("confidence lies in (0, 1) and replicates are at least 100")

    def run(batches):
        for pdf in batches:
            for values in pdf["d"]:
                x = np.asarray(values, np.float64)
                if x.size < 2:
                    raise AuditError("at least two clusters are needed")
                rng, means, step = np.random.default_rng(seed), [], max(1, 4_000_000 // x.size)
                for at in range(0, replicates, step):  # the same stream in bounded pieces
                    means.append(x[rng.integers(0, x.size, size=(min(step, replicates - at), x.size))].mean(axis=1))
                low, high = np.quantile(np.concatenate(means), [(1 - confidence) / 2, 1 - (1 - confidence) / 2])
                yield pd.DataFrame({"estimate": [x.mean()], "lower": [low], "upper": [high], "clusters": [x.size]})

    return _gathered(d, keys).mapInPandas(run, "estimate double, lower double, upper double, clusters long")


def sign_permutation_exact(d: DataFrame, keys: list[str], alternative: str = "two-sided", replicates: int = 100_000, seed: int = 2026) -> DataFrame:
    """(p_value): share of random sign flips at least as extreme, plus one on both counts."""
    if alternative not in ("two-sided", "less", "greater"):
        raise AuditError(f"unknown alternative {alternative!r}")

    def run(batches):
        for pdf in batches:
            for values in pdf["d"]:
                x = np.asarray(values, np.float64)
                if x.size < 2:
                    raise AuditError("at least two clusters are needed")
                rng, seen, beyond, centre = np.random.default_rng(seed), 0, 0, x.mean()
                while seen < replicates:
                    n = min(4096, replicates - seen)
                    null = (rng.choice(np.array([-1.0, 1.0]), size=(n, x.size)) * x).mean(axis=1)
                    beyond += int({"two-sided": np.abs(null) >= abs(centre), "less": null <= centre, "greater": null >= centre}[alternative].sum())
                    seen += n
                yield pd.DataFrame({"p_value": [(beyond + 1) / (replicates + 1)]})

    return _gathered(d, keys).mapInPandas(run, "p_value double")


def _weights(d: DataFrame, keys: list[str], replicates: int, seed: int) -> DataFrame:
    """Every cluster in every replicate with a uniform draw from a digest of seed, replicate and key."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), "r", *keys), 256)
    return d.withColumn("r", F.explode(F.expr(f"sequence(1, {replicates})"))).withColumn("u", unit_of(digest, 1))


def bootstrap_hashed(d: DataFrame, keys: list[str], confidence: float = 0.95, replicates: int = 200, seed: int = 2026) -> DataFrame:
    """(estimate, lower, upper, clusters): as bootstrap_exact with Poisson(1) cluster weights drawn by hash, for
    any number of clusters: one aggregation with map-side combine."""
    u = F.col("u")
    weight, below, term = F.lit(0), 0.0, float(np.exp(-1.0))
    for k in range(1, 12):  # quantile of Poisson(1)
        below += term
        weight = F.when(u >= below, k).otherwise(weight)
        term /= k
    drawn = _weights(d, keys, replicates, seed).withColumn("w", weight.cast("double"))
    means = drawn.groupBy("r").agg((F.sum(F.col("w") * F.col("d")) / F.sum("w")).alias("m"))
    low, high = (1 - confidence) / 2, 1 - (1 - confidence) / 2
    interval = means.agg(F.expr(f"percentile(m, {low!r})").alias("lower"), F.expr(f"percentile(m, {high!r})").alias("upper"))
    return d.agg(F.avg("d").alias("estimate"), F.count("*").alias("clusters")).join(F.broadcast(interval), F.lit(True)).select("estimate", "lower", "upper", "clusters")


def sign_permutation_hashed(d: DataFrame, keys: list[str], replicates: int = 200, seed: int = 2026) -> DataFrame:
    """(p_value), two-sided, with signs drawn by hash: minus where _weights draws below 0.5, which the digest's first hex
    digit tells.

    Clusters are dealt into equal pieces on all tasks, as a table of few clusters is dear all the same; a piece takes
    one replicate after the other, so that its sums stay in the processor's cache.
    """
    tasks = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = tasks * max(1, -(-d.count() // (tasks * PIECE)))
    cluster = F.struct(F.concat_ws("|", F.lit(""), *keys).alias("k"), "d")
    dealt = d.groupBy(F.pmod(F.xxhash64(*keys), F.lit(pieces)).alias("piece")).agg(F.collect_list(cluster).alias("p")).repartition(tasks)
    drawn = dealt.select("p", F.explode(F.expr(f"sequence(1, {replicates})")).alias("r"))
    drawn = drawn.select("r", F.concat(F.lit(f"{seed}|"), F.col("r").cast("string")).alias("head"), F.explode("p").alias("c"))
    minus = F.sha2(F.concat("head", "c.k"), 256) < "8"
    null = drawn.groupBy("r").agg(F.avg(F.when(minus, -F.col("c.d")).otherwise(F.col("c.d"))).alias("m"))
    centre = d.agg(F.abs(F.avg("d")).alias("c"))
    return null.join(F.broadcast(centre), F.lit(True)).agg(((F.count_if(F.abs("m") >= F.col("c")) + 1) / F.lit(replicates + 1.0)).alias("p_value"))


def holm(df: DataFrame, p: str = "p", by: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """Rows with ``p_adjusted``: running maximum of (n - rank + 1) p in order of p, at most 1. A family of tests
    (``by``) is small; it is one window."""
    keys = by or [F.lit(0)]
    w = Window.partitionBy(*keys).orderBy(p, *(ties or []))
    factor = F.count("*").over(Window.partitionBy(*keys)) - F.row_number().over(w) + 1
    out = df.withColumn("__f", factor * F.col(p))
    return out.withColumn("p_adjusted", F.least(F.lit(1.0), F.max("__f").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("__f")


def claim_gate(erasure: DataFrame, rmse: DataFrame, transfer: DataFrame | None = None, margin: float = 0.05) -> DataFrame:
    """One row of interval estimates (estimate, lower, upper) each -> the gate: preservation holds if the erasure
    difference lies below 0, restoration if the relative error increase is at most the margin, transfer if its
    estimate is below 0."""
    if not (np.isfinite(margin) and margin >= 0):
        raise AuditError("the margin is finite and not negative")
    out = erasure.select(F.col("estimate").alias("erasure_estimate"), (F.col("upper") < 0).alias("preservation_pass")).join(
        rmse.select(F.col("estimate").alias("rmse_estimate"), (F.col("upper") <= margin).alias("restoration_pass")), F.lit(True)
    )
    if transfer is None:
        out = out.withColumn("transfer_pass", F.lit(True))
    else:
        out = out.join(transfer.select((F.col("estimate") < 0).alias("transfer_pass")), F.lit(True))
    return out.withColumn("supported", F.col("preservation_pass") & F.col("restoration_pass") & F.col("transfer_pass"))
