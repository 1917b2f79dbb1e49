"""Verification of outputs against witness evidence, as DataFrames over long scores.

Scores are rows (keys, witness_id, t, score). A witness table (witness_id, threshold, context_left,
context_right) is small and fixed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import intervals as iv



def constraints(scores: DataFrame, keys: list[str], witnesses: DataFrame, sizes: DataFrame, peak_ratio: float = 1.0, dilation: int = 8) -> tuple[DataFrame, DataFrame]:
    """(events, allowed): events (keys, witness_id, start, end, peak_t, peak_score, floor) of the observation, and its
    samples with whether an output crossing is allowed there."""
    k = [*keys, "witness_id"]
    rows = scores.join(F.broadcast(witnesses), "witness_id").join(sizes, keys)
    valid = (F.col("t") >= F.col("context_left")) & (F.col("t") < F.col("n") - F.col("context_right"))
    crosses = (F.col("score") >= F.col("threshold")) & valid
    events = iv.components(rows, k, crosses).join(F.broadcast(witnesses.select("witness_id", "threshold")), "witness_id")
    events = events.withColumn("floor", F.greatest("threshold", peak_ratio * F.col("peak_score"))).drop("threshold")
    allowed = iv.dilate(rows, k, crosses, dilation, "allowed").select(*k, "t", (F.col("allowed") | ~valid).alias("allowed"))
    return events, allowed


def verify(output_scores: DataFrame, events: DataFrame, allowed: DataFrame, keys: list[str], witnesses: DataFrame, tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(report, failed, fabricated): a row (keys, witness_id, n_events, n_failed, n_fabricated, passed) for each
    witness, the failed events with their deficits, and runs of crossings that are not allowed."""
    k = [*keys, "witness_id"]
    points = events.select(*k, "start", "end", "floor", F.explode(F.expr("sequence(start, end - 1)")).alias("t"))
    peaks = points.join(output_scores, [*k, "t"]).groupBy(*k, "start", "end", "floor").agg(F.max("score").alias("output_peak"))
    failed = peaks.withColumn("deficit", F.greatest(F.lit(0.0), F.col("floor") - F.col("output_peak") - tolerance)).where("deficit > 0")
    rows = output_scores.join(allowed, [*k, "t"]).join(F.broadcast(witnesses.select("witness_id", "threshold")), "witness_id")
    fabricated = iv.islands(rows, k, (F.col("score") >= F.col("threshold")) & ~F.col("allowed"))
    count = lambda df, n: df.groupBy(*k).agg(F.count("*").alias(n))
    report = output_scores.select(*k).distinct().join(count(events, "n_events"), k, "left").join(count(failed, "n_failed"), k, "left").join(count(fabricated, "n_fabricated"), k, "left").na.fill(0)
    return report.withColumn("passed", (F.col("n_failed") == 0) & (F.col("n_fabricated") == 0)), failed, fabricated


def certificates(report: DataFrame, keys: list[str], required: int) -> DataFrame:
    """(keys, status): passed only if every required witness reported and passed; unverified if one is missing."""
    out = report.groupBy(*keys).agg(F.count("*").alias("n"), F.bool_and("passed").alias("ok"))
    return out.select(*keys, F.when(F.col("n") < required, "unverified").when(F.col("ok"), "passed").otherwise("failed").alias("status"))


def scores_equal(left: DataFrame, right: DataFrame, keys: list[str]) -> bool:
    """Whether two score tables have the same witnesses, samples and exact values."""
    k = [*keys, "witness_id", "t"]
    both = left.join(right.withColumnRenamed("score", "__other"), k, "full_outer")
    return both.where(~F.col("score").eqNullSafe(F.col("__other"))).isEmpty()


def newly_false(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Runs after that meet no run before."""
    from .sets import without_overlap

    return without_overlap(after, before, keys)


def reports_match(report: DataFrame, witnesses: DataFrame) -> bool:
    """Whether reports and constraints speak of the same witnesses."""
    a, b = report.select("witness_id").distinct(), witnesses.select("witness_id").distinct()
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


__all__ = ["constraints", "verify", "certificates", "scores_equal", "newly_false", "reports_match"]
