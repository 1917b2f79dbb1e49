"""Concern cues: how a candidate changed scores and shapes, and how far passes disagree. Window functions and
equi-joins on long samples; no Python."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip01, in_order
from ..functions.errors import AuditError
from . import filters, metrics
from . import intervals as iv

#: Decimal digits of a concern that count against the limits; later ones hang on the order of the terms of its sums.
DIGITS = 12


@dataclass(frozen=True)
class CueSettings:
    """Weights, scales and display limits."""

    score_weight: float = 0.50
    morphology_weight: float = 0.30
    uncertainty_weight: float = 0.20
    score_scale: float = 0.30
    morphology_scale: float = 1.00
    uncertainty_scale: float = 0.12
    medium: float = 0.32
    high: float = 0.62
    match_radius: int = 8
    smoothing: int = 7

    def __post_init__(self):
        weights = (self.score_weight, self.morphology_weight, self.uncertainty_weight)
        if min(weights) < 0 or sum(weights) <= 0 or min(self.score_scale, self.morphology_scale, self.uncertainty_scale) <= 0:
            raise AuditError("weights are not negative with a positive sum, scales are positive")
        if not 0 <= self.medium < self.high <= 1 or self.match_radius < 1 or self.smoothing < 1:
            raise AuditError("0 <= medium < high <= 1; radius and smoothing are positive")


#: Settings of the live view.
LIVE = CueSettings(score_weight=0.625, morphology_weight=0.375, uncertainty_weight=0.0)


def morphology(df: DataFrame, keys: list[str], observation: str = "observation", candidate: str = "candidate", radius: int = 8, order: str = "t") -> DataFrame:
    """Samples with ``morphology`` in [0, 1]: amplitude change, and triangles around extrema that moved, changed,
    vanished or appeared. Matches are looked up in a frame of the radius around each sample, so the samples are
    dealt by their window once and nothing is joined."""
    t, around = F.col(order), in_order(keys, order).rangeBetween(-radius, radius)
    out = filters.with_scale(df, keys, observation, "__scale")
    for src, name in ((observation, "__so"), (candidate, "__sc")):
        out = filters.moving_average(out, keys, 5, "edge", src, name, order)
    out = out.withColumn("__po", iv.polarity(keys, "__so", F.col("__scale"), order)).withColumn("__pc", iv.polarity(keys, "__sc", F.col("__scale"), order))
    there = F.collect_list(F.when(F.col("__pc").isNotNull(), F.struct(t.alias("at"), F.col("__pc").alias("kind"), F.col(candidate).alias("c")))).over(around)
    out = out.withColumn("__there", there)
    same = F.filter("__there", lambda x: x["kind"] == F.col("__po"))
    best = F.array_min(F.transform(same, lambda x: F.struct(F.abs(x["at"] - t).alias("d"), x["at"].alias("at"), x["c"].alias("c"))))
    out = out.withColumn("__match", F.when(F.col("__po").isNotNull(), best))
    amplitude = F.least(F.abs(F.col("__match.c") - F.col(observation)) / F.col("__scale"), F.lit(1.0))
    old = F.when(F.col("__po").isNotNull(), F.when(F.col("__match").isNull(), 1.0).otherwise(0.55 * amplitude + 0.45 * F.col("__match.d") / radius))
    out = out.withColumn("__taken", F.collect_list("__match.at").over(around)).withColumn("__near", F.count("__po").over(around) > 0)
    new = F.when(F.col("__pc").isNotNull() & ~F.array_contains("__taken", t) & ~F.col("__near"), 0.8)  # an extremum of the candidate alone
    out = out.withColumn("__height", F.greatest(old, new))
    peaks = F.collect_list(F.when(F.col("__height").isNotNull(), F.struct(t.alias("at"), F.col("__height").alias("h")))).over(around)
    out = out.withColumn("__peaks", peaks)
    spread = F.aggregate("__peaks", F.lit(0.0), lambda acc, x: F.greatest(acc, x["h"] * (1.0 - F.abs(x["at"] - t) / (radius + 1))))
    base = 0.2 * clip01(F.abs(F.col(candidate) - F.col(observation)) / F.col("__scale"))
    return out.withColumn("morphology", clip01(F.greatest(base, spread))).drop("__scale", "__so", "__sc", "__po", "__pc", "__there", "__match", "__taken", "__near", "__height", "__peaks")


def concern(df: DataFrame, keys: list[str], settings: CueSettings | None = None, order: str = "t") -> DataFrame:
    """Samples (observation, candidate, score_before, score_after, mad) with score_delta, suppression, emergence,
    morphology, uncertainty, concern and level. A concern that equals a limit up to the last bits of its sums reaches it.
    """
    s = settings or CueSettings()
    delta = F.col("score_after") - F.col("score_before")
    out = morphology(df, keys, radius=s.match_radius, order=order).withColumn("score_delta", delta)
    out = out.withColumns({
        "score_change": clip01(F.abs(delta) / s.score_scale), "suppression": clip01(-delta / s.score_scale), "emergence": clip01(delta / s.score_scale),
        "morphology": clip01(F.col("morphology") / s.morphology_scale), "uncertainty": clip01(F.col("mad") / s.uncertainty_scale),
    })
    total = s.score_weight + s.morphology_weight + s.uncertainty_weight
    mixed = (s.score_weight * F.col("score_change") + s.morphology_weight * F.col("morphology") + s.uncertainty_weight * F.col("uncertainty")) / total
    out = filters.moving_average(out.withColumn("__c", mixed), keys, s.smoothing, "edge", "__c", "concern", order).drop("__c")
    out = out.withColumn("concern", clip01(F.col("concern")))
    graded = F.round("concern", DIGITS)
    return out.withColumn("level", F.when(graded >= s.high, "high").when(graded >= s.medium, "medium").otherwise("low"))


def concern_intervals(df: DataFrame, keys: list[str], order: str = "t") -> DataFrame:
    """(keys, start, end, peak, mean, dominant_cue, level) of runs above low."""
    cue = {"score change": "score_change", "morphology": "morphology", "stochastic disagreement": "uncertainty"}
    runs = metrics.interval_summary(df, keys, F.col("level") != "low", "concern", cue, order, {"__high": F.bool_or(F.col("level") == "high")})
    return runs.withColumn("level", F.when(F.col("__high"), "high").otherwise("medium")).drop("__high")


def replay_cues(df: DataFrame, threshold: float, scale: float) -> DataFrame:
    """Samples with score_cue and signal_cue: changes over the threshold and over three scales, in [0, 1]."""
    score = clip01(F.abs(F.col("score_after") - F.col("score_before")) / max(threshold, 1e-12))
    signal = clip01(F.abs(F.col("candidate") - F.col("observation")) / max(3 * scale, 1e-12))
    return df.withColumns({"score_cue": score, "signal_cue": signal})
