"""Interval algebra over (keys, t) samples and (keys, start, end) intervals.

Intervals are half-open unless a name says inclusive. Every operator carries its keys through its joins and
windows, so one key's rows are all that a task must see together, and interval joins are equi-joins on the
keys with the overlap as a residual condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import in_order


def islands(df: DataFrame, keys: list[str], flag: Column, order: str = "t") -> DataFrame:
    """(keys, start, end): maximal runs of consecutive samples where flag holds."""
    on = df.where(flag)
    run = F.col(order) - F.row_number().over(in_order(keys, order))
    return on.select(*keys, order, run.alias("__run")).groupBy(*keys, "__run").agg(F.min(order).alias("start"), (F.max(order) + 1).alias("end")).drop("__run")


def islands_inclusive(df: DataFrame, keys: list[str], flag: Column, order: str = "t") -> DataFrame:
    """(keys, start, stop): as islands, with the last sample in the interval."""
    return islands(df, keys, flag, order).withColumn("stop", F.col("end") - 1).drop("end")


def numbered(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals with event_index from 0 in order of start."""
    return intervals.withColumn("event_index", F.row_number().over(in_order(keys, "start")) - 1)


def dilate(df: DataFrame, keys: list[str], flag: Column, radius: int, name: str = "dilated", order: str = "t") -> DataFrame:
    """Samples with a flag that holds within ``radius`` of one where ``flag`` holds."""
    around = in_order(keys, order).rangeBetween(-radius, radius)
    return df.withColumn(name, F.max(F.coalesce(flag, F.lit(False))).over(around))


def merge(intervals: DataFrame, keys: list[str], gap: int = 0) -> DataFrame:
    """Union of intervals: those that overlap, touch or lie up to ``gap`` apart become one."""
    before = in_order(keys, "start").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.col("start") > F.max("end").over(before) + gap, F.lit(True)).cast("int")
    group = F.sum("__b").over(in_order(keys, "start").rowsBetween(Window.unboundedPreceding, 0))
    marked = intervals.withColumn("__b", begins).withColumn("__g", group)
    return marked.groupBy(*keys, "__g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__g")


def merge_buffered(events: DataFrame, keys: list[str], buffer: int, length: Column) -> DataFrame:
    """Inclusive events (start, stop) widened by half the buffer on both sides, merged where they then touch or
    overlap, and held inside 0..length-1 at the outer ends."""
    half = buffer // 2
    wide = events.select(*keys, (F.col("start") - half).alias("start"), (F.col("stop") + half + 1).alias("end"), length.alias("__n"))
    sizes = wide.groupBy(*keys).agg(F.max("__n").alias("__n"))
    out = merge(wide.drop("__n"), keys, gap=-1).join(sizes, keys)
    return out.select(*keys, F.greatest("start", F.lit(0)).alias("start"), (F.least("end", "__n") - 1).alias("stop"))


def distances(events: DataFrame, keys: list[str], reach: int, order: str) -> DataFrame:
    """Places outside an event and at most ``reach`` from it: (keys, t, distance). Made from the events outward, so
    no pair of sample and event is tried in vain."""
    steps = F.explode(F.expr(f"sequence(1, {reach})")).alias("distance")
    sides = events.select(*keys, "start", "end", steps)
    left = sides.select(*keys, (F.col("start") - F.col("distance")).alias(order), "distance")
    right = sides.select(*keys, (F.col("end") - 1 + F.col("distance")).alias(order), "distance")
    return left.union(right)


def extend_labels(df: DataFrame, keys: list[str], label: Column, buffer: int, order: str = "t") -> DataFrame:
    """Samples with ``extended``: 1 on labels, and from each event outward to half the buffer sqrt(1 - distance /
    buffer); sums of several events are held at 1."""
    base = F.coalesce(label.cast("double"), F.lit(0.0))
    if buffer // 2 < 1:
        return df.withColumn("extended", base)
    near = distances(islands(df, keys, label, order), keys, buffer // 2, order)
    ramp = near.groupBy(*keys, order).agg(F.sum(F.sqrt(1.0 - F.col("distance") / buffer)).alias("__ramp"))
    return df.join(ramp, [*keys, order], "left").withColumn("extended", F.least(F.lit(1.0), base + F.coalesce("__ramp", F.lit(0.0)))).drop("__ramp")


def soft_labels(df: DataFrame, keys: list[str], label: Column, tolerance: int, order: str = "t") -> DataFrame:
    """Samples with ``soft``: 1 on labels and 1 - distance / (tolerance + 1) around them, the largest of all events."""
    base = F.coalesce(label.cast("double"), F.lit(0.0))
    if tolerance < 1:
        return df.withColumn("soft", base)
    near = distances(islands(df, keys, label, order), keys, tolerance, order)
    best = near.groupBy(*keys, order).agg(F.max(1.0 - F.col("distance") / (tolerance + 1.0)).alias("__soft"))
    return df.join(best, [*keys, order], "left").withColumn("soft", F.greatest(base, F.coalesce("__soft", F.lit(0.0)))).drop("__soft")


def tiles(reasons: DataFrame, keys: list[str], width: int, size: Column) -> DataFrame:
    """(keys, start, end, reason) -> the tiles of ``width`` samples that reasons touch: (keys, tile_start, tile_end,
    reasons sorted)."""
    held = reasons.select(*keys, F.greatest(F.lit(0), "start").alias("start"), F.least(F.col("end"), size).alias("end"), "reason", size.alias("__n")).where("end > start")
    spread = held.select(*keys, "reason", "__n", F.explode(F.expr(f"sequence(start div {width}, (end - 1) div {width})")).alias("__tile"))
    out = spread.groupBy(*keys, "__tile", "__n").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    start = F.col("__tile") * width
    return out.select(*keys, start.alias("tile_start"), F.least(start + width, "__n").alias("tile_end"), "reasons")


def merge_tiles(tiled: DataFrame, keys: list[str]) -> DataFrame:
    """Touching tiles become one interval whose reasons are their union: (keys, start, end, reasons)."""
    w = in_order(keys, "tile_start")
    begins = F.coalesce(F.col("tile_start") != F.lag("tile_end").over(w), F.lit(True)).cast("int")
    marked = tiled.withColumn("__b", begins).withColumn("__g", F.sum("__b").over(w))
    out = marked.groupBy(*keys, "__g").agg(F.min("tile_start").alias("start"), F.max("tile_end").alias("end"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"))
    return out.drop("__g")


def localise_failures(failed: DataFrame, fabricated: DataFrame, keys: list[str], witness: DataFrame, padding: int) -> DataFrame:
    """Failed events and fabricated runs, both (keys, witness_id, start, end), widened by their witness's context and
    the padding: (keys, start, end, reason)."""
    rows = failed.withColumn("what", F.lit("retention")).unionByName(fabricated.withColumn("what", F.lit("fabrication")))
    rows = rows.join(witness.select("witness_id", "context_left", "context_right"), "witness_id")
    return rows.select(*keys, (F.col("start") - F.col("context_left") - padding).alias("start"), (F.col("end") + F.col("context_right") + padding).alias("end"), F.concat_ws(":", "witness_id", "what").alias("reason"))


#: Raised-cosine weights at distances 1 to 8 from an interval.
HALO = (0.96984631, 0.88302222, 0.75, 0.58682412, 0.41317591, 0.25, 0.11697778, 0.03015369)


def halo_weights(df: DataFrame, intervals: DataFrame, keys: list[str], weights: tuple[float, ...] = HALO, order: str = "t") -> DataFrame:
    """Samples with ``weight``: 1 inside an interval, the halo's value at its distance outside, the largest of all
    intervals, 0 elsewhere."""
    spread = F.explode(F.expr(f"sequence(start - {len(weights)}, end - 1 + {len(weights)})")).alias(order)
    at = intervals.select(*keys, "start", "end", spread)
    distance = F.greatest(F.col("start") - F.col(order), F.col(order) - F.col("end") + 1, F.lit(0))
    value = F.element_at(F.array(F.lit(1.0), *map(F.lit, weights)), (distance + 1).cast("int"))
    best = at.withColumn("__w", value).groupBy(*keys, order).agg(F.max("__w").alias("__w"))
    return df.join(best, [*keys, order], "left").withColumn("weight", F.coalesce("__w", F.lit(0.0))).drop("__w")


def beta_runs(df: DataFrame, keys: list[str], beta: str = "beta", order: str = "t") -> DataFrame:
    """Runs of one positive weight: (keys, start, end, beta, action)."""
    w = in_order(keys, order)
    begins = F.coalesce((F.col(beta) != F.lag(beta).over(w)) | (F.col(order) != F.lag(order).over(w) + 1), F.lit(True)).cast("int")
    marked = df.where(F.col(beta) > 0).withColumn("__b", begins).withColumn("__g", F.sum("__b").over(w))
    out = marked.groupBy(*keys, "__g").agg(F.min(order).alias("start"), (F.max(order) + 1).alias("end"), F.first(beta).alias("beta")).drop("__g")
    return out.withColumn("action", F.when(F.col("beta") == 1.0, "protect").otherwise("blend"))


def runs_with_reasons(runs: DataFrame, tiled: DataFrame, keys: list[str]) -> DataFrame:
    """Runs with the union of the reasons of the tiles that they overlap."""
    hit = runs.join(tiled, keys, "left").where("tile_start is null or (tile_start < end and tile_end > start)")
    found = hit.groupBy(*keys, "start", "end").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"))
    return runs.join(found, [*keys, "start", "end"], "left").withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))


def components(df: DataFrame, keys: list[str], flag: Column, score: str = "score", order: str = "t") -> DataFrame:
    """Runs with their peak: (keys, start, end, peak_t, peak_score); of equal peaks the first."""
    run = F.col(order) - F.row_number().over(in_order(keys, order))
    on = df.where(flag).select(*keys, order, score, run.alias("__run"))
    return (
        on.groupBy(*keys, "__run")
        .agg(F.min(order).alias("start"), (F.max(order) + 1).alias("end"), F.max_by(order, F.struct(F.col(score), -F.col(order))).alias("peak_t"), F.max(score).alias("peak_score"))
        .drop("__run")
    )


def polarity(keys: list[str], value: str, scale: Column, order: str = "t") -> Column:
    """+1 where a sample rises by more than a floor of 0.01 scale and then falls by at least it, -1 for the reverse,
    else null; the first and last sample are neither."""
    w = in_order(keys, order)
    left, right, floor = F.col(value) - F.lag(value).over(w), F.lead(value).over(w) - F.col(value), 0.01 * scale
    return F.when((left > floor) & (right <= -floor), 1).when((left < -floor) & (right >= floor), -1)


def local_extrema(df: DataFrame, keys: list[str], value: str, scale: Column, order: str = "t") -> DataFrame:
    """(keys, t, value, polarity) of local extrema."""
    return df.withColumn("polarity", polarity(keys, value, scale, order)).where("polarity is not null").select(*keys, order, value, "polarity")


def spread_peaks(df: DataFrame, peaks: DataFrame, keys: list[str], radius: int, name: str = "spread", order: str = "t") -> DataFrame:
    """Peaks (keys, center, height) as triangles of ``radius``; samples take the largest, 0 without one."""
    at = peaks.select(*keys, "center", "height", F.explode(F.expr(f"sequence(center - {radius}, center + {radius})")).alias(order))
    best = at.groupBy(*keys, order).agg(F.max(F.col("height") * (1.0 - F.abs(F.col(order) - F.col("center")) / (radius + 1))).alias("__s"))
    return df.join(best, [*keys, order], "left").withColumn(name, F.coalesce("__s", F.lit(0.0))).drop("__s")


def certifiable(df: DataFrame, left: int, right: int, size: Column, order: str = "t") -> DataFrame:
    """Samples with ``valid``: outside a scorer's warm-up at either end."""
    return df.withColumn("valid", (F.col(order) >= left) & (F.col(order) < size - right))


def shared_evidence(df: DataFrame, keys: list[str], crossings: list[Column], radius: int = 4, order: str = "t") -> DataFrame:
    """Samples with ``shared``: every witness crosses within ``radius``."""
    for i, c in enumerate(crossings):
        df = dilate(df, keys, c, radius, f"__d{i}", order)
    both = F.lit(True)
    for i in range(len(crossings)):
        both = both & F.col(f"__d{i}")
    return df.withColumn("shared", both).drop(*(f"__d{i}" for i in range(len(crossings))))
