"""Series, windows and packed rows.

Long form: one row a sample, (keys, t, value). Packed form: one row a window, values in an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import hash_mod, in_order
from ..sources.staging import settled


def number_samples(df: DataFrame, keys: list[str], order: list[str], name: str = "t") -> DataFrame:
    """Rows with their place, from 0, within their series. One series is sorted in one task: see
    number_long_samples for series beyond a task's reach."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def number_long_samples(df: DataFrame, keys: list[str], order: list[str], name: str = "t", slices: int | None = None) -> DataFrame:
    """As number_samples for series of any length: rows are dealt by ranges of (keys, order), each slice of a series
    is numbered by itself, and the counts of the slices before it are added. A long series spans many tasks."""
    spark = df.sparkSession
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *keys, *order).withColumn("__slice", F.spark_partition_id())
    dealt = settled(dealt)  # the slices must stay as they are counted
    counts = dealt.groupBy(*keys, "__slice").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(in_order(keys, "__slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    local = F.row_number().over(Window.partitionBy("__slice", *keys).orderBy(*order)) - 1
    return dealt.withColumn("__local", local).join(offsets, [*keys, "__slice"]).withColumn(name, F.col("__local") + F.col("__before")).drop("__slice", "__local", "__before")


def full_windows(df: DataFrame, keys: list[str], length: int, order: str = "t") -> DataFrame:
    """Samples of the full, non-overlapping windows of ``length``, with window number w and place i in it."""
    w = (F.col(order) / length).cast("long")
    cut = df.withColumn("w", F.floor(w).cast("long")).withColumn("i", (F.col(order) % length).cast("int"))
    return cut.withColumn("__n", F.count("*").over(Window.partitionBy(*keys, "w"))).where(F.col("__n") == length).drop("__n")


def pack(df: DataFrame, keys: list[str], columns: list[str], order: str = "i") -> DataFrame:
    """One row for each key, with an array of each column in order."""
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("__p"))
    return packed.select(*keys, *(F.col(f"__p.{c}").alias(c) for c in columns))


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Packed windows dealt for maps that are dear by the row: into the session's number of shuffle partitions, or a task
    for each core if that is more. A numbered repartition is not coalesced by bytes, of which windows have few."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def unpack(df: DataFrame, keys: list[str], columns: list[str], order: str = "i") -> DataFrame:
    """One row for each element of the arrays."""
    zipped = F.posexplode(F.arrays_zip(*columns)).alias(order, "__z")
    return df.select(*keys, zipped).select(*keys, order, *(F.col(f"__z.{c}").alias(c) for c in columns))


def extract_window(df: DataFrame, keys: list[str], length: int, label: Column, start: int | None = None, order: str = "t") -> DataFrame:
    """The window of each series: around the truncated median place of all labelled samples (the middle of the
    series without any), or at ``start``; held inside the series. Adds ``window_start``."""
    middle = F.coalesce(F.floor(F.expr(f"percentile(case when __l then {order} end, 0.5)")), F.floor(F.count("*") / 2))
    spots = df.withColumn("__l", label).groupBy(*keys).agg(middle.alias("__m"), F.count("*").alias("__n"))
    wanted = F.lit(start) if start is not None else F.col("__m") - length // 2
    spots = spots.select(*keys, F.greatest(F.lit(0), F.least(wanted, F.col("__n") - length)).cast("long").alias("window_start"), (F.col("__n") >= length).alias("__ok")).where("__ok")
    return df.join(spots.drop("__ok"), keys).where((F.col(order) >= F.col("window_start")) & (F.col(order) < F.col("window_start") + length))


def event_windows(events: DataFrame, sizes: DataFrame, keys: list[str], length: int, longest: int | None = None) -> DataFrame:
    """(keys, event_index, start, end) of events -> the window of ``length`` around each: (keys, event_index, event
    start and end, window_start). Events above ``longest`` and series shorter than a window give none. sizes: (keys, n)."""
    rows = events.join(sizes, keys).where(F.col("n") >= length)
    if longest is not None:
        rows = rows.where(F.col("end") - F.col("start") <= longest)
    centre = F.expr("(start + end - 1) div 2")
    return rows.select(*keys, "event_index", F.col("start").alias("event_start"), F.col("end").alias("event_end"), F.greatest(F.lit(0), F.least(centre - length // 2, F.col("n") - length)).cast("long").alias("window_start"))


def normal_prefix_windows(sources: DataFrame, group: str, name: str, digest: str, prefix: str, length: int) -> DataFrame:
    """One window in the normal prefix of each group: of its first source by name, at an offset that the group's
    digest gives: (group, name, window_start)."""
    first = sources.groupBy(group).agg(F.min_by(F.struct(name, digest, prefix), name).alias("s")).select(group, "s.*").where(F.col(prefix) >= length)
    return first.select(group, name, hash_mod(F.col(digest), F.col(prefix) - length + 1).alias("window_start"))


def least_hash_window(windows: DataFrame, group: str, window: str, namespace: str) -> DataFrame:
    """The window of each group with the least SHA-256 of namespace, group and window joined by a bar."""
    rank = F.sha2(F.concat_ws("|", F.lit(namespace), F.col(group).cast("string"), F.col(window).cast("string")), 256)
    return windows.withColumn("digest", rank).groupBy(group).agg(F.min_by(window, F.struct("digest", window)).alias(window), F.min("digest").alias("digest"))


def causal_contexts(df: DataFrame, keys: list[str], length: int, value: str = "value", order: str = "t") -> DataFrame:
    """Samples with ``context``: the ``length`` values before each, oldest first, the series' first value repeated
    where it has not begun."""
    w = in_order(keys, order)
    before = F.collect_list(value).over(w.rowsBetween(-length, -1))
    first = F.first(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("context", F.concat(F.array_repeat(first, (F.lit(length) - F.size(before)).cast("int")), before))


def clamp_request(sizes: DataFrame, start: Column, length: Column, least: int = 64, most: int = 2048) -> DataFrame:
    """Sizes (n) with the length and start that a request is held to."""
    held = F.least(F.greatest(length, F.lit(least)), F.lit(most), F.col("n"))
    return sizes.withColumn("window_length", held).withColumn("window_start", F.greatest(F.lit(0), F.least(start, F.col("n") - F.col("window_length"))))
