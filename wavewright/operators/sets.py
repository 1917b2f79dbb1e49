"""Set operations, splits, top-k by hash, duplicate and disjointness checks, pairings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.errors import AuditError
from .validate import require_empty


def require_disjoint(left: DataFrame, right: DataFrame, on: list[str], what: str = "sets") -> None:
    require_empty(left.select(*on).intersect(right.select(*on)), f"{what} overlap")


def split_overlaps(assigned: DataFrame, group: str, split: str) -> DataFrame:
    """Groups in more than one split."""
    return assigned.groupBy(group).agg(F.array_sort(F.collect_set(split)).alias("splits")).where("size(splits) > 1")


def except_keys(df: DataFrame, without: DataFrame, on: list[str]) -> DataFrame:
    return df.join(without.select(*on), on, "left_anti")


def only_keys(df: DataFrame, having: DataFrame, on: list[str]) -> DataFrame:
    return df.join(having.select(*on), on, "left_semi")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def hash_rank(namespace: str | int, key: Column | str) -> Column:
    return F.sha2(F.concat(F.lit(f"{namespace}:"), F.col(key).cast("string") if isinstance(key, str) else key.cast("string")), 256)


def top_by_hash(df: DataFrame, key: str, k: int, namespace: str | int, by: list[str] | None = None) -> DataFrame:
    """The k distinct keys of least hash (of each ``by``): (by, key, digest, place from 1). Spark keeps k rows a task
    before the final ranking."""
    rows = df.select(*(by or []), key).distinct().withColumn("digest", hash_rank(namespace, key))
    if not by:
        w = Window.orderBy("digest", key)
        return rows.orderBy("digest", key).limit(k).withColumn("place", F.row_number().over(w))
    w = Window.partitionBy(*by).orderBy("digest", key)
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def assign_splits(sources: DataFrame, fraction: float, seed: int, group: str = "source_group_id") -> DataFrame:
    """(group, split, reason): groups with an evaluation file are test, with a tuning file validation; of the rest
    the first by hash fill validation to ceil(fraction * development groups), the others train."""
    if not 0 < fraction < 1:
        raise AuditError("the validation fraction lies in (0, 1)")
    facts = sources.groupBy(group).agg(F.bool_or(F.col("official_split") == "evaluation").alias("e"), F.bool_or(F.col("official_split") == "tuning").alias("t"))
    facts = facts.withColumn("digest", hash_rank(seed, group))
    development, fixed = facts.agg(F.count_if(~F.col("e")), F.count_if(~F.col("e") & F.col("t"))).first()
    extra = max(0, max(1, -int(-development * fraction // 1)) - fixed)
    fill = facts.where("not e and not t").orderBy("digest").limit(extra).select(group, F.lit(True).alias("__fill"))
    out = facts.join(fill, group, "left")
    split = F.when(F.col("e"), "test").when(F.col("t") | F.col("__fill"), "validation").otherwise("train")
    reason = F.when(F.col("e"), "official evaluation file").when(F.col("t"), "official tuning file").when(F.col("__fill"), "validation fill by hash").otherwise("development")
    return out.select(group, split.alias("split"), reason.alias("reason"))


def paired_values(left: DataFrame, right: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, left, right); AuditError naming a key that one side lacks."""
    both = left.select(*keys, F.col(value).alias("left"), F.lit(1).alias("__l")).join(right.select(*keys, F.col(value).alias("right"), F.lit(1).alias("__r")), keys, "full_outer")
    require_empty(both.where("__l is null or __r is null").select(*keys, F.when(F.col("__l").isNull(), "left").otherwise("right").alias("missing")), "keys differ")
    return both.drop("__l", "__r")


def grids_equal(left: DataFrame, right: DataFrame, keys: list[str]) -> bool:
    a, b = left.select(*keys), right.select(*keys)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def mismatches(expected: DataFrame, actual: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Keys whose digests differ or that one side lacks: (keys, expected, actual)."""
    both = expected.select(*keys, F.col(digest).alias("expected")).join(actual.select(*keys, F.col(digest).alias("actual")), keys, "full_outer")
    return both.where(~F.col("expected").eqNullSafe(F.col("actual")))


def expand(conditions: DataFrame, *dimensions: DataFrame) -> DataFrame:
    """Every condition with every row of small, fixed dimension tables (methods, scorers, families, severities)."""
    out = conditions
    for d in dimensions:
        out = out.join(F.broadcast(d), F.lit(True))
    return out


def condition_grid(windows: DataFrame, families: list[str], severities: list[float], replicates: int = 1) -> DataFrame:
    """Windows x families x severities x replicates."""
    cell = F.explode(F.expr(f"sequence(0, {replicates - 1})"))
    return windows.withColumn("family", F.explode(F.array(*map(F.lit, families)))).withColumn("severity", F.explode(F.array(*map(F.lit, severities)))).withColumn("replicate", cell)


def overlapping(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of intervals that overlap, within one key: (keys, start, end, other_start, other_end)."""
    r = right.select(*keys, F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    return left.select(*keys, "start", "end").join(r, keys).where("start < other_end and other_start < end")


def without_overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals that meet none of the other side's."""
    hit = overlapping(left, right, keys).select(*keys, "start", "end").distinct()
    return left.join(hit, [*keys, "start", "end"], "left_anti")


def nearest_match(left: DataFrame, right: DataFrame, keys: list[str], radius: int, same: str = "polarity", at: str = "t") -> DataFrame:
    """Each left point with the nearest right point of the same kind within the radius, ties to the lower: left rows,
    match_t and distance (null without one). Each side is dealt by (keys, block of the radius), so only neighbouring
    blocks meet."""
    block = F.floor(F.col(at) / radius).cast("long")
    r = right.select(*keys, F.col(same).alias("__same"), F.col(at).alias("match_t"), block.alias("__b"))
    l_ = left.withColumn("__b", F.explode(F.array(block - 1, block, block + 1))).withColumn("__same", F.col(same))
    near = l_.join(r, [*keys, "__b", "__same"]).withColumn("distance", F.abs(F.col(at) - F.col("match_t"))).where(F.col("distance") <= radius)
    best = near.groupBy(*keys, at, same).agg(F.min(F.struct("distance", "match_t")).alias("__m")).select(*keys, at, same, "__m.match_t", "__m.distance")
    return left.join(best, [*keys, at, same], "left")


def first_rows(df: DataFrame, order: list[str], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def bounded_cases(df: DataFrame, case: str, least: int, k: int) -> DataFrame:
    """Samples of the first k cases, by name, with at least ``least`` samples."""
    kept = df.groupBy(case).agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(case).limit(k)
    return df.join(kept.select(case), case, "left_semi")


def newest(df: DataFrame, order: Column, k: int, ttl: Column | None = None) -> DataFrame:
    """The k newest rows that have not expired."""
    return (df if ttl is None else df.where(ttl)).orderBy(order.desc()).limit(k)


def selected_files(files: DataFrame, parts: list[str], k: int, name: str = "file_name") -> DataFrame:
    """The first k files by name that contain one of the parts, without regard to case."""
    low = F.lower(name)
    hit = F.lit(not parts)
    for p in parts:
        hit = hit | low.contains(p.lower())
    return files.where(hit).orderBy(name).limit(k)
