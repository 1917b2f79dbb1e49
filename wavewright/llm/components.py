"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: From so many edges on, the least neighbours are written before the join: an aggregate in the join's stage would keep
#: Spark from splitting a node with very many edges. Fewer edges fit one task anyway.
LEAST_SPLIT = 200_000


def _apart(least: DataFrame, n_edges: int) -> DataFrame:
    return cut(least) if n_edges >= LEAST_SPLIT else least


def _large_star(edges: DataFrame, n_edges: int) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = _apart(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), n_edges)
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n_edges: int) -> DataFrame:
    edges = cut(edges) if n_edges >= LEAST_SPLIT else edges
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = _apart(down.groupBy("u").agg(F.min("v").alias("m")), n_edges)
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) edges between long ids -> (node, component): component is the least id reachable.

    Only nodes with an edge appear. Self loops and edges with a null end are ignored. Each round halves
    the depth of the components' trees; every round ends in a table in the checkpoint folder. Per round
    two aggregations with map-side combine and two equi-joins of written tables run; a node with very many edges is
    split among tasks as a skewed key of those joins.
    """
    edges = cut(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v").distinct())
    print_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = print_of(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        edges = cut(_small_star(_large_star(edges, before[0]), before[0]))
        now = print_of(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
