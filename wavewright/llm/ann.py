"""Approximate nearest neighbours over learned partitions.

On a bounded sample: the exact nearest-neighbour graph, its balanced partition by recursive bisection
(a split along the graph's second eigenvector, then balanced swaps), and a softmax classifier trained to
predict in which partitions a vector's neighbours lie. The number of partitions a query visits is the least
that finds TARGET of the sample's neighbours. Every row is indexed in its most probable partition; queries go
to several partitions and rerank all of their rows with exact cosines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import by_length, matrix, valid_vectors

#: Bound of the rows that the index is fitted on, least by a hash of the id.
SAMPLE_ROWS = 8192
#: Sample rows that a partition has at least.
PART_SAMPLE = 32
#: Rows of a partition that one task holds; larger partitions are cut into such pieces.
PIECE_ROWS = 16384
QUERY_PIECE = 4096
#: Share of the sample's true neighbours that the visited partitions must hold.
TARGET = 0.96
_TIE = 1e-9


def _unit(m: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled by their largest component first, so that no square overflows or vanishes."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other rows of each row of unit vectors."""
    out = np.zeros((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def bisect(nodes: np.ndarray, x: np.ndarray, graph: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A balanced split of nodes that cuts few edges of the graph: True for one half."""
    place = np.full(len(x), -1, np.int64)
    place[nodes] = np.arange(len(nodes))
    a = np.repeat(np.arange(len(nodes)), graph.shape[1])
    b = place[graph[nodes]].ravel()
    a, b = a[b >= 0], b[b >= 0]
    degree = np.bincount(a, minlength=len(nodes)) + np.bincount(b, minlength=len(nodes)) + 1.0
    v = x[nodes] @ np.linalg.svd(x[nodes] - x[nodes].mean(axis=0), full_matrices=False)[2][0] + 1e-6 * rng.standard_normal(len(nodes))
    for _ in range(60):  # power steps of the lazy walk, away from the constant vector
        v = v - (v * degree).sum() / degree.sum()
        v = (v + np.bincount(a, v[b], len(nodes)) + np.bincount(b, v[a], len(nodes))) / (degree + 1)
        v /= np.abs(v).max() + 1e-300
    side = np.zeros(len(nodes), bool)
    side[np.argsort(v, kind="stable")[len(nodes) // 2 :]] = True
    for _ in range(20):
        cross = side[a] != side[b]
        gain = np.bincount(a, np.where(cross, 1, -1), len(nodes)) + np.bincount(b, np.where(cross, 1, -1), len(nodes))
        left, right = (np.flatnonzero(side == s) for s in (False, True))
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        n = min(len(left), len(right))
        n = min(int((gain[left[:n]] + gain[right[:n]] > 0).sum()) // 2, len(nodes) // 20)
        if not n:
            break
        before = int(cross.sum())
        side[left[:n]], side[right[:n]] = True, False
        if int((side[a] != side[b]).sum()) >= before:
            side[left[:n]], side[right[:n]] = False, True
            break
    return side


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Partition number of each row; parts is a power of two."""
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        halves = [(g, bisect(g, x, graph, rng)) for g in groups]
        groups = [h for g, side in halves for h in (g[~side], g[side])]
    out = np.zeros(len(x), np.int64)
    for p, g in enumerate(groups):
        out[g] = p
    return out


@dataclass(frozen=True)
class Router:
    """A softmax classifier over partitions, and how many of them a query visits."""

    weights: np.ndarray
    bias: np.ndarray
    visits: int

    def logits(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.weights + self.bias

    def home(self, unit: np.ndarray) -> np.ndarray:
        return np.argmax(self.logits(unit), axis=1)

    def visited(self, unit: np.ndarray) -> np.ndarray:
        return np.argsort(-self.logits(unit), axis=1, kind="stable")[:, : self.visits]


def _train(x: np.ndarray, target: np.ndarray, rng: np.random.Generator, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression on soft targets by Adam over the whole sample."""
    x, target = x.astype(np.float32), target.astype(np.float32)
    w = np.concatenate([0.01 * rng.standard_normal((x.shape[1], target.shape[1])), np.zeros((1, target.shape[1]))]).astype(np.float32)
    xb = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = xb @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = xb.T @ (p - target) / len(x) + 1e-5 * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w[:-1].astype(np.float64), w[-1].astype(np.float64)


def parts_for(n: int) -> int:
    """Partitions of n rows, a power of two: one for each 256 rows up to 64, then one for each 65,536 rows up to one for
    each ``PART_SAMPLE`` rows of the sample, beyond which the sample could not tell them apart."""
    few, many = (1 << max(0, (n // rows).bit_length() - 1) for rows in (256, 1 << 16))
    return max(min(few, 64), min(many, SAMPLE_ROWS // PART_SAMPLE))


def fit_router(sample: np.ndarray, parts: int, k: int = 5, target: float = TARGET, seed: int = 0) -> Router:
    """Fit on unit vectors. visits is measured as rows will be indexed: each in its most probable partition."""
    rng = np.random.default_rng(seed)
    x = np.unique(sample, axis=0)
    x = x[rng.permutation(len(x))]
    parts = min(parts, 1 << max(0, (len(x) // PART_SAMPLE).bit_length() - 1))
    if parts < 2:
        return Router(np.zeros((sample.shape[1], 1)), np.zeros(1), 1)
    graph = neighbour_graph(x, min(10, len(x) - 1))
    home = balanced_partition(x, graph, parts, rng)
    soft = np.zeros((len(x), parts))
    np.add.at(soft, (np.repeat(np.arange(len(x)), graph.shape[1]), home[graph].ravel()), 1.0)
    soft[np.arange(len(x)), home] += 2
    w, b = _train(x, soft / soft.sum(axis=1, keepdims=True), rng)
    router = Router(w, b, parts)
    near = neighbour_graph(x, min(k, len(x) - 1))
    order = np.argsort(-router.logits(x), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None], axis=1)
    found = np.take_along_axis(place, router.home(x)[near], axis=1)  # rank, for each row, of its neighbours' partitions
    share = np.cumsum(np.bincount(found.ravel(), minlength=parts)) / found.size
    return Router(w, b, int(np.searchsorted(share, target) + 1))


def cosines(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows in double precision; the same pair gives the same bits wherever it is computed."""
    q, c = q / np.abs(q).max(axis=1, keepdims=True), c / np.abs(c).max(axis=1, keepdims=True)
    return (q * c).sum(axis=1) / (np.sqrt((q * q).sum(axis=1)) * np.sqrt((c * c).sum(axis=1)))


def _rerank(k: int):
    """A piece of a partition and the queries that visit it -> each query's k nearest of the piece."""

    def run(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(c):
            qs, cs = np.stack(q["v"].to_numpy()), np.stack(c["v"].to_numpy())
            q_ids, ids = q["vec_id"].to_numpy(np.int64), c["vec_id"].to_numpy(np.int64)
            by_id = np.argsort(ids, kind="stable")
            ids, cs = ids[by_id], cs[by_id]
            cu, first = _unit(cs), np.flatnonzero(np.r_[True, np.diff(ids) != 0])
            for at in range(0, len(qs), 256):
                s = _unit(qs[at : at + 256]) @ cu.T
                s[q_ids[at : at + 256, None] == ids[None]] = -np.inf
                of_id = s if len(first) == len(ids) else np.maximum.reduceat(s, first, axis=1)  # a repeated id counts once, by its best vector
                kth = np.partition(of_id, of_id.shape[1] - k, axis=1)[:, -k] if of_id.shape[1] > k else np.full(len(s), -2.0)
                who, which = np.nonzero(s >= np.maximum(kth, -2.0)[:, None] - _TIE)
                exact = np.concatenate([cosines(qs[at + who[i : i + 100_000]], cs[which[i : i + 100_000]]) for i in range(0, len(who), 100_000)] or [np.zeros(0)])
                order = np.lexsort((-exact, ids[which], who))
                who, which, exact = who[order], which[order], exact[order]
                one = np.r_[True, (np.diff(who) != 0) | (np.diff(ids[which]) != 0)] if len(who) else np.zeros(0, bool)
                who, which, exact = who[one], which[one], exact[one]
                order = np.lexsort((ids[which], -exact, who))
                who, which, exact = who[order], which[order], exact[order]
                best = np.arange(len(who)) - np.searchsorted(who, who) < k
                out.append(pd.DataFrame({"query_id": q_ids[at + who[best]], "vec_id": ids[which[best]], "score": exact[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    return run


def _route(routers: dict[int, Router], queries: bool):
    """Rows (vec_id, v) -> (part, dim, vec_id, v): the row's home, or each partition that it visits as a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, rows in by_length(pa.Table.from_batches([batch])):
                unit = _unit(matrix(rows["v"]))
                part = routers[d].visited(unit) if queries else routers[d].home(unit)[:, None]
                n = part.shape[1]
                again = rows.take(pa.array(np.repeat(np.arange(len(unit)), n)))
                for b in again.append_column("part", pa.array(part.ravel())).append_column("dim", pa.array([d] * len(again), pa.int32())).select(["part", "dim", "vec_id", "v"]).to_batches():
                    yield b

    return run


def nearest(table: DataFrame, is_query: str, k: int = 5, parts: int | None = None, target: float = TARGET, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query by cosine, ties to smaller ids.

    Candidates are all rows but the query's own. Null, empty, zero and non-finite vectors and null ids take no
    part; vectors meet only vectors of their own length. A query whose visited partitions hold fewer than k
    candidates while the table has more visits all partitions instead. A repeated id counts once, with the best score
    of any of its vectors; so does a repeated query. An empty table gives no rows.

    A partition goes to as many tasks as its pieces and the queries that visit it fill. The sample bounds the number of
    partitions, so with a fixed share of queries that work ends up as rows times visiting queries, which visits keep down.
    """
    spark = table.sparkSession
    rows = valid_vectors(table, id_col, vec_col, nonzero=True).withColumn("dim", F.size("v"))
    sizes = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    routers = {}
    for d, n in sizes.items():
        some = rows.where(F.col("dim") == d).select("v", F.xxhash64("vec_id", F.lit(11)).alias("h"))
        if n > 4 * SAMPLE_ROWS:  # a first cut by hash, so that tasks send few rows on
            some = some.where(F.col("h") < int(2**64 * 4 * SAMPLE_ROWS / n) - 2**63)
        sample = some.orderBy("h").limit(SAMPLE_ROWS).toPandas()
        routers[d] = fit_router(_unit(np.stack(sample["v"].to_numpy())), parts or parts_for(n), k, target)
    if not routers:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    schema = "part long, dim int, vec_id long, v array<double>"
    index = cut(rows.select("vec_id", "v").mapInArrow(_route(routers, False), schema))
    asked = rows.where(is_query).select("vec_id", "v").distinct()
    visits = asked.mapInArrow(_route(routers, True), schema)
    piece_of = F.expr("pmod(monotonically_increasing_id(), pieces)").alias("piece")  # by place in the written index, so that repeated rows are spread
    pieces = index.groupBy("part", "dim").agg(F.expr(f"cast(ceil(count(*) / {PIECE_ROWS}) as bigint)").alias("pieces"))

    def found_in(visits: DataFrame) -> DataFrame:
        """Pieces meet the queries that visit them, in query groups of bounded size; a piece is copied once for each
        group that its own partition has, and not at all if nobody visits it."""
        asks = visits.groupBy("part", "dim").agg(F.expr(f"cast(ceil(count(*) / {QUERY_PIECE}) as bigint)").alias("q_groups"))
        plan = F.broadcast(cut(pieces.join(asks, ["part", "dim"])))  # a row for each partition: the router's size bounds it
        group = F.expr("pmod(xxhash64(vec_id, v, 9), q_groups)").alias("q_group")
        c = index.join(plan, ["part", "dim"]).select("part", "dim", piece_of, F.explode(F.expr("sequence(0L, q_groups - 1)")).alias("q_group"), "vec_id", "v")
        q = visits.join(plan, ["part", "dim"]).select("part", "dim", F.explode(F.expr("sequence(0L, pieces - 1)")).alias("piece"), group, "vec_id", "v")
        key = ["part", "dim", "piece", "q_group"]
        return q.groupBy(*key).cogroup(c.groupBy(*key)).applyInPandas(_rerank(k), "query_id long, vec_id long, score double")

    def once(found: DataFrame) -> DataFrame:
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    found = cut(once(found_in(visits)))
    counts = found.groupBy("query_id").agg(F.count("*").alias("n"))
    few = asked.join(counts, F.col("vec_id") == F.col("query_id"), "left").where(F.coalesce("n", F.lit(0)) < k).select("vec_id", "v")
    if not (few := cut(few)).isEmpty():
        everywhere = {d: Router(r.weights, r.bias, r.weights.shape[1]) for d, r in routers.items()}
        again = found_in(few.mapInArrow(_route(everywhere, True), schema))
        found = found.join(few.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(once(again))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # at most k rows from each visited piece
    return found.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
