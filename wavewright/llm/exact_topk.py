"""Exact top-k by distributed histogram selection.

Vectors are quantised to integers and dealt into candidate and query blocks of bounded size. Each round scores
everything, counts scores in a histogram over each query's open range, and sums the blocks' counts; the bin
that holds the k-th score becomes the next range, until it holds one integer. A last pass keeps what reaches
that score and breaks ties by smaller id.

A block sends only its topmost bins, up to k scores in all, and at the end its k best rows: the k-th score
over all blocks is at least that of any block, so nothing below can be part of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .vectors import by_length, matrix, valid_vectors

BINS = 1024
BLOCK = 8192
QUERY_BLOCK = 4096
_TILE = 256
_LONG = 2**63 - 1


def quantise(m: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), as doubles: a matrix of whole numbers."""
    return np.floor(scale * m)


def inner(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products as int64. Doubles are exact while sums stay below 2**53; beyond, Python's
    integers are used and a product outside the range of long is held to its end."""
    if not q.size or not c.size or float(np.abs(q).max()) * float(np.abs(c).max()) * q.shape[1] < 2**53:
        return (q @ c.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object)
    return np.clip(whole(q) @ whole(c).T, -_LONG, _LONG).astype(np.int64)


def _pack_blocks(rows: DataFrame, block: str, n: int) -> DataFrame:
    """(block, dim, ids, data): the vectors of a block and length in one row; n partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        for d, part in by_length(table):
            block_of, m, ids = part["block"].to_numpy(), matrix(part["v"]), part["vec_id"].to_numpy()
            for b in np.unique(block_of):
                at = np.flatnonzero(block_of == b)
                if len(np.unique(ids[at])) < len(at):  # repeated ids meet here; the least vector stands for them
                    at = at[np.lexsort((*m[at].T[::-1], ids[at]))]
                    at = at[np.r_[True, np.diff(ids[at]) != 0]]
                yield pa.record_batch(
                    [pa.array([int(b)], pa.int64()), pa.array([d], pa.int32()), pa.array([ids[at].astype("<i8").tobytes()]), pa.array([m[at].astype("<f8").tobytes()])],
                    names=["block", "dim", "ids", "data"],
                )

    dealt = rows.withColumn("block", F.expr(block)).repartition(n, "block")
    return dealt.mapInArrow(run, "block long, dim int, ids binary, data binary")


def _tiles(batches: Iterator[pa.RecordBatch], scale: float):
    """(batch row, query numbers, candidate ids, scores) of tiles of bounded size; a row's own id is left out by
    a score below every other."""
    for batch in batches:
        for row in batch.to_pylist():
            d = row["dim"]
            c, q = (quantise(np.frombuffer(row[x], "<f8").reshape(-1, d), scale) for x in ("data", "q_data"))
            ids, q_ids = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["q_ids"], "<i8")
            for at in range(0, len(q), _TILE):
                some = slice(at, at + _TILE)
                yield row, np.arange(len(q))[some], q_ids[some], ids, inner(q[some], c), q_ids[some, None] == ids[None]


def _histograms(k: int, scale: float):
    """Each pair of blocks -> (query_id, bin, n): the topmost bins, up to k scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, at, q_ids, _, score, own in _tiles(batches, scale):
            lo, width = (np.frombuffer(row[x], "<i8")[at] for x in ("lo", "width"))
            # unsigned, as the distance of two longs can be no long; BINS: above the range
            step = (score.astype(np.uint64) - lo.astype(np.uint64)[:, None]) // width.astype(np.uint64)[:, None]
            bins = np.where(own | (score < lo[:, None]), -1, np.minimum(step, BINS).astype(np.int64))
            who, kept, n = [], [], []
            top = np.sort(bins, axis=1)[:, ::-1][:, :k] if bins.shape[1] > k else bins
            for i in range(len(at)):
                b, m = np.unique(top[i][top[i] >= 0], return_counts=True)
                who.append(np.full(len(b), q_ids[i]))
                kept.append(b)
                n.append(m)
            yield pa.record_batch([pa.array(np.concatenate(x).astype(np.int64)) for x in (who, kept, n)], names=["query_id", "bin", "n"])

    return run


def _selected(k: int, scale: float):
    """Each pair of blocks -> (query_id, vec_id, score): its k best that reach the query's k-th score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, at, q_ids, ids, score, own in _tiles(batches, scale):
            reach = ~own & (score >= np.frombuffer(row["lo"], "<i8")[at][:, None])
            who, which = np.nonzero(reach)
            s = score[who, which]
            order = np.lexsort((ids[which], -s, who))
            who, which, s = who[order], which[order], s[order]
            place = np.arange(len(who)) - np.searchsorted(who, who)
            best = place < k
            yield pa.record_batch([pa.array(q_ids[who[best]]), pa.array(ids[which[best]]), pa.array(s[best])], names=["query_id", "vec_id", "score"])

    return run


def exact_top_k(table: DataFrame, is_query: str, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of floor(scale * x) of each query.

    is_query: a condition on vec_id. Candidates are all rows but the query's own, ties go to smaller ids. Null,
    empty and non-finite vectors and null ids take no part; vectors meet only vectors of their own length.
    A query with fewer than k candidates gets all of them. Rows repeated under one id count once (the least
    vector, if they differ). An empty table gives no rows.
    """
    spark = table.sparkSession
    rows = valid_vectors(table, id_col, vec_col)
    n_rows, n_asked = rows.agg(F.count("*"), F.count_if(F.expr(is_query))).first()
    n_blocks = max(1, -(-n_rows // BLOCK), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n_rows // 512))
    n_query_blocks = max(1, -(-n_asked // QUERY_BLOCK))
    cands = cut(_pack_blocks(rows, f"pmod(xxhash64(vec_id), {n_blocks}L)", n_blocks))
    queries = cut(_pack_blocks(rows.where(is_query), f"pmod(xxhash64(vec_id, 3), {n_query_blocks}L)", n_query_blocks))
    queries = queries.withColumnsRenamed({"block": "q_block", "ids": "q_ids", "data": "q_data"})
    bound = float(cands.mapInArrow(_largest_norm(scale), "norm double").agg(F.max("norm")).first()[0] or 0.0)

    def ask(state: DataFrame, fn, schema: str) -> DataFrame:
        """Every query block, with its queries' ranges, against every candidate block."""
        packed = state.groupBy("q_block", "dim").agg(F.collect_list(F.struct("query_id", "lo", "width")).alias("state"))  # one bounded block's queries
        q = queries.join(packed, ["q_block", "dim"]).mapInArrow(_ordered_range, "dim int, q_ids binary, q_data binary, lo binary, width binary")
        dealt = q.withColumn("block", F.explode(F.expr(f"sequence(0L, {n_blocks - 1}L)")))
        return cands.join(dealt.repartition(n_blocks, "block"), ["block", "dim"]).select("ids", "data", "dim", "q_ids", "q_data", "lo", "width").mapInArrow(fn, schema)

    state = cut(queries.mapInArrow(_first_state(scale, bound), "q_block long, dim int, query_id long, lo long, width long"))
    while not state.where("width > 0").isEmpty():
        counts = ask(state, _histograms(k, scale), "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        from_top = Window.partitionBy("query_id").orderBy(F.desc("bin"))  # at most BINS + 1 rows a query
        reached = counts.withColumn("upto", F.sum("n").over(from_top)).where(f"upto >= {k}").groupBy("query_id").agg(F.max("bin").alias("bin"))
        narrower = F.when(F.col("bin").isNull() | (F.col("width") <= 1), 0).otherwise(F.ceil(F.col("width") / BINS)).cast("long")
        lo = F.when(F.col("bin").isNotNull() & (F.col("width") > 0), F.expr("cast(cast(lo as decimal(38, 0)) + cast(bin as decimal(18, 0)) * cast(width as decimal(18, 0)) as bigint)")).otherwise(F.col("lo"))
        state = cut(state.join(reached, "query_id", "left").select("q_block", "dim", "query_id", lo.alias("lo"), narrower.alias("width")))
    found = ask(state, _selected(k, scale), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # at most k rows from each block
    return found.withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


def _largest_norm(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            norms = [float(np.sqrt((quantise(np.frombuffer(r["data"], "<f8").reshape(-1, r["dim"]), scale) ** 2).sum(axis=1)).max()) for r in batch.to_pylist()]
            yield pa.record_batch([pa.array(norms, pa.float64())], names=["norm"])

    return run


def _first_state(scale: float, bound: float):
    """Each query's first range: by Cauchy and Schwarz no score lies outside +-|q| * bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q = quantise(np.frombuffer(r["q_data"], "<f8").reshape(-1, r["dim"]), scale)
                reach = np.ceil(np.sqrt((q**2).sum(axis=1)) * bound * (1 + 1e-12)) + 1
                beyond = ~(reach < 2.0**62)
                reach = np.where(beyond, 0.0, reach).astype(np.int64)
                reach[beyond] = _LONG
                ids = np.frombuffer(r["q_ids"], "<i8")
                width = (2 * (reach // BINS) + 2).astype(np.int64)
                yield pa.record_batch(
                    [pa.array([r["q_block"]] * len(q), pa.int64()), pa.array([r["dim"]] * len(q), pa.int32()), pa.array(ids), pa.array(-reach), pa.array(width)],
                    names=["q_block", "dim", "query_id", "lo", "width"],
                )

    return run


def _ordered_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            of = {s["query_id"]: (s["lo"], max(1, s["width"])) for s in r["state"]}
            lo, width = zip(*(of[i] for i in np.frombuffer(r["q_ids"], "<i8").tolist()), strict=True)
            cells = [r["dim"], r["q_ids"], r["q_data"], np.array(lo, "<i8").tobytes(), np.array(width, "<i8").tobytes()]
            kinds = [pa.int32(), *[pa.binary()] * 4]
            yield pa.record_batch([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=["dim", "q_ids", "q_data", "lo", "width"])
