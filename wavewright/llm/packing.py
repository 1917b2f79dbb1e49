"""Variable-capacity best-fit packing of token sequences.

Sequences are dealt by hash into groups of bounded size that are packed independently. Within a group, pieces
go, longest first, into the open bin with the least room that still holds them; if there is none, a bin is opened in
the size of least expected cost a token: each permitted size is filled, as far as it goes, with the pieces still to
come, and costs what the downsized bin would. At the end every bin is downsized to the smallest permitted size that
holds its contents. The permitted sizes are also optimised jointly: the group is packed with these openings and with
each fixed least opening size, and the packing of least total cost stays.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .token_cache import counter

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Cost of a sequence besides its length, in tokens.
OVERHEAD = 32
GROUP_PIECES = 32_768


def least_cost_opening(lengths: Sequence[int], capacities: Sequence[int], overhead: int) -> Callable[[int], int]:
    """The size to open for the piece at a place of lengths (longest first): of least cost a token, larger on ties, if
    the bin takes, longest first, what still fits of the pieces after it."""
    rising = [-n for n in lengths]

    def opening(at: int) -> int:
        best = (float("inf"), 0)
        for c in capacities:
            room = c - lengths[at]
            if room < 0:
                continue
            k = at
            while room and (k := bisect_left(rising, -room, k + 1)) < len(rising):
                room -= lengths[k]
            used = c - room
            cost = (capacities[bisect_left(capacities, used)] + overhead) / used
            if (cost, -c) < best:
                best = (cost, -c)
        return -best[1]

    return opening


def best_fit(lengths: Sequence[int], capacities: Sequence[int], least: int | Callable[[int], int]) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, its offset there, opened size of each bin); lengths longest first, all in
    1..max(capacities). Of bins with equal room the first opened is taken; a new bin has the size that ``least`` gives for
    the piece's place, or the smallest permitted size that is not below ``least`` and holds the piece."""
    rooms, mask = defaultdict(list), 0  # heaps of open bins by room left; mask has a bit for each room that some bin has
    bins, offsets, opened, filled = [], [], [], []
    for at, n in enumerate(lengths):
        reach = mask >> n
        if reach:
            room = (reach & -reach).bit_length() - 1 + n
            b = heappop(rooms[room])
            if not rooms[room]:
                mask ^= 1 << room
        else:
            b = len(opened)
            room = least(at) if callable(least) else next(c for c in capacities if c >= max(n, least))
            opened.append(room)
            filled.append(0)
        bins.append(b)
        offsets.append(filled[b])
        filled[b] += n
        if room > n:
            heappush(rooms[room - n], b)
            mask |= 1 << (room - n)
    return bins, offsets, opened


def pack(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """(bin of each piece, its offset, final size of each bin) of the least cost over openings of least cost and the
    fixed least opening sizes; ties go to the first, then to the larger size."""
    capacities = sorted(capacities)
    best: tuple | None = None
    for least in (least_cost_opening(lengths, capacities, overhead), *reversed(capacities)):
        bins, offsets, opened = best_fit(lengths, capacities, least)
        filled = np.bincount(bins, weights=lengths, minlength=len(opened)).astype(np.int64) if len(opened) else np.zeros(0, np.int64)
        sizes = np.asarray(capacities)[np.searchsorted(capacities, filled)]
        cost = int(sizes.sum()) + overhead * len(sizes)
        if best is None or cost < best[0]:
            best = (cost, bins, offsets, sizes.tolist())
    return best[1:]


def token_lengths(docs: DataFrame, path: str, pattern: str = "", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of whole texts; null is empty. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = counter(path, pattern).count
            yield pa.record_batch([batch.column(0), pa.array([count(t.as_py() or "") for t in batch.column(1)], pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def pack_lengths(lengths: DataFrame, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """(doc_id, n_tokens) -> (doc_id, copy, piece, start, n_tokens, bin_id, bin_offset, capacity).

    Sequences longer than the largest size are cut into full pieces and a rest; no token is dropped. A sequence
    without tokens has one row whose bin_id, bin_offset and capacity are null. Rows repeated with the same id
    and length are copies 1, 2, ... A null id is packed as any other. The result does not depend on how rows are
    partitioned. An empty table gives no rows.
    """
    most = max(capacities)
    counted = lengths.groupBy("doc_id", "n_tokens").agg(F.count("*").alias("copies"))
    copies = counted.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).drop("copies")
    piece = F.explode(F.expr(f"sequence(0L, greatest(0L, cast(ceil(n_tokens / {most}) as bigint) - 1))")).alias("piece")
    pieces = copies.select("doc_id", "copy", piece, F.col("n_tokens").alias("whole"))
    pieces = pieces.select("doc_id", "copy", "piece", (F.col("piece") * most).alias("start"), F.expr(f"least({most}L, whole - piece * {most}L)").alias("n_tokens"))
    pieces = cut(pieces)
    groups = max(1, -(-pieces.where("n_tokens > 0").count() // group_pieces))
    grouped = pieces.where("n_tokens > 0").withColumn("g", F.expr(f"pmod(xxhash64(doc_id, copy, piece), {groups}L)"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "doc_id", "copy", "piece"], ascending=[False, True, True, True], ignore_index=True)
        bins, offsets, sizes = pack(rows["n_tokens"].tolist(), capacities, overhead)
        rows["bin_id"] = [f"{key[0]}-{b}" for b in bins]
        rows["bin_offset"], rows["capacity"] = np.asarray(offsets, np.int64), np.asarray(sizes, np.int64)[bins]
        return rows[["doc_id", "copy", "piece", "start", "n_tokens", "bin_id", "bin_offset", "capacity"]]

    schema = "doc_id long, copy long, piece long, start long, n_tokens long, bin_id string, bin_offset long, capacity long"
    packed = grouped.groupBy("g").applyInPandas(run, schema)
    return packed.unionByName(pieces.where("n_tokens = 0").selectExpr("*", "cast(null as string) bin_id", "cast(null as bigint) bin_offset", "cast(null as bigint) capacity"))


def pack_documents(docs: DataFrame, path: str, pattern: str = "", capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Placements of every document's tokens; see pack_lengths. Null texts have no tokens."""
    return pack_lengths(token_lengths(docs, path, pattern, id_col, text_col), capacities, overhead)
