"""SimHash near-dedup with verified similarity: one document of each group of near copies.

A text is the set of its five-word shingles; equal sets collapse to one node. At a Jaccard similarity of 0.8 two SimHash
fingerprints differ in about 15 % of their bits, which no split of 64 bits into blocks can find, so a node has ``WORDS``
fingerprints, and nodes are dealt into shards by bands of bits drawn from all of them (``plan`` says how many). Each shard
holds a BK-tree of the first fingerprints, probes follow its edges within ``RADIUS``, and pairs within ``WIDE`` bits of
the first ``SENT`` fingerprints are candidates. Every candidate is measured on its whole sets before it links. First each
node meets two candidates, the least of the close ones and the nearest, which joins most groups at linear cost. Then the areas that candidates of all
shards connect, and that still hold several components, are searched by trees of their own: a node is dealt once for its
area and not for each band, sets go only to the shards that measure them, and tasks write only links that connect, so
pairs are never written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, partitions_for
from .components import connected_components
from .simhash import BKForest, _union, keep_least, links_of_repeats, pairs_of_pieces

WIDTH, SIMILAR = 5, 0.8
#: Fingerprints of a set, and those that travel with a band.
WORDS, SENT = 16, 3
#: Bands of bits at least, and bits of a band at least.
BANDS, LEAST_BITS = 64, 10
#: Unlike texts that a shard holds in the mean, about; bands get a bit more when the texts double.
CROWD = 64
#: Bits in which the first fingerprints of a candidate pair may differ, and the first ``SENT``. At 0.8 about 15 % differ
#: (angle of the sets' vectors: cosine 0.89), of 64 bits 10 in the mean with a deviation of 3, of 192 bits 29 with 5; sets
#: of few shingles come near 12 and 36. Of unlike texts half the bits differ, 96 of 192 with a deviation of 7.
RADIUS, WIDE = 26, 66
#: Bits in which the first ``SENT`` fingerprints of close candidates may differ.
CLOSE = 45
#: Bits in which all fingerprints of a pair that is measured may differ: at 0.8 about 154 of 1024 with a deviation of 11,
#: for sets of few shingles up to 192 with 13.
WIDEST = 290
#: Members of a shard's tree; larger shards are cut into pieces, each pair of which is a shard of its own.
SHARD_LIMIT = 8192
#: Pieces of an area at most, each of a quarter of ``SHARD_LIMIT``, as its pairs are measured; larger areas are dealt by bands.
MOST_PIECES = 16
#: Shingles of a shard's tree, for the same reason, and of a task's shards in the mean.
SHARD_SHINGLES = 8_000_000
#: Up to so many nodes with a candidate, their ids are broadcast to find their texts; else the texts are shuffled.
MOST_BROADCAST = 1_000_000
#: Up to so many edges, one task joins them.
MOST_EDGES = 1_000_000
_SPAN = 1 << 10
_MULTIPLIERS = np.random.default_rng(5).integers(0, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS, _FACTORS = np.random.default_rng(6).integers(0, 2**63, (2, 1, WORDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: The eight bits of a byte, each in a byte of its own.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's five-word shingles: ASCII lower case, words between ASCII
    white space. A text with fewer words is one shingle, a wordless one has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WIDTH:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    of = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - WIDTH + 1
    h = np.zeros(n, np.uint64)
    for k in range(WIDTH):
        h = (h ^ of[k : k + n]) * _MULTIPLIERS[k]
        h ^= h >> np.uint64(29)
    return np.unique(h)


def fingerprints(found: np.ndarray) -> np.ndarray:
    """``WORDS`` 64-bit SimHashes of a set of shingle hashes, each by a mixing of its own; zeros for an empty set."""
    counts = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(found), 255):  # a lane counts to 255; memory is bounded for very long texts
        h = (found[at : at + 255, None] ^ _MASKS) * _FACTORS
        h = (h ^ (h >> np.uint64(32))) * _MIX
        h ^= h >> np.uint64(29)
        counts += _LANES[h.astype("<u8").view(np.uint8)].sum(axis=0).astype("<u8").view(np.uint8)
    return np.packbits(2 * counts > len(found), bitorder="little").view("<u8")


def plan(n: int) -> tuple[int, int]:
    """(bands, bits of a band) for n texts: of bits that agree with probability 0.83, less than at a similarity of 0.8
    (0.85), one band agrees with probability 0.999."""
    bits = max(LEAST_BITS, round(float(np.log2(max(n, 1) / CROWD))))
    return max(BANDS, int(np.ceil(np.log(0.001) / np.log1p(-(0.83**bits))))), bits


def keys_of(fps: np.ndarray, n_bands: int, bits: int) -> np.ndarray:
    """Fingerprints (n, WORDS) -> the key of each band (n, n_bands): its number and its bits."""
    at = np.stack([np.random.default_rng((7, k)).permutation(64 * WORDS)[:bits] for k in range(n_bands)])
    out = np.empty((len(fps), n_bands), np.int64)
    for i in range(0, len(fps), 512):
        b = np.unpackbits(np.ascontiguousarray(fps[i : i + 512], "<u8").view(np.uint8), axis=1, bitorder="little")
        out[i : i + 512] = b[:, at].astype(np.int64) @ (np.int64(1) << np.arange(bits))
    return out | (np.arange(n_bands, dtype=np.int64) << 40)


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each of ``BANDS`` bands of a set; none for an empty set."""
    return keys_of(fingerprints(found)[None], BANDS, LEAST_BITS)[0] if len(found) else np.zeros(0, np.int64)


def _of_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest of the set, n shingles, fingerprints): one row per input row."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests, sizes, fps = [], [], []
        for t in batch.column(1):
            found = shingles(t.as_py())
            digests.append(xxhash.xxh128_digest(found.tobytes()))
            sizes.append(len(found))
            fps.append(fingerprints(found).view(np.int64))
        columns = [batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(fps, pa.list_(pa.int64()))]
        return pa.record_batch(columns, names=["doc_id", "digest", "n", "fps"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id long, digest binary, n long, fps array<long>", of)


def _sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of the documents named by nodes, each set of a node once."""
    n = nodes.count()
    wanted = nodes.withColumnRenamed("node", "__node")
    picked = docs.join(F.broadcast(wanted) if n <= MOST_BROADCAST else wanted, docs[id_col].cast("long") == F.col("__node")).select("__node", F.col(text_col).cast("string").alias("text"))

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), pa.array([shingles(t.as_py()).view(np.int64) for t in batch.column(1)], pa.list_(pa.int64()))], names=["node", "shingles"])

    sets = cut(arrow_map(picked, "node long, shingles array<long>", of))
    return sets if sets.count() == n else cut(sets.distinct())


def _near_in_all(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes within ``WIDEST`` bits in all fingerprints; classes holds (node, n, fps)."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        apart = np.bitwise_count(_words(batch.column(2)) ^ _words(batch.column(3))).sum(axis=1, dtype=np.int64)
        return batch.select([0, 1]).filter(pa.array(apart <= WIDEST))

    fps = lambda end: classes.select(F.col("node").alias(end), F.col("fps").alias(f"of_{end}"))
    return arrow_map(pairs.join(fps("u"), "u").join(fps("v"), "v").select("u", "v", "of_u", "of_v"), "u long, v long", of)


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes whose whole sets have the similarity."""
    joined = pairs.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v").join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
    both = joined.select("u", "v", F.size(F.array_intersect("a", "b")).alias("both"), (F.size("a") + F.size("b")).alias("sum"))
    return both.where(F.col("both") >= F.lit(SIMILAR) * (F.col("sum") - F.col("both"))).select("u", "v")


def _in_bands(classes: DataFrame, n_bands: int, bits: int) -> DataFrame:
    """(key, node, a, b, c) of each band of each node that has shingles; a, b, c are its first fingerprints."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = _words(batch.column(1))
        columns = [pa.array(keys_of(fps, n_bands, bits).ravel()), *(pa.array(np.repeat(x, n_bands)) for x in (batch.column(0).to_numpy(), *fps[:, :SENT].view(np.int64).T))]
        return pa.record_batch(columns, names=["key", "node", "a", "b", "c"])

    return arrow_map(classes.where("n > 0").select("node", "fps"), "key long, node long, a long, b long, c long", of)


def _words(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, WORDS)


def _probe_all(shard: np.ndarray, fps: np.ndarray, role: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (probe, tree member) within ``RADIUS``, so many at once that they fit memory; shard is dense."""
    trees, probes = np.flatnonzero(role != 2), np.flatnonzero(role != 1)
    forest = BKForest(shard[trees], fps[trees])
    forest.root = np.r_[forest.root, np.full(int(shard.max()) + 1 - len(forest.root), -1)]
    load = np.cumsum(np.bincount(shard[trees], minlength=int(shard.max()) + 1)[shard[probes]])
    at = 0
    while at < len(probes):
        end = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + 1_000_000)))
        some = probes[at:end]
        i, j = forest.probe(shard[some], fps[some], RADIUS)
        yield some[i], trees[j]
        at = end


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, node, a, b, c, role) of whole shards -> (node, group, close, nearest, apart) of the nodes with a candidate:
    the group that the task's candidates connect, the node's least close candidate or itself, and its nearest in bits."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    shard = np.unique(table["shard"].to_numpy(), return_inverse=True)[1]
    ids, node = np.unique(table["node"].to_numpy(), return_inverse=True)
    fps = [table[c].to_numpy().view(np.uint64) for c in "abc"]
    n = len(ids)
    group, close, nearest = np.arange(n), np.arange(n), np.full(n, (64 * SENT + 1) * n)
    for i, j in _probe_all(shard, fps[0], table["role"].to_numpy()):
        apart = sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int64) for x in fps)
        keep = (apart <= WIDE) & (node[i] != node[j])
        i, j, apart = node[i[keep]], node[j[keep]], apart[keep]
        for x, y in ((i, j), (j, i)):
            np.minimum.at(close, x[apart <= CLOSE], y[apart <= CLOSE])
            np.minimum.at(nearest, x, apart * n + y)
        group = _union(group, i, j)
    apart, nearest = np.divmod(nearest, n)
    hit = apart <= WIDE
    columns = [ids, ids[group], ids[close], ids[nearest], apart]
    yield pa.record_batch([pa.array(c[hit]) for c in columns], names=["node", "group", "close", "nearest", "apart"])


def _members(classes: DataFrame, n_bands: int, bits: int, n: int, shard_limit: int) -> DataFrame:
    """(node, group, close, nearest, apart) of the candidates of each task's shards; see _candidates."""
    rows, columns = _in_bands(classes, n_bands, bits), ["node", "a", "b", "c"]
    large = cut(rows.groupBy("key").count().where(F.col("count") > shard_limit).select("key", F.ceil(F.col("count") / shard_limit).cast("long").alias("pieces")))
    if large.isEmpty():
        dealt = rows.select(F.xxhash64("key").alias("shard"), *columns, F.lit(0).alias("role"))
    else:
        small = rows.join(F.broadcast(large), "key", "left_anti").select(F.xxhash64("key").alias("shard"), *columns, F.lit(0).alias("role"))
        dealt = small.union(pairs_of_pieces(rows.join(F.broadcast(large), "key"), "key", columns))
    return dealt.repartition(partitions_for(classes.sparkSession, n * n_bands, 1_000_000), "shard").mapInArrow(_candidates, "node long, group long, close long, nearest long, apart long")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) -> a spanning forest of the task's edges."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    u, v = (np.concatenate([b.column(k).to_numpy() for b in batches]) for k in range(2))
    ids, at = np.unique(np.r_[u, v], return_inverse=True)
    label = _union(np.arange(len(ids)), at[: len(u)], at[len(u) :])
    linked = np.flatnonzero(label != np.arange(len(ids)))
    yield pa.record_batch([pa.array(ids[label[linked]]), pa.array(ids[linked])], names=["u", "v"])


def _chains(members: DataFrame, n_partitions: int) -> DataFrame:
    """(u, v) that connect the nodes of members as their groups do: about an edge a node, not one for each task."""
    edges = members.where("node <> group").select(F.col("group").alias("u"), F.col("node").alias("v"))
    edges = cut(edges.repartition(n_partitions, "v").mapInArrow(_forest, "u long, v long"))
    return cut(edges.coalesce(max(1, -(-edges.count() // MOST_EDGES))).mapInArrow(_forest, "u long, v long"))


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (u, v) -> (node, component) of their ends."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    u, v = (np.concatenate([b.column(k).to_numpy() for b in batches]) for k in range(2))
    ids, at = np.unique(np.r_[u, v], return_inverse=True)
    label = _union(np.arange(len(ids)), at[: len(u)], at[len(u) :])
    yield pa.record_batch([pa.array(ids), pa.array(ids[label])], names=["node", "component"])


def _components(edges: DataFrame) -> DataFrame:
    """connected_components(edges); up to ``MOST_EDGES`` in one task, as each round of the stars writes files for every
    partition."""
    edges = cut(edges.where("u <> v"))
    if edges.count() > MOST_EDGES:
        return connected_components(edges)
    return edges.coalesce(1).mapInArrow(_labels, "node long, component long")


def _open(chains: DataFrame, placed: DataFrame) -> DataFrame:
    """(node, component, area) of the nodes whose area, that is what chains connect, holds several components; placed
    holds (node, component) of all nodes of chains."""
    of = lambda end: placed.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    between = chains.join(of("u"), "u").join(of("v"), "v").select(F.col("of_u").alias("u"), F.col("of_v").alias("v"))
    areas = _components(between).select(F.col("node").alias("component"), F.col("component").alias("area"))
    return cut(placed.join(areas, "component"))


def _keyed(open_: DataFrame, classes: DataFrame, limit: int, plan_of: tuple[int, int]) -> DataFrame:
    """(key, node, component, band): rows of open_ with their area as key and band -1, or for the bands of a large area a key
    each, where its members with equal bits are of several components."""
    large = cut(open_.groupBy("area").count().where(F.col("count") > MOST_PIECES * limit).select("area"))
    if large.isEmpty():
        return open_.select(F.col("area").alias("key"), "node", "component", F.lit(-1).cast("long").alias("band"))

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [np.repeat(batch.column(k).to_numpy(), plan_of[0]) for k in range(3)]
        return pa.record_batch([pa.array(c) for c in (*columns, keys_of(_words(batch.column(3)), *plan_of).ravel())], names=["area", "node", "component", "bits"])

    inside = open_.join(F.broadcast(large), "area").join(classes.select("node", "fps"), "node").select("area", "node", "component", "fps")
    banded = cut(arrow_map(inside, "area long, node long, component long, bits long", of).select(F.xxhash64("area", "bits").alias("key"), "node", "component", F.shiftright("bits", 40).alias("band")))
    mixed = banded.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("key")
    small = open_.join(F.broadcast(large), "area", "left_anti")
    return small.select(F.col("area").alias("key"), "node", "component", F.lit(-1).cast("long").alias("band")).union(banded.join(mixed, "key", "left_semi"))


def _pairs_to_measure(table: pa.Table, label: np.ndarray, plan_of: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of different components, near in size and in all fingerprints; in shards of a band, only those for which
    it is the first that they agree on. Role 1 only stands in the tree, 2 only probes, 0 does both; members of role 0 share
    no shard with others."""
    shard = np.unique(table["shard"].to_numpy(), return_inverse=True)[1]
    node, role, band, size = (table[c].to_numpy() for c in ("node", "role", "band", "n"))
    words = _words(table["fps"].combine_chunks())
    keys = keys_of(words, *plan_of) if (band >= 0).any() else None
    for i, j in _probe_all(shard, np.ascontiguousarray(words[:, 0]), role):
        keep = ((role[i] == 2) | (node[i] < node[j])) & (label[i] != label[j]) & (np.minimum(size[i], size[j]) >= SIMILAR * np.maximum(size[i], size[j]))
        i, j = i[keep], j[keep]
        keep = sum(np.bitwise_count(words[i, k] ^ words[j, k]).astype(np.int64) for k in range(SENT)) <= WIDE
        i, j = i[keep], j[keep]
        keep = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64) <= WIDEST
        i, j = i[keep], j[keep]
        if keys is not None and len(i):
            keep = (band[i] < 0) | (np.argmax(keys[i] == keys[j], axis=1) == band[i])
            i, j = i[keep], j[keep]
        yield i, j


def _open_rows(batches: Iterator[pa.RecordBatch], plan_of: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, key, node, n, component, fps, role, band) of whole shards -> (key, node) of the rows with a pair to measure."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    wanted = np.zeros(table.num_rows, bool)
    for i, j in _pairs_to_measure(table, table["component"].to_numpy(), plan_of):
        wanted[i] = wanted[j] = True
    yield pa.record_batch([pa.array(table[c].to_numpy()[wanted]) for c in ("key", "node")], names=["key", "node"])


def _shard_links(batches: Iterator[pa.RecordBatch], plan_of: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, node, n, component, fps, role, band, shingles) of whole shards -> links (u, v) that connect what
    similar pairs of different components connect.

    A pair is not measured once it is connected, so a task writes no more links than members.
    """
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    node = table["node"].to_numpy()
    label = np.unique(table["component"].to_numpy(), return_inverse=True)[1]
    lists = table["shingles"].combine_chunks()
    flat, ends = lists.flatten().to_numpy().view(np.uint64), np.cumsum([0, *pc.list_value_length(lists).to_pylist()])
    size = np.diff(ends)
    us, vs = [], []
    for i, j in _pairs_to_measure(table, label, plan_of):
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        for who, start, stop in zip(*_groups(i), strict=True):
            others = j[start:stop]
            others = others[label[others] != label[who]]
            mine = flat[ends[who] : ends[who + 1]]
            for part in np.split(others, np.flatnonzero(np.diff(np.cumsum(size[others]) // _SPAN**2)) + 1):
                if not len(part):
                    continue
                both = np.add.reduceat(_is_in(np.concatenate([flat[ends[o] : ends[o + 1]] for o in part]), mine), np.cumsum([0, *size[part[:-1]]])) if len(mine) else np.zeros(len(part))
                for o in part[both >= SIMILAR * (size[part] + len(mine) - both)].tolist():
                    if label[o] != label[who]:
                        us.append(node[who])
                        vs.append(node[o])
                        label[label == label[o]] = label[who]
    yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def _groups(x: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """(value, start, stop) of each run of equal values."""
    edges = np.flatnonzero(np.r_[True, np.diff(x) != 0]) if len(x) else np.zeros(0, np.int64)
    return x[edges].tolist(), edges.tolist(), np.r_[edges[1:], len(x)].tolist() if len(x) else []


def _is_in(x: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_set, x), len(sorted_set) - 1)
    return (sorted_set[at] == x).astype(np.int64)


def _deal_open(rows: DataFrame, columns: list[str], shard_limit: int, shingles: Column) -> DataFrame:
    """Rows (key, columns) dealt by shards of one key, or of two pieces of a large one."""
    pieces = F.greatest(F.ceil(F.count("*") / shard_limit), F.ceil(F.sum(shingles) / SHARD_SHINGLES)).cast("long")
    load = cut(rows.groupBy("key").agg(pieces.alias("pieces"), F.sum(shingles).alias("shingles")))
    large = load.where("pieces > 1").select("key", "pieces")
    small = rows.join(large, "key", "left_anti") if not large.isEmpty() else rows
    dealt = small.select(F.xxhash64("key").alias("shard"), *columns, F.lit(0).alias("role"))
    if not large.isEmpty():
        dealt = dealt.union(pairs_of_pieces(rows.join(large, "key"), "key", columns))
    sent = load.agg(F.sum(F.col("shingles") * F.col("pieces")).cast("long")).first()[0] or 0
    return dealt.repartition(partitions_for(rows.sparkSession, sent, SHARD_SHINGLES), "shard")


def _more_links(open_: DataFrame, classes: DataFrame, sets: DataFrame, shard_limit: int, plan_of: tuple[int, int]) -> DataFrame:
    """(u, v) of the rows (node, component, area) of open areas; classes holds (node, n, fps). Sets are sent only to the shards
    in which a pair of theirs is measured."""
    limit = max(1, shard_limit // 4)
    keyed, columns = _keyed(open_, classes, limit, plan_of), ["key", "node", "n", "component", "band", "fps"]
    wanted = _deal_open(keyed.join(classes, "node"), columns, limit, F.lit(WORDS)).mapInArrow(lambda b: _open_rows(b, plan_of), "key long, node long")
    full = cut(keyed.join(cut(wanted.distinct()), ["key", "node"])).join(classes, "node").join(sets, "node")
    return _deal_open(full, [*columns, "shingles"], limit, F.col("n")).mapInArrow(lambda b: _shard_links(b, plan_of), "u long, v long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """(doc_id, component_id), one row for each row of docs.

    Texts link if the Jaccard similarity of their five-word shingles is at least ``SIMILAR``; component_id is the
    least doc_id reachable over links. Null, empty and wordless texts are equal. A null doc_id gives no id to others
    and has the component of the equal texts (null if none has an id). Repeated rows stay repeated; rows of one doc_id
    with different texts are one document and link those texts. An empty table gives no rows.
    """
    texts = cut(_of_texts(docs, id_col, text_col))
    classes = cut(texts.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("fps").alias("fps")))
    n = classes.count()
    n_bands, bits = plan(n)
    members = cut(_members(classes, n_bands, bits, n, shard_limit))
    best = cut(members.groupBy("node").agg(F.min("close").alias("close"), F.min(F.struct("apart", "nearest"))["nearest"].alias("nearest")))
    sets = _sets(docs, best.select("node"), id_col, text_col)
    pairs = best.select("node", F.explode(F.array("close", "nearest")).alias("other")).where("node <> other")
    pairs = pairs.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()
    links = cut(_similar(cut(_near_in_all(pairs, classes)), sets))
    parts = cut(_components(links))

    placed = cut(best.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    chains = _chains(members, partitions_for(docs.sparkSession, n * n_bands, 1_000_000))
    more = cut(_more_links(_open(chains, placed), classes.select("node", "n", "fps"), sets, shard_limit, (n_bands, bits)))
    found = [x for x in (None if more.isEmpty() else more, links_of_repeats(texts, classes, "digest")) if x is not None]
    if found:
        for x in found:
            links = links.union(x)
        parts = _components(links)
    of_text = classes.join(parts, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    return texts.select("doc_id", "digest").join(of_text, "digest", "left").select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with its columns, whose document is the least of its component, each id once; see keep_least."""
    return keep_least(docs, near_copies(docs, id_col, text_col), id_col)
