"""SimHash near-duplicate detection with Burkhard-Keller trees.

Fingerprints are made in place, without a shuffle, and collapsed to distinct values. A radius r splits
the 64 bits into r + 1 blocks; two fingerprints within the radius agree on one block at least, so the
distinct fingerprints are dealt into shards by (block, value). Each shard holds a BK-tree whose children
are keyed by their Hamming distance to the parent, and a probe follows only edges within the radius of
its own distance. A tree travels by shuffle to the tasks that probe it, not by broadcast: the trees hold the
fingerprints of all documents, which a broadcast would gather on the driver.

A shard above ``SHARD_LIMIT`` is dealt again by blocks of its remaining bits, and what is still too large
is cut into pieces. One piece of each pair probes the tree of the other in a task of the pair's own, so no shard is
gathered whole, neither as trees nor as probes, and no link is lost.
Each task reduces its links to a spanning forest before it writes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, partitions_for
from .components import connected_components

SHARD_LIMIT = 8192
LEVELS = 3
SEED = 42
_SPAN = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of a whole text: ASCII lower case, words between ASCII white space, ``width``-word
    shingles with repeats (the whole sequence if there are fewer words), XXH64 of each. A bit is set if it is
    set in over half the hashes. Null and wordless texts give 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = len(words) - width + 1
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, _SPAN):  # bounded memory for very long texts
        a, b = starts[at : min(at + _SPAN, n)].tolist(), (ends[at + width - 1 : min(at + _SPAN, n) + width - 1] - 1).tolist()
        hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(a, b, strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): one row per input row, fp the fingerprint's bits as a signed long."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
        return pa.record_batch([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), "doc_id long, fp long", of)


class BKForest:
    """BK-trees of many shards, built and probed level by level with array operations."""

    def __init__(self, shard: np.ndarray, fps: np.ndarray):
        """shard: dense shard number of each fingerprint."""
        self.fps = fps
        self.visits = 0  # members that probes were compared with
        n = len(fps)
        self.root = np.full(int(shard.max()) + 1 if n else 0, -1, np.int64)
        links, todo = [], np.argsort(shard, kind="stable")
        group, parent, edge = shard[todo].astype(np.int64), np.full(n, -1, np.int64), np.zeros(n, np.int64)
        while len(todo):
            first = np.r_[True, group[1:] != group[:-1]]
            heads = todo[first]
            if parent[0] < 0:
                self.root[group[first]] = heads
            else:
                links.append((parent[first] * 65 + edge[first], heads))
            above = heads[np.cumsum(first) - 1]
            todo, above = todo[~first], above[~first]
            edge = np.bitwise_count(fps[todo] ^ fps[above]).astype(np.int64)
            order = np.argsort(above * 65 + edge, kind="stable")
            todo, parent, edge = todo[order], above[order], edge[order]
            group = parent * 65 + edge
        keys, heads = (np.concatenate(x) for x in zip(*links, strict=True)) if links else (np.zeros(0, np.int64),) * 2
        order = np.argsort(keys)
        self.keys, self.heads = keys[order], heads[order]

    def probe(self, shard: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (probe number, tree member) within the radius, in the probe's own shard."""
        who = np.flatnonzero(self.root[shard] >= 0)
        at = self.root[shard[who]]
        hits = []
        while len(who):
            self.visits += len(who)
            d = np.bitwise_count(fps[who] ^ self.fps[at]).astype(np.int64)
            near = d <= radius
            hits.append((who[near], at[near]))
            lo = np.searchsorted(self.keys, at * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.keys, at * 65 + np.minimum(d + radius, 64), side="right") - lo
            who = np.repeat(who, n)
            at = self.heads[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(len(who))]
        return tuple(np.concatenate(x) for x in zip(*hits, strict=True)) if hits else (np.zeros(0, np.int64),) * 2


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a[i] with b[i]; each label is a member of its set that labels itself."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (jumped := label[label]).tobytes() != label.tobytes():
            label = jumped
    return label


def _spanning_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (shard, node, fp, role) of whole shards -> links (u, v); role 1 only stands in the tree, 2 only
    probes, 0 does both."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    shard = np.unique(table["shard"].to_numpy(), return_inverse=True)[1]
    node, fps, role = table["node"].to_numpy(), table["fp"].to_numpy().view(np.uint64), table["role"].to_numpy()
    trees, probes = np.flatnonzero(role != 2), np.flatnonzero(role != 1)
    if not len(trees):
        return
    forest = BKForest(shard[trees], fps[trees])
    forest.root = np.r_[forest.root, np.full(int(shard.max()) + 1 - len(forest.root), -1)]
    load = np.cumsum(np.bincount(shard[trees], minlength=int(shard.max()) + 1)[shard[probes]])
    label, at = np.arange(len(node)), 0
    while at < len(probes):
        end = max(at + 1, int(np.searchsorted(load, (load[at - 1] if at else 0) + 4_000_000)))
        some = probes[at:end]
        i, j = forest.probe(shard[some], fps[some], radius)
        label = _union(label, some[i], trees[j])
        at = end
    linked = np.flatnonzero(label != np.arange(len(node)))
    yield pa.record_batch([pa.array(node[linked]), pa.array(node[label[linked]])], names=["u", "v"])


def _blocks(path: tuple[int, ...], parts: int) -> list[list[int]]:
    """The bits that are still free after a path of chosen blocks, in ``parts`` blocks."""
    free = list(range(64))
    for k in path:
        gone = set(_split(free, parts)[k])
        free = [b for b in free if b not in gone]
    return _split(free, parts)


def _split(bits: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(bits, parts)]


def _deal(rows: DataFrame, level: int, radius: int) -> DataFrame:
    """Rows (path, agreed, node, fp) -> a row for each block of the bits that are still free."""
    parts = radius + 1
    masks = np.zeros((parts**level, parts), np.uint64)
    for p in range(parts**level):
        path = tuple((p // parts**k) % parts for k in range(level))
        for k, bits in enumerate(_blocks(path, parts)):
            masks[p, k] = sum(1 << b for b in bits)

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        path, agreed, node, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        mask = masks[path]
        step = np.arange(parts) * parts**level
        return pa.record_batch(
            [
                pa.array((path[:, None] + step).ravel()),
                pa.array((agreed.view(np.uint64)[:, None] | mask).view(np.int64).ravel()),
                pa.array(np.repeat(node, parts)),
                pa.array(np.repeat(fp, parts)),
            ],
            names=["path", "agreed", "node", "fp"],
        )

    return arrow_map(rows, "path long, agreed long, node long, fp long", of)


def pairs_of_pieces(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows (key, pieces, node, columns) -> (shard, columns, role): each node falls into one of its key's pieces, and
    each two pieces, or one with itself, are a shard. Role 1 stands in the shard's tree, 2 probes it, 0 does both; so
    each two nodes of a key meet in one shard, and a shard has two pieces at most."""
    dealt = rows.withColumn("a", F.expr("pmod(xxhash64(node, 7), pieces)")).withColumn("b", F.explode(F.expr("sequence(0L, pieces - 1)")))
    role = F.when(F.col("a") == F.col("b"), 0).when(F.col("a") < F.col("b"), 1).otherwise(2)
    return dealt.select(F.xxhash64(key, F.least("a", "b"), F.greatest("a", "b")).alias("shard"), *columns, role.alias("role"))


def near_links(classes: DataFrame, radius: int = 3, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """(node, fp), distinct fp -> links (u, v) that connect exactly what fingerprints within the radius connect.

    ``agreed`` is the mask of bits on which a shard's members agree; a shard is (path, fp & agreed).
    """
    spark = classes.sparkSession
    rows = classes.select(F.lit(0).cast("long").alias("path"), F.lit(0).cast("long").alias("agreed"), "node", "fp")
    ready, key = [], ["path", F.expr("fp & agreed").alias("value")]
    for level in range(LEVELS):
        rows = _deal(rows, level, radius).withColumn("value", F.expr("fp & agreed"))
        large = cut(rows.groupBy("path", "value").count().where(F.col("count") > shard_limit))
        shard = F.xxhash64(F.lit(level), "path", "value").alias("shard")
        role = F.lit(0).alias("role")
        if large.isEmpty():
            ready.append(rows.select(shard, "node", "fp", role))
            break
        ready.append(rows.join(large, ["path", "value"], "left_anti").select(shard, "node", "fp", role))
        rows = cut(rows.join(large, ["path", "value"]).select("path", "agreed", "node", "fp", "count"))
        if level == LEVELS - 1:
            pieces = F.ceil(F.col("count") / shard_limit).cast("long")
            rows = rows.select("node", "fp", F.xxhash64(F.lit(level), *key).alias("base"), pieces.alias("pieces"))
            ready.append(pairs_of_pieces(rows, "base", ["node", "fp"]))
            break
        rows = rows.drop("count")
    out = ready[0]
    for more in ready[1:]:
        out = out.union(more)
    n = partitions_for(spark, (radius + 1) * classes.count(), 1_000_000)
    return out.repartition(n, "shard").mapInArrow(lambda b: _spanning_links(b, radius), "u long, v long")


def links_of_repeats(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame | None:
    """Links (u, v) that join the classes (key, node) of a doc_id whose rows (doc_id, key) have several; None if there
    is no such id."""
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a <> b")
    several = cut(several.select("doc_id"))
    if several.isEmpty():
        return None
    return rows.join(several, "doc_id").select("doc_id", key).distinct().join(classes, key).select(F.col("doc_id").alias("u"), F.col("node").alias("v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of docs.

    Texts link if their fingerprints differ in at most ``radius`` bits; component_id is the least doc_id
    reachable over links. Null, empty and wordless texts have fingerprint 0 and link as any other. A null
    doc_id keeps its fingerprint, gives no id to others and has the component of its fingerprint (null if no
    document with an id shares it). Repeated rows stay repeated; rows of one doc_id with different texts are one
    document and link those texts. An empty table gives no rows.
    """
    fps = cut(fingerprints(docs, id_col, text_col))
    classes = cut(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    links, repeats = near_links(classes, radius, shard_limit), links_of_repeats(fps, classes, "fp")
    parts = connected_components(links if repeats is None else links.union(repeats))
    of_fp = classes.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(of_fp, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """The rows of docs, with its columns, whose document is the least of its component, each id once; see keep_least."""
    return keep_least(docs, near_duplicates(docs, id_col, text_col, radius), id_col)


def keep_least(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is the component_id of groups (doc_id, component_id), each id once.

    groups has a row for each row of docs, and one component for each id. Of rows repeated under one id the least by a
    hash of all columns stays. Rows with a null id stay. Only rows whose id is repeated are shuffled.
    """
    kept = groups.where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count("*").alias("n_rows"))
    kept = cut(kept.withColumnsRenamed({"doc_id": "__id", "n_rows": "__n"}))
    joined = docs.join(kept, docs[id_col].cast("long") == kept["__id"], "left")
    stays = joined.where("__n = 1").select(*docs.columns)
    if not kept.where("__n > 1").isEmpty():
        row = F.struct(*docs.columns)
        one = joined.where("__n > 1").groupBy("__id").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("__row"))
        stays = stays.union(one.select("__row.*"))
    return stays.union(docs.where(F.col(id_col).isNull()))
