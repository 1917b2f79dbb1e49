import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavewright.llm import components, near_copies, simhash


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(ids, fps, radius=3):
    label = dict(zip(ids, ids, strict=True))
    changed = True
    while changed:
        changed = False
        for i, a in zip(ids, fps, strict=True):
            best = min(label[j] for j, b in zip(ids, fps, strict=True) if (a ^ b).bit_count() <= radius)
            if best < label[i]:
                label[i], changed = best, True
    return label


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAbB ÄÉ\t\n\x0b x", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def test_long_text():
    text = "one two three four five " * 20_000
    assert simhash.fingerprint(text) == plain(text)


@pytest.mark.parametrize("limit", [8192, 4])
def test_components(spark, limit):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    fps = [int(b) for b in base]
    for _ in range(120):
        x = fps[int(rng.integers(len(fps)))]
        for k in rng.integers(0, 64, int(rng.integers(0, 4))):
            x ^= 1 << int(k)
        fps.append(x)
    fps = list(dict.fromkeys(fps))
    rows = [(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(fps)]
    links = simhash.near_links(spark.createDataFrame(rows, "node long, fp long"), 3, limit)
    found = {r["node"]: r["component"] for r in components.connected_components(links).collect()}
    expected = components_of(list(range(len(fps))), fps)
    assert {i: found.get(i, i) for i in expected} == expected


def test_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (7, 3)], "u long, v long")
    found = components.connected_components(edges).collect()
    assert len(found) == 201 and {r["component"] for r in found} == {0}
    assert components.connected_components(edges.limit(0)).isEmpty()


def test_documents(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away"
    rows = [(5, text, "a"), (3, text.upper(), "b"), (9, None, "c"), (4, "", "d"), (4, "", "d"), (None, text, "e"), (11, "\n\t", "f"), (12, "something else entirely here now", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    found = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr)
    ids = {(r[0], r[2]) for r in found}
    assert len(found) == len(rows)
    assert ids == {(5, 3), (3, 3), (None, 3), (9, 4), (4, 4), (11, 4), (12, 12)}
    assert {r[1] for r in found if r[0] in (9, 4, 11)} == {"0" * 16}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["12", "3", "4", "None"]
    assert simhash.near_duplicates(docs.limit(0)).isEmpty() and simhash.keep_one(docs.limit(0)).isEmpty()


def test_query(spark, sf):
    from wavewright.llm import queries

    found = queries.op1_simhash_bktree(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
    fps = {d: plain(t) for d, t in zip(docs.doc_id, docs.text, strict=True)}
    expected = components_of(list(fps), list(fps.values()))
    assert {d: (f"{fps[d]:016x}", expected[d]) for d in fps} == {r.doc_id: (r.fingerprint, r.component_id) for r in found.itertuples()}


def test_hot_group(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same words again and again").otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("text"))
    found = simhash.near_duplicates(docs).groupBy("component_id").count().orderBy(F.desc("count")).first()
    assert (found["component_id"], found["count"]) == (0, 1000)


def test_probes_follow_only_edges_within_the_radius():
    """The forest's visits against a plain BK-tree whose children are keyed by their distance to the parent."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 63, 12)]))
    tree = {}  # member -> {edge: child}

    def add(at, k):
        d = (int(fps[at]) ^ int(fps[k])).bit_count()
        if d in tree[at]:
            return add(tree[at][d], k)
        tree[at][d], tree[k] = k, {}

    tree[0] = {}
    for k in range(1, len(fps)):
        add(0, k)
    for radius in (0, 3, 9):
        visits, hits = 0, set()
        for p in range(len(fps)):
            todo = [0]
            while todo:
                at = todo.pop()
                visits += 1
                d = (int(fps[p]) ^ int(fps[at])).bit_count()
                hits |= {(p, at)} if d <= radius else set()
                todo += [child for edge, child in tree[at].items() if abs(edge - d) <= radius]
        forest = simhash.BKForest(np.zeros(len(fps), np.int64), fps)
        found = forest.probe(np.zeros(len(fps), np.int64), fps, radius)
        assert set(zip(found[0].tolist(), found[1].tolist(), strict=True)) == hits and forest.visits == visits < len(fps) ** 2


def test_rows_of_one_id_are_one_document(spark):
    a, b = "the first text that is told here", "quite another story of other things"
    rows = [(2, a, "x"), (5, a, "y"), (5, b, "z"), (7, b, "w"), (2, a, "v"), (8, "alone", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other string")
    assert {(r[0], r[2]) for r in simhash.near_duplicates(docs).collect()} == {(2, 2), (5, 2), (7, 2), (8, 8)}
    for keep in (simhash.keep_one, near_copies.keep_one):
        kept = [tuple(r) for r in keep(docs).collect()]
        assert sorted(r[0] for r in kept) == [2, 8] and set(kept) < set(rows)
        assert sorted(map(tuple, keep(docs.repartition(3)).collect())) == sorted(kept)


def test_a_hub_is_split(spark):
    """The join of a node with very many edges must be a skewed join that Spark splits."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        edges = spark.range(300_000).select(F.when(F.col("id") < 250_000, 1).otherwise(F.col("id")).alias("u"), (F.col("id") + 1_000_000).alias("v"))
        found = components._large_star(components.cut(edges), 300_000)
        assert found.count() > 0
        plan = found._jdf.queryExecution().executedPlan()
        found.collect()
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString() or "isSkew" in plan.toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_pieces_of_a_large_shard_meet_once(spark):
    rows = spark.range(200).select(F.lit(1).alias("key"), F.lit(5).cast("long").alias("pieces"), F.col("id").alias("node"))
    dealt = simhash.pairs_of_pieces(rows, "key", ["node"]).collect()
    shards = {}
    for r in dealt:
        shards.setdefault(r["shard"], []).append((r["node"], r["role"]))
    met = []
    for members in shards.values():
        assert len({role for _, role in members} & {0, 1, 2}) <= 2 and len(members) < 120
        met += [tuple(sorted((u, v))) for u, a in members for v, b in members if (a, b) == (2, 1) or (a, b) == (0, 0) and u < v]
    assert len(dealt) == 1000 and len(met) == len(set(met)) == 200 * 199 // 2
