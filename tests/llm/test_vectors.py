import numpy as np
import pytest
from helpers import oracle, rows

from wavewright.llm import ann, exact_topk, queries, vectors

SCHEMA = "vec_id long, embedding array<float>, score string"


def table(spark, m, ids=None):
    return spark.createDataFrame([(int(i), [float(x) for x in v], "s") for i, v in zip(ids if ids is not None else range(len(m)), m, strict=True)], SCHEMA)


def plain_top(m, ids, k, every, scale=256.0):
    q = np.floor(scale * np.asarray(m, np.float32).astype(float)).astype(object)
    out = []
    for i in range(len(m)):
        if ids[i] % every == 0:
            found = sorted((-(q[i] @ q[j]), ids[j]) for j in range(len(m)) if ids[j] != ids[i])[:k]
            out += [(ids[i], r + 1, j, int(-s)) for r, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(8192, 4096), (7, 3)])
def test_exact_top_k(spark, monkeypatch, blocks):
    monkeypatch.setattr(exact_topk, "BLOCK", blocks[0])
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", blocks[1])
    rng = np.random.default_rng(0)
    m = np.round(rng.normal(size=(60, 5)), 1)
    m[20:45] = m[20]  # many ties
    found = sorted(tuple(r) for r in exact_topk.exact_top_k(table(spark, m), "vec_id % 4 = 0", 5).collect())
    assert found == plain_top(m, list(range(60)), 5, 4)


def test_exact_top_k_odd_rows(spark):
    bad = [(100, None, "s"), (104, [1.0, None], "s"), (108, [float("nan"), 1.0], "s"), (112, [float("inf"), 1.0], "s"), (116, [], "s"), (None, [1.0, 2.0], "s")]
    good = [(0, [1.0, 2.0], "s"), (4, [0.5, -0.5], "s"), (4, [0.5, -0.5], "s"), (7, [0.0, 0.0], "s")]
    found = sorted(tuple(r) for r in exact_topk.exact_top_k(spark.createDataFrame(bad + good, SCHEMA), "vec_id % 4 = 0", 5).collect())
    assert found == plain_top([[1, 2], [0.5, -0.5], [0, 0]], [0, 4, 7], 5, 4)
    assert exact_topk.exact_top_k(spark.createDataFrame([], SCHEMA), "vec_id % 4 = 0").isEmpty()
    one = spark.createDataFrame(good[:1], SCHEMA)
    assert exact_topk.exact_top_k(one, "vec_id % 4 = 0").isEmpty()
    large = spark.createDataFrame([(0, [1e30, 1.0], "s"), (1, [1e30, 2.0], "s"), (2, [-1e30, 1.0], "s")], "vec_id long, embedding array<double>, score string")
    assert [(r["vec_id"], r["score"]) for r in exact_topk.exact_top_k(large, "vec_id = 0").orderBy("rank").collect()] == [(1, 2**63 - 1), (2, -(2**63 - 1))]


def test_exact_query(spark, sf):
    found = queries.op8_exact_topk(spark, sf).toPandas()
    assert rows(found) == rows(oracle(queries.ORACLE_SQL["op8_exact_topk"], sf))


def plain_nearest(m, ids, every, k):
    m = np.asarray(m, np.float32).astype(float)
    u = m / np.sqrt((m * m).sum(axis=1, keepdims=True))
    out = {}
    for i in range(len(m)):
        if ids[i] % every == 0:
            s = u @ u[i]
            out[ids[i]] = sorted(((-s[j], ids[j]) for j in range(len(m)) if ids[j] != ids[i]))[:k]
    return out


def test_recall(spark, sf):
    e = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/embeddings.parquet").toPandas().sort_values("vec_id")
    m, ids = np.stack(e.embedding.to_numpy()), e.vec_id.tolist()
    df = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/embeddings.parquet")
    found = queries.op3_learned_partitions(spark, sf.replace("0.001", "0.1")).toPandas()
    truth = plain_nearest(m, ids, 50, 5)
    assert set(found.query_id) == set(truth) and (found.groupby("query_id").size() == 5).all()
    hits = sum(len({j for _, j in truth[q]} & set(g.vec_id)) for q, g in found.groupby("query_id"))
    assert hits / (5 * len(truth)) >= 0.9
    at = {i: k for k, i in enumerate(ids)}
    for r in found.head(200).itertuples():
        a, b = (m[at[i]].astype(float) for i in (r.query_id, r.vec_id))
        assert r.score == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-12)
    del df


def test_clustered_vectors_are_pruned():
    rng = np.random.default_rng(0)
    x = ann._unit(np.repeat(rng.normal(size=(32, 16)), 64, axis=0) * 3 + 0.3 * rng.normal(size=(2048, 16)))
    r = ann.fit_router(x, 16)
    sizes = np.bincount(ann.balanced_partition(x, ann.neighbour_graph(x, 10), 16, rng), minlength=16)
    assert r.visits <= 6 and sizes.max() - sizes.min() <= 2


def test_partitions_grow_with_the_table():
    assert [ann.parts_for(n) for n in (0, 255, 512, 51_282, 2**22, 2**23, 2**24, 2**40)] == [1, 1, 2, 64, 64, 128, 256, 256]
    rng = np.random.default_rng(2)
    x = ann._unit(np.repeat(rng.normal(size=(256, 16)), 32, axis=0) * 3 + 0.3 * rng.normal(size=(8192, 16)))
    r = ann.fit_router(x, ann.parts_for(2**40))
    assert r.weights.shape[1] == 256 and r.visits <= 16


def test_ties_and_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows_ = [(i, v, "s") for i in range(0, 40)] + [(3, v, "s"), (41, None, "s"), (42, [0.0, 0.0, 0.0], "s"), (44, [float("nan"), 1.0, 1.0], "s"), (45, [1.0, None, 2.0], "s"), (46, [1.0, 2.0], "s")]
    found = ann.nearest(spark.createDataFrame(rows_, SCHEMA), "vec_id % 20 = 0", 5)
    got = {q: [r["vec_id"] for r in found.where(f"query_id = {q}").orderBy("rank").collect()] for q in (0, 20)}
    assert got == {0: [1, 2, 3, 4, 5], 20: [0, 1, 2, 3, 4]} and found.select("query_id").distinct().count() == 2
    assert ann.nearest(spark.createDataFrame([], SCHEMA), "vec_id % 20 = 0").isEmpty()
    few = ann.nearest(spark.createDataFrame(rows_[:3], SCHEMA), "vec_id = 0", 5)
    assert [r["vec_id"] for r in few.orderBy("rank").collect()] == [1, 2]


def test_few_found_visits_everything(spark):
    rng = np.random.default_rng(1)
    far = np.concatenate([rng.normal(size=(600, 8)) + 8, -rng.normal(size=(3, 8)) - 8])
    found = ann.nearest(table(spark, far), "vec_id = 601", 5, parts=8)
    assert found.count() == 5


def test_helpers():
    a = np.array([[3.0, 4.0]])
    assert ann.cosines(a, a * 1e200)[0] == pytest.approx(1.0)
    state = [np.full((1, 2), -np.inf), np.full((1, 2), -1, np.int64)]
    out = vectors.merge_top(state, np.array([[1.0, 5.0, 5.0]]), np.array([9, 8, 7]), 2)
    assert out[1].tolist() == [[7, 8]]


def test_repeated_ids_count_by_their_best_vector(spark):
    """Against all pairs of rows: an id, and a query, has the best score of any of its vectors."""
    rng = np.random.default_rng(5)
    rows_ = [(int(i), [float(x) for x in rng.normal(size=6)], "s") for i in rng.integers(0, 60, 400)]
    rows_ += [(7, rows_[0][1], "s")] * 50 + [(0, rows_[0][1], "s"), (9, [2 * x for x in rows_[0][1]], "s")]
    found = {}
    for r in ann.nearest(spark.createDataFrame(rows_, SCHEMA).repartition(5), "vec_id % 20 = 0", 5, target=1.0).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    best = {}
    m = np.array([v for _, v, _ in rows_])
    cos = (m @ m.T) / np.sqrt(np.outer((m * m).sum(axis=1), (m * m).sum(axis=1)))
    for a, (q, _, _) in enumerate(rows_):
        for b, (c, _, _) in enumerate(rows_):
            if q % 20 == 0 and q != c:
                best[q, c] = max(best.get((q, c), -2.0), cos[a, b])
    for q in {i for i, _, _ in rows_ if i % 20 == 0}:
        expected = sorted(((-round(s, 12), c) for (x, c), s in best.items() if x == q))[:5]
        got = sorted(found[q])
        assert [c for _, c, _ in got] == [c for _, c in expected] and [s for _, _, s in got] == pytest.approx([-s for s, _ in expected])


def test_pieces_nobody_visits_are_not_copied(spark):
    """Rows go out once for each group of queries that visits their own partition."""
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(8, 8)) * 10, 300, axis=0) + 0.1 * rng.normal(size=(2400, 8))
    found = ann.nearest(table(spark, x), "vec_id < 3", 5, parts=8)
    truth = plain_nearest(x, list(range(2400)), 1, 5)
    assert {(r["query_id"], r["vec_id"]) for r in found.collect()} == {(q, j) for q in range(3) for _, j in truth[q]}
