import itertools

import numpy as np
import pytest

from wavewright.llm import near_copies, simhash


def plain(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def components_of(texts):
    sets, label = {i: plain(t) for i, t in texts.items()}, {i: i for i in texts}
    pairs = [(i, j) for i, j in itertools.combinations(sorted(texts), 2) if jaccard(sets[i], sets[j]) >= 0.8]
    for _ in texts:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    return label, pairs


def test_edited_copies(spark):
    rng = np.random.default_rng(1)
    word = lambda: f"w{int(rng.integers(5000))}"
    texts = {}
    for _ in range(40):
        base = [word() for _ in range(int(rng.integers(60, 300)))]
        for edits in (0, 1, 2, 3, 4, 6, 8):
            copy = base[:]
            for at in rng.choice(len(base), edits * len(base) // 150 + (edits > 0), replace=False):
                copy[at] = word()
            texts[len(texts)] = " ".join(copy)
    expected, pairs = components_of(texts)
    fps = {i: simhash.fingerprint(t) for i, t in texts.items()}
    assert sum((fps[i] ^ fps[j]).bit_count() > 3 for i, j in pairs) > 20  # SimHash within 3 bits misses these
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs).collect()}
    assert found == expected


def test_pairs_beside_the_least_link(spark):
    """Both copies fall short of the least document that they share buckets with, but not of each other."""
    base = [f"w{i}" for i in range(200)]
    edited = lambda *at: " ".join("other" if i in at else w for i, w in enumerate(base))
    texts = {1: edited(20, 40), 2: edited(100, 120, 140, 160), 3: edited(100, 120, 140, 160, 180)}
    expected, _ = components_of(texts)
    assert expected == {1: 1, 2: 2, 3: 2}
    found = near_copies.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == expected


def test_odd_rows(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away"
    rows = [(5, text, 0), (3, text.upper(), 1), (9, None, 2), (4, "", 3), (4, "", 4), (None, text, 5), (11, "\n\t", 6), (12, "something else entirely", 7), (13, "something else", 8), (20, text + " ok", 9), (20, "no copy of any other text here", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    found = sorted(map(tuple, near_copies.near_copies(docs).collect()), key=repr)
    assert found == sorted([(5, 3), (3, 3), (9, 4), (4, 4), (4, 4), (None, 3), (11, 4), (12, 12), (13, 13), (20, 3), (20, 3)], key=repr)
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["12", "13", "3", "4", "None"]
    assert near_copies.keep_one(docs.limit(0)).isEmpty()


def test_pipeline_stage_on_documents(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    expected, _ = components_of({r["doc_id"]: r["text"] for r in docs.collect()})
    kept = corpus_pipeline.STAGES[2][1](spark, docs, sf)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, c in expected.items() if i == c)


def test_long_text():
    text = " ".join(f"w{i % 7001}" for i in range(40_000))
    found = near_copies.shingles(text)
    assert len(found) == len(plain(text)) and len(near_copies.bands(found)) == near_copies.BANDS


@pytest.mark.parametrize("limit", [near_copies.SHARD_LIMIT, 2])
def test_trees_of_any_size_find_the_same(spark, limit):
    base = [f"w{i}" for i in range(120)]
    texts = {i: " ".join(f"x{i}" if k in (7 * i % 120, 11 * i % 120, 13 * i % 120) else w for k, w in enumerate(base)) for i in range(30)}
    expected, _ = components_of(texts)
    found = near_copies.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), shard_limit=limit)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == expected


def test_short_texts(spark):
    """Sets of four to twelve shingles, where one shingle is a large share."""
    rng = np.random.default_rng(4)
    texts = {}
    for _ in range(60):
        base = [f"w{int(rng.integers(3000))}" for _ in range(int(rng.integers(8, 17)))]
        for more in (0, 1, 2):
            texts[len(texts)] = " ".join(base + [f"w{int(rng.integers(3000))}" for _ in range(more)])
    expected, pairs = components_of(texts)
    found = near_copies.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert len(pairs) > 20 and {r["doc_id"]: r["component_id"] for r in found.collect()} == expected


@pytest.mark.parametrize("n_texts, least", [(10_000, 0.999), (5_000_000, 0.99)])
def test_bands_of_fingerprints_find_pairs_on_the_limit(n_texts, least):
    """Pairs of sets at a similarity of 0.8, or little above for few shingles, meet by bits of their fingerprints alone."""
    rng = np.random.default_rng(9)
    n_bands, bits = near_copies.plan(n_texts)
    found = []
    for k in range(600):
        n = int(rng.integers(9, 300))
        alone = n // 9
        x = rng.integers(0, 2**63, n + alone, dtype=np.uint64)
        a, b = (near_copies.fingerprints(np.sort(y)) for y in (x[alone:], x[:n]))
        assert (n - alone) / (n + alone) >= 0.8
        shared = near_copies.keys_of(np.stack([a, b]), n_bands, bits)
        near = [int(c) for c in np.bitwise_count(a ^ b)[: near_copies.SENT]]
        found.append((shared[0] == shared[1]).any() and near[0] <= near_copies.RADIUS and sum(near) <= near_copies.WIDE)
    assert np.mean(found) >= least


def alike():
    """140 texts alike, nearly all short of 0.8 among each other, and a copy with one edit of every seventh."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(140):
        at = set(rng.choice(len(base), 8, replace=False).tolist())
        texts[2 * i] = " ".join(f"x{i}" if k in at else w for k, w in enumerate(base))
        if i % 7 == 0:
            texts[2 * i + 1] = texts[2 * i] + " more"
    return texts


def test_alike_texts_are_dealt_once_and_not_for_each_band(spark, monkeypatch):
    texts, dealt, deal = alike(), [], near_copies._deal_open
    expected, pairs = components_of(texts)
    assert len(pairs) >= 20 and len(set(expected.values())) > 100

    def counted(rows, *more):
        dealt.append(rows.count())
        return deal(rows, *more)

    monkeypatch.setattr(near_copies, "_deal_open", counted)
    found = near_copies.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == expected
    assert dealt and max(dealt) <= len(texts)


@pytest.mark.parametrize("limit, most_edges", [(128, near_copies.MOST_EDGES), (16, 10)])
def test_alike_texts_in_pieces_and_by_bands(spark, monkeypatch, limit, most_edges):
    """160 texts of one area are 5 pieces at a limit of 128, and too many pieces at 16, so that bands deal them."""
    texts, by_bands, keyed = alike(), [], near_copies._keyed
    expected, _ = components_of(texts)

    def seen(*args):
        rows = keyed(*args)
        by_bands.append(not rows.where("band >= 0").isEmpty())
        return rows

    monkeypatch.setattr(near_copies, "_keyed", seen)
    monkeypatch.setattr(near_copies, "MOST_EDGES", most_edges)
    found = near_copies.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), shard_limit=limit)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == expected
    assert by_bands == [limit == 16]
