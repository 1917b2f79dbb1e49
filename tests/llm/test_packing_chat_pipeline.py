import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavewright.llm import chat_quotes, packing, queries


def plain_best_fit(lengths, capacities, least):
    room, bins = [], []
    for n in lengths:
        fits = [(r, b) for b, r in enumerate(room) if r >= n]
        if fits:
            best = min(r for r, _ in fits)
            b = next(b for r, b in fits if r == best)
        else:
            b = len(room)
            room.append(min(c for c in capacities if c >= max(n, least)))
        room[b] -= n
        bins.append(b)
    return bins, len(room)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60), st.sampled_from([8, 16, 32]))
def test_best_fit(lengths, least):
    lengths = sorted(lengths, reverse=True)
    bins, offsets, opened = packing.best_fit(lengths, (8, 16, 32), least)
    plain, n = plain_best_fit(lengths, (8, 16, 32), least)
    assert len(opened) == n
    fill = lambda x: sorted(sum(v for v, b in zip(lengths, x, strict=True) if b == k) for k in set(x))
    assert fill(bins) == fill(plain)
    for b in set(bins):
        spans = sorted((o, o + v) for v, k, o in zip(lengths, bins, offsets, strict=True) if k == b)
        assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False)) and spans[-1][1] <= opened[b]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 32), min_size=1, max_size=40))
def test_pack(lengths):
    lengths = sorted(lengths, reverse=True)
    bins, _, sizes = packing.pack(lengths, (8, 16, 32), 2)
    filled = np.bincount(bins, weights=lengths)
    assert all(f <= s and (s == 8 or f > s / 2) for f, s in zip(filled, sizes, strict=True))
    cost = sum(sizes) + 2 * len(sizes)
    for least in (8, 16, 32):
        b, _, opened = packing.best_fit(lengths, (8, 16, 32), least)
        f = np.bincount(b, weights=lengths, minlength=len(opened))
        assert cost <= sum(min(c for c in (8, 16, 32) if c >= x) for x in f) + 2 * len(opened)


def check_packing(rows, lengths, capacities=packing.CAPACITIES):
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["copy"]), []).append((r["start"], r["n_tokens"]))
        if r["bin_id"] is not None:
            by_bin.setdefault((r["bin_id"], r["capacity"]), []).append((r["bin_offset"], r["bin_offset"] + r["n_tokens"]))
    assert sorted((d if d is not None else -1, sum(n for _, n in x)) for (d, _), x in by_doc.items()) == sorted((d if d is not None else -1, n) for d, n in lengths)
    for x in by_doc.values():
        x.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and x[0][0] == 0
    for (_, capacity), x in by_bin.items():
        x.sort()
        assert capacity in capacities and x[0][0] == 0 and all(a[1] == b[0] for a, b in zip(x, x[1:], strict=False)) and x[-1][1] <= capacity
        assert capacity == min(c for c in capacities if c >= x[-1][1])


def test_packing_frame(spark):
    lengths = [(1, 100), (1, 100), (2, 0), (3, 20_000), (None, 7), (4, 8192), (5, 1)] + [(i, i * 37 % 3000) for i in range(10, 200)]
    df = spark.createDataFrame(lengths, "doc_id long, n_tokens long")
    found = packing.pack_lengths(df, group_pieces=50)
    check_packing(found.collect(), lengths)
    again = packing.pack_lengths(df.repartition(7), group_pieces=50)
    assert sorted(map(str, found.collect())) == sorted(map(str, again.collect()))
    assert packing.pack_lengths(df.limit(0)).isEmpty()


def test_packing_query(spark, sf):
    from wavewright.llm import token_cache

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    lengths = [(r.doc_id, token_cache.counter(path).count(r.text)) for r in docs.itertuples()]
    check_packing(queries.op9_variable_bins(spark, sf).collect(), lengths)
    odd = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "word " * 30_000, 5)], "doc_id long, text string, capacity int")
    assert {r["doc_id"] for r in packing.pack_documents(odd, path).where("bin_id is null").collect()} == {1, 2}


CHAT = "conv_id long, turn long, role string, text string, depth string"


def threads_of(spark, rows):
    return {(r["conv_id"], r["turn"]): r for r in chat_quotes.format_conversations(spark.createDataFrame([(*r, "x") for r in rows], CHAT)).collect()}


def test_quotes(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you?"),
        (1, 1, "assistant", "On Monday user wrote:\n> Hello there.\n> How are you?\n\nFine thanks."),
        (1, 2, "user", "> > How are you?\n> Fine thanks.\nGood"),
        (1, 3, "user", "> hello   THERE.\nhi again"),
        (1, 4, "user", "> never said\nok"),
        (1, 5, None, None),
        (2, 0, "user", "Hello there."),
        (None, 1, "user", "> Hello there.\nx"),
        (2, 3, "user", ">Hello there.\nA\n> Hello there.\nB"),
    ]
    found = threads_of(spark, rows)
    assert {k: (r["reply_to"], r["thread_root"], r["depth"]) for k, r in found.items()} == {
        (1, 0): (None, 0, 0), (1, 1): (0, 0, 1), (1, 2): (1, 0, 2), (1, 3): (0, 0, 1), (1, 4): (None, 4, 0), (1, 5): (None, 5, 0),
        (2, 0): (None, 0, 0), (None, 1): (None, 1, 0), (2, 3): (0, 0, 1),
    }
    assert found[1, 1]["text"] == "Fine thanks." and found[2, 3]["text"] == "A\nB" and found[1, 5]["formatted"] == "<|user|>\n\n<|end|>"
    assert found[1, 2]["n_quoted"] == 2


def test_quotes_match_sql(spark, tmp_path):
    from helpers import oracle
    from helpers import rows as plain

    rng = np.random.default_rng(4)
    words = ["yes", "No way", "see you", "what now?", "fine", "It is late"]
    table = []
    for conv in range(12):
        said = []
        for turn in range(9):
            lines = []
            for _ in range(int(rng.integers(0, 3))):
                if said:
                    src = said[int(rng.integers(len(said)))].split("\n")
                    mark = ["> ", ">", ">> ", "> > "][int(rng.integers(4))]
                    lines += (["On Monday X wrote:"] if rng.random() < 0.3 else []) + [mark + x.upper() if rng.random() < 0.2 else mark + x for x in src]
                lines += [""] * int(rng.integers(0, 2))
            text = "\n".join([*lines, *(words[int(rng.integers(6))] + f" {conv % 3}" for _ in range(int(rng.integers(1, 4))))])
            said.append(text)
            table.append((conv, turn, [None, "user", "assistant"][int(rng.integers(3))], None if rng.random() < 0.05 else text, "x"))
    df = spark.createDataFrame(table, CHAT)
    found = chat_quotes.format_conversations(df).toPandas()
    assert found.reply_to.notna().sum() > 10 and found.depth.max() > 1
    for t in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels").split():
        spark.range(1).write.parquet(str(tmp_path / f"{t}.parquet"))
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    assert plain(found) == plain(oracle(queries.ORACLE_SQL["op10_quotation_linking"], str(tmp_path)))


def test_some_paragraphs_wrapped_anew(spark):
    rows = [
        (1, 0, "user", "Hello\nall"),
        (1, 1, "user", "The first paragraph has a long line of words.\n\nThe second one is left out.\n\nThe third follows after it, and ends."),
        (1, 2, "assistant", "> The first paragraph has\n> a long line of words.\n>\n> The third follows\n> after it, and ends.\nagreed"),
        (1, 3, "user", "> The third follows\n> after it, and ends.\n> \n> never said by anyone\nyes"),
        (1, 4, "user", "> > The first paragraph has a long\n> > line of words.\n> >\n> > something else\nno"),
    ]
    found = threads_of(spark, rows)
    assert {k[1]: (r["reply_to"], r["thread_root"]) for k, r in found.items()} == {0: (None, 0), 1: (None, 1), 2: (1, 1), 3: (1, 1), 4: (1, 1)}


def test_long_reply_chain(spark):
    rows = [(1, 0, "user", "start")] + [(1, i, "user", (f"> message {i - 1}\n" if i > 1 else "> start\n") + f"message {i}") for i in range(1, 40)]
    found = threads_of(spark, rows)
    assert all(found[1, i]["depth"] == i and found[1, i]["thread_root"] == 0 for i in range(40))


def test_no_python_in_the_plan(spark, sf):
    df = queries.op10_quotation_linking(spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    assert df.count() == table.count()
    assert chat_quotes.format_conversations(table.limit(0)).isEmpty()


def test_chat_without_quotes_is_left_alone(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet").toPandas()
    found = queries.op10_quotation_linking(spark, sf).toPandas()
    plain = {(r.conv_id, r.turn, r.role, r.text.strip(), r.turn) for r in table.itertuples()}
    assert {(r.conv_id, r.turn, r.role, r.text, r.thread_root) for r in found.itertuples()} == plain


def test_pipeline(spark, sf):
    import corpus_pipeline
    from wavewright.llm import langid, quality, token_cache

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        nxt = stage(spark, left, sf)
        assert nxt.columns == columns
        left = nxt.cache()
    # the same decisions taken one document at a time
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scores = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, labels).collect()}
    good = docs.toPandas()
    good = good[good.doc_id.map(lambda d: scores[d] >= quality.GOOD)]
    model = langid.learn(spark.createDataFrame(good))
    good = good[~model.predict(good.text.tolist())[2]]
    from test_near_copies import components_of  # all pairs of texts by five-word Jaccard similarity

    label, _ = components_of(dict(zip(good.doc_id, good.text, strict=True)))
    kept = sorted(d for d in label if label[d] == d)
    assert sorted(r["doc_id"] for r in left.collect()) == kept
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = dict(zip(good.doc_id, good.text, strict=True))
    check_packing(corpus_pipeline.run(spark, sf).collect(), [(d, token_cache.counter(path).count(texts[d])) for d in kept])


def test_pipeline_on_nothing(spark, sf, tmp_path):
    import corpus_pipeline

    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


def test_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("n", [1, 5])
def test_partitions_do_not_matter(spark, sf, n):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    expected = sorted(map(str, queries.op1_simhash_bktree(spark, sf).collect()))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", n)
        assert sorted(map(str, queries.op1_simhash_bktree(spark, sf).collect())) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 16), min_size=1, max_size=7))
def test_pack_against_all_packings(lengths):
    """The least cost over all ways to deal pieces to bins is never far below, and never above."""
    sizes, overhead = (4, 8, 16), 1
    lengths = sorted(lengths, reverse=True)

    def least(k, bins):
        if k == len(lengths):
            return sum(min(c for c in sizes if c >= b) + overhead for b in bins)
        ways = [bins[:i] + [b + lengths[k]] + bins[i + 1 :] for i, b in enumerate(bins) if b + lengths[k] <= 16] + [[*bins, lengths[k]]]
        return min(least(k + 1, w) for w in ways)

    found = packing.pack(lengths, sizes, overhead)
    cost = sum(found[2]) + overhead * len(found[2])
    assert least(0, []) <= cost <= 1.35 * least(0, [])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 32), min_size=1, max_size=40), st.data())
def test_openings_of_least_cost(lengths, data):
    lengths, sizes, overhead = sorted(lengths, reverse=True), (8, 16, 32), 3
    at = data.draw(st.integers(0, len(lengths) - 1))
    costs = []
    for c in sizes:
        if c >= lengths[at]:
            room = c - lengths[at]
            for n in lengths[at + 1 :]:
                room -= n if n <= room else 0
            costs.append(((min(x for x in sizes if x >= c - room) + overhead) / (c - room), -c))
    assert packing.least_cost_opening(lengths, sizes, overhead)(at) == -min(costs)[1]
