import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from wavewright.llm import bpe, queries, token_cache

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


NEW = chr(0x323E7)  # a letter in newer Unicode tables only


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="the and ing\n  '’é漢😀" + NEW, max_size=40)))
def test_encoding(library, text):
    ours = bpe.encoder(PATH, PATTERN)
    ids = ours.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert ours.decode_bytes(ids) == text.encode() and ours.decode(ids) == text
    assert "".join(ours.decode_stream(np.frombuffer(ids, "<u4").tolist())) == text


def test_newer_letters(library):
    for text in ("a" + NEW + "b", NEW * 3, "." + NEW + "1", " " + NEW):
        assert np.frombuffer(bpe.encoder(PATH, PATTERN).encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_offsets():
    text = "ab 漢字é😀 x"
    ids, start, end = bpe.encoder(PATH, PATTERN).offsets(text)
    assert start[0] == 0 and end[-1] == len(text) and (start < end).all() and (start[1:] <= end[:-1]).all()
    assert len(bpe.encoder(PATH, PATTERN).offsets("")[0]) == 0


def test_long_text(library, monkeypatch):
    text = "word " * 5000 + "x" * 3000
    monkeypatch.setattr(bpe, "_LONG_TEXT", 100)
    assert np.frombuffer(bpe.encoder(PATH, PATTERN).encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_cache_bound(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    ours = bpe.ByteBPE(PATH, PATTERN)
    for text in ("a b c d e f g h i j", "k l m n o p a b c", "a b c d"):
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == library.encode_ordinary(text)
        assert len(ours.cache) <= 12


def test_frame(spark):
    df = spark.createDataFrame([(1, "héllo", 5), (1, "héllo", 5), (2, None, 0), (None, "", 0)], "doc_id long, text string, n_tokens long")
    found = {tuple(r) for r in bpe.encode_documents(df, PATH, PATTERN).collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert (2, 0, none, none) in found and (None, 0, none, none) in found and len(found) == 3
    assert bpe.encode_documents(df.limit(0), PATH, PATTERN).isEmpty()
    full = bpe.encode_documents(df, PATH, PATTERN, with_ids=True).where("doc_id = 1").first()
    assert len(full["ids"]) == full["n_tokens"] and full["ends"][-1] == 5


def test_query(spark, sf, library):
    found = queries.op4_byte_bpe(spark, sf).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    for r in docs.itertuples():
        ids = np.array(library.encode_ordinary(r.text), "<u4")
        row = found.loc[r.doc_id]
        assert row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(ids.tobytes()).hexdigest() and row.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=30), st.text(alphabet="ab ▁\n\tthe<s>é漢", max_size=30)))
def test_piece_counts(pieces, text):
    assert token_cache.counter(MODEL).by_word and token_cache.counter(MODEL).count(text) == len(pieces.encode(text))


def test_counts_through_the_cache(spark, tmp_path, pieces):
    cache = str(tmp_path / "cache")
    rows = [(1, "a b", 9), (2, "a b", 9), (2, "a b", 9), (3, None, 9), (4, "", 9), (None, "long " * 5000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes long")
    found = sorted((tuple(r) for r in token_cache.count_tokens(df, MODEL, cache).collect()), key=repr)
    n = len(pieces.encode("long " * 5000))
    assert found == sorted([(1, 3, 2, False), (2, 3, 2, False), (2, 3, 2, False), (3, 0, 0, False), (4, 0, 0, False), (None, 25000, n, n > 4096)], key=repr)
    stored = spark.read.parquet(cache)
    assert stored.count() == 3
    more = df.union(spark.createDataFrame([(7, "new text", 9)], df.schema))
    assert token_cache.count_tokens(more, MODEL, cache).count() == 7 and spark.read.parquet(cache).count() == 4
    token_cache.count_tokens(df, public_tokenizers.path("word_bpe_49k.json"), cache)  # another version does not meet these counts
    assert spark.read.parquet(cache).select("version").distinct().count() == 2
    assert token_cache.count_tokens(df.limit(0), MODEL, str(tmp_path / "none")).isEmpty()


def test_stored_counts_are_used(spark, tmp_path):
    cache, version = str(tmp_path / "cache"), token_cache.version_of(MODEL)
    spark.createDataFrame([(version, bytearray(hashlib.sha256(b"known").digest()), 77)], "version string, digest binary, n_tokens long").write.parquet(cache)
    df = spark.createDataFrame([(1, "known")], "doc_id long, text string")
    assert token_cache.count_tokens(df, MODEL, cache).first()["n_tokens"] == 77


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_json_counts(name):
    from tokenizers import Tokenizer

    text = "Hello <|endoftext|> wörld"
    assert token_cache.counter(public_tokenizers.path(name)).count(text) == len(Tokenizer.from_file(public_tokenizers.path(name)).encode(text, add_special_tokens=False).ids)


def test_count_query(spark, sf, pieces):
    found = queries.op6_token_counts(spark, sf).toPandas().set_index("doc_id")
    for r in spark.read.parquet(f"{sf}/documents.parquet").toPandas().itertuples():
        row = found.loc[r.doc_id]
        assert (row.n_tokens, row.n_bytes, row.over_limit) == (len(pieces.encode(r.text)), len(r.text.encode()), len(pieces.encode(r.text)) > 4096)


def test_second_call_counts_nothing_anew(spark, sf, tmp_path, monkeypatch):
    cache, docs = str(tmp_path / "cache"), spark.read.parquet(f"{sf}/documents.parquet")
    first = token_cache.count_tokens(docs, MODEL, cache, with_cached=True)
    assert {r["cached"] for r in first.collect()} == {False}
    files = sorted(p.name for p in (tmp_path / "cache").iterdir())
    second = token_cache.count_tokens(docs, MODEL, cache, with_cached=True)
    assert {r["cached"] for r in second.collect()} == {True} and sorted(p.name for p in (tmp_path / "cache").iterdir()) == files
    assert sorted(map(str, second.drop("cached").collect())) == sorted(map(str, first.drop("cached").collect()))
    assert all(r["cached"] for r in queries.op6_token_counts(spark, sf).collect())
