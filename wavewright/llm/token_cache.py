"""Token counts through a digest cache.

The cache is a Parquet table (version, digest, n_tokens) in a shared folder. Counting joins the digests of
normalised contents and of the tokenizer's version to it, encodes each distinct miss once, appends the new
counts and joins again. Texts that the cache knows are never encoded; only texts of misses are shuffled.
Normalising must not change a count, so it only makes null the empty text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import cut

CACHE_CHUNKS = 400_000
CACHED_LENGTH = 48
_SCHEMA = "version string, run string, digest binary, n_tokens long"


class _Chunks(dict):
    """Token count of each word that begins with the word mark; bounded."""

    def __init__(self, model):
        self.model = model

    def __missing__(self, word: str) -> int:
        n = len(self.model.encode(word)) if word else 1  # a word mark alone is one piece
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHE_CHUNKS:
                self.clear()
            self[word] = n
        return n


class PieceCounter:
    """Counts of a sentencepiece model as the library gives them, without begin or end.

    If no piece has the word mark after another character and the model changes nothing but spaces, merges
    never cross into a word mark, and a text's count is the sum over its words. Otherwise texts are encoded whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        probe = " \u00a0\uff21  b\tc\n e\u0301 "
        plain = "".join(self.model.id_to_piece(i) for i in self.model.encode("  ab")).startswith("\u2581\u2581")
        same = "\u2581" + probe.replace(" ", "\u2581") == self.model.normalize(probe)
        alone = self.model.id_to_piece(self.model.piece_to_id("\u2581")) == "\u2581"
        self.by_word = plain and same and alone and not any("\u2581" in p.lstrip("\u2581") or (p.startswith("\u2581\u2581") and p.strip("\u2581")) for p in pieces)
        self.words = _Chunks(self.model)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.by_word:
            return len(self.model.encode(text))
        if "\u2581" in text or "  " in text or text[0] == " " or text[-1] == " ":
            return sum(map(self.words.__getitem__, _marked_words(text)))
        return sum(map(self.words.__getitem__, text.split(" ")))


def _marked_words(text: str) -> Iterator[str]:
    """Runs of word marks, each with the characters up to the next run; the first mark, which the model puts
    before any text, is left out of each."""
    run = 1
    for part in ("\u2581" + text.replace(" ", "\u2581")).split("\u2581")[1:]:
        if part:
            yield "\u2581" * (run - 1) + part
            run = 1
        else:
            run += 1
    if run > 1:
        yield "\u2581" * (run - 2)


class JsonCounter:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()

    def count(self, text: str) -> int:
        return len(self.model.encode(text, add_special_tokens=False).ids)


class RankCounter:
    def __init__(self, path: str, pattern: str):
        self.model = encoder(path, pattern)

    def count(self, text: str) -> int:
        return self.model.count(text)


@lru_cache(maxsize=4)
def counter(path: str, pattern: str = "") -> PieceCounter | JsonCounter | RankCounter:
    if path.endswith(".model"):
        return PieceCounter(path)
    return JsonCounter(path) if path.endswith(".json") else RankCounter(path, pattern)


def version_of(path: str, pattern: str = "") -> str:
    """Digest of the tokenizer: its file, its kind and its pattern."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + path.rpartition(".")[2].encode() + pattern.encode()).hexdigest()


def read_cache(spark, cache_path: str, version: str, run: str = "") -> DataFrame:
    """(digest, n_tokens, cached) of one tokenizer version, cached unless only ``run`` has stored it; a folder that does
    not exist yet is an empty cache."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "digest binary, n_tokens long, cached boolean")
    stored = spark.read.schema(_SCHEMA).parquet(cache_path).where(F.col("version") == version)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"), F.bool_or(F.coalesce(F.col("run") != run, F.lit(True))).alias("cached"))


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each digest of the task, so that a text with very many copies is not shuffled once for each."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = [d not in seen and not seen.add(d) for d in batch.column(0).to_pylist()]
        yield batch.filter(pa.array(keep, pa.bool_()))


def _encode_distinct(path: str, pattern: str, version: str, run_id: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _first_seen(batches):
            count = counter(path, pattern).count
            n = [count(t.as_py()) for t in batch.column(1)]
            yield pa.record_batch([pa.array([version] * len(n), pa.string()), pa.array([run_id] * len(n), pa.string()), batch.column(0), pa.array(n, pa.int64())], names=["version", "run", "digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, cache_path: str, pattern: str = "", limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", with_cached: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit and, if wanted, cached), one row for each row of docs; appends to the cache first.

    cached tells whether the count was stored before. Null texts are empty: no bytes, no tokens. Rows keep their
    repeats and null ids. An empty table gives no rows and leaves the cache as it was. A run that dies before its
    append commits leaves no counts behind. Where the cache knows something, the digests that it misses are found
    first, and only their texts are shuffled.
    """
    spark, version = docs.sparkSession, version_of(path, pattern)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    run, known = uuid.uuid4().hex, read_cache(spark, cache_path, version).select("digest")
    misses, some = keyed.select("digest", "text").mapInArrow(_first_seen, "digest binary, text string"), True
    if not known.isEmpty():
        digests = keyed.select("digest").mapInArrow(_first_seen, "digest binary").distinct()
        missing = cut(digests.join(known, "digest", "left_anti"))
        misses, some = misses.join(missing, "digest", "left_semi"), not missing.isEmpty()
    if some:
        misses.repartition("digest").mapInArrow(_encode_distinct(path, pattern, version, run), _SCHEMA).write.mode("append").parquet(cache_path)
    counts = cut(read_cache(spark, cache_path, version, run))  # an aggregate in the join's stage would keep Spark from splitting a hot digest
    rows = keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return rows.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), *(["cached"] if with_cached else []))
