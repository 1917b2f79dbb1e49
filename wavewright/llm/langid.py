"""Language identification by nearest centroids.

Whole texts become hashed character n-gram counts (1 to 3 characters, words bounded by a space), weighted by
TF-IDF and scaled to length one. Each language has several centroids from spherical k-means, and a text takes
the language of the centroid with the largest cosine. A text is rejected if it has no letter or if its distance
is beyond the radius seen in training for texts of its language and about its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WIDTH = 2048
CENTROIDS = 4
#: Bounds of the rows that the centroids are fitted on: of each language, and in all (least by a hash of the id).
FIT_ROWS, FIT_ROWS_ALL = 1000, 8_000
#: Up to so many languages, their counts are broadcast.
MOST_LANGUAGES = 10_000
#: A text is too far below this share of the low quantile of the cosines seen for texts of its language and size.
REACH, LOW = 0.5, 0.01
#: Texts that a quantile is taken of, at least: those of the size, then the next smaller ones.
LOW_ROWS = 50
#: Size classes: half powers of two of the number of distinct grams.
SIZES = 2 * WIDTH.bit_length()
UNKNOWN = "und"
_SPAN = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((c.isalpha() for c in map(chr, range(0x110000))), bool, 0x110000)


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of a whole text's n-grams by hash; None if it has no letter."""
    low = (text or "").lower()
    counts = np.zeros(WIDTH, np.int64)
    letters = False
    for at in range(0, len(low), _SPAN):  # bounded memory; the last two characters are seen again for grams over the border
        codes = np.frombuffer(low[max(0, at - 2) : at + _SPAN].encode("utf-32-le", "surrogatepass"), "<u4")
        c = np.where(_letters()[codes], codes, 32)
        again = min(at, 2)
        letters |= bool((c[again:] != 32).any())
        if at == 0:
            c = np.concatenate([[32], c])
            again = 1
        if at + _SPAN >= len(low):
            c = np.concatenate([c, [32]])
        c = c.astype(np.uint32)
        fresh = np.arange(len(c)) >= again
        one, two, three = c, c[1:], c[2:]
        h1 = one * np.uint32(2654435761)
        h2 = c[:-1] * np.uint32(2246822519) ^ two * np.uint32(3266489917)
        h3 = c[:-2] * np.uint32(668265263) ^ c[1:-1] * np.uint32(374761393) ^ three * np.uint32(2869860233)
        for h, keep in (
            (h1, (one != 32) & fresh),
            (h2, ((c[:-1] != 32) | (two != 32)) & fresh[1:]),
            (h3, (c[1:-1] != 32) & fresh[2:]),
        ):
            h = h[keep]
            counts += np.bincount((h ^ (h >> np.uint32(15))) * np.uint32(2654435761) >> np.uint32(21), minlength=WIDTH)
    return counts if letters else None


@dataclass(frozen=True)
class Centroids:
    langs: tuple[str, ...]
    of: np.ndarray  # language number of each centroid
    centres: np.ndarray
    idf: np.ndarray
    #: Low quantile of the cosines seen in training for each language and size class.
    low: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts, dtype=np.float32) * self.idf.astype(np.float32)
        return v / np.maximum(np.sqrt((v * v).sum(axis=-1, keepdims=True)), 1e-30)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text."""
        found = [gram_counts(t) for t in texts]
        langs, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        at = [i for i, c in enumerate(found) if c is not None]
        if not at or not self.langs:
            return langs, score, rejected
        counts = np.stack([found[i] for i in at])
        cos = self.vectors(counts) @ self.centres.T
        best = np.argmax(cos, axis=1)
        near = np.clip(cos[np.arange(len(at)), best].astype(np.float64), 0.0, 1.0)
        far = near < REACH * self.low[self.of[best], size_class(counts)]
        for i, b, s, r in zip(at, best, near, far, strict=True):
            langs[i], score[i], rejected[i] = self.langs[self.of[b]], s, r
        return langs, score, rejected


def size_class(counts: np.ndarray) -> np.ndarray:
    """By distinct grams, so that a few words said again and again count as the short text that they are."""
    return (2 * np.log2(np.maximum((counts > 0).sum(axis=-1), 1))).astype(np.int64)


def _low_quantiles(cos: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A low quantile of the cosines of one language's texts for each size class. Below the smallest size with
    LOW_ROWS texts of it or smaller, too few were seen for a bound, and it falls with the number of grams."""
    out = np.zeros(SIZES)
    order = np.argsort(-sizes, kind="stable")
    cos, sizes = cos[order], sizes[order]
    first = int(sizes[-min(LOW_ROWS, len(sizes))])
    for c in range(first, SIZES):
        out[c] = np.quantile(cos[sizes <= c][: max(LOW_ROWS, int((sizes == c).sum()))], LOW)
    out[:first] = out[first] * 2.0 ** ((np.arange(first) - first) / 2)
    return out


def _kmeans(v: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Spherical k-means with spread-out starts."""
    centres = v[:1] * 0 + v.mean(axis=0)
    centres /= np.sqrt((centres**2).sum(axis=1, keepdims=True))
    while len(centres) < min(k, len(v)):
        far = np.maximum(1 - (v @ centres.T).max(axis=1), 1e-12)
        centres = np.concatenate([centres, v[rng.choice(len(v), p=far.astype(np.float64) / far.sum(dtype=np.float64))][None]])
    for _ in range(rounds):
        mine = np.argmax(v @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, mine, v)
        norms = np.sqrt((sums**2).sum(axis=1, keepdims=True))
        centres = np.where(norms > 0, sums / np.maximum(norms, 1e-30), centres)
    return centres


def fit(counts: np.ndarray, langs: np.ndarray, seed: int = 0) -> Centroids:
    """counts: one row of n-gram counts for each text, all of texts with letters."""
    names = tuple(sorted(set(langs.tolist())))
    if not names:
        return Centroids((), np.zeros(0, int), np.zeros((0, WIDTH)), np.ones(WIDTH), np.zeros((0, SIZES)))
    rng = np.random.default_rng(seed)
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 0.1
    blank = Centroids(names, np.zeros(0, int), np.zeros((0, WIDTH)), idf, np.zeros((len(names), SIZES)))
    v = blank.vectors(counts)
    parts = [_kmeans(v[langs == name], CENTROIDS, rng) for name in names]
    of, centres = np.repeat(np.arange(len(names)), list(map(len, parts))), np.concatenate(parts)
    sizes = size_class(counts)
    low = [_low_quantiles((v[langs == name] @ part.T).max(axis=1), sizes[langs == name]) for name, part in zip(names, parts, strict=True)]
    return Centroids(names, of, centres, idf, np.stack(low))


def is_held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Centroids:
    """Fit on rows that are not held out and have a language: FIT_ROWS of each language at most, FIT_ROWS_ALL in all. Of
    rows repeated under one id and language the least vector of counts teaches, so that no more come to the driver."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and id is not null")
    rows = rows.where(~is_held_out(F.col("id"))).select("id", "lang", F.xxhash64("id", F.lit(7)).alias("h"))
    # a first cut by hash leaves about four times the rows wanted of each language, so that none is sorted whole
    counts = cut(rows.groupBy("lang").agg(F.count("*").alias("of_lang")))
    if counts.count() <= MOST_LANGUAGES:  # else Spark deals the rows by language for the join
        counts = F.broadcast(counts)
    below = F.col("h") < F.least(F.lit(1.0), 4.0 * FIT_ROWS / F.col("of_lang")) * 2.0**64 - 2.0**63
    some = rows.join(counts, "lang").where((F.col("of_lang") <= 4 * FIT_ROWS) | below).select("id", "lang", "h").distinct()
    some = some.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).where(f"n <= {FIT_ROWS}")
    some = some.orderBy("n", "h").limit(FIT_ROWS_ALL).select(F.col("id").alias("__id"), F.col("lang").alias("__lang")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [gram_counts(t.as_py()) for t in batch.column(1)]
            keep = pa.array([c is not None for c in counts], pa.bool_())
            packed = pa.array([None if c is None else c.astype("<u4").tobytes() for c in counts], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(2), packed], names=["h", "lang", "counts"]).filter(keep)

    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    picked = picked.join(F.broadcast(some), (F.col("id") == F.col("__id")) & (F.col("lang") == F.col("__lang"))).select("id", "text", "lang")
    found = picked.mapInArrow(run, "h long, lang string, counts binary").groupBy("h", "lang").agg(F.min("counts").alias("counts")).toPandas().sort_values(["h", "lang", "counts"])
    counts = np.stack([np.frombuffer(c, "<u4") for c in found["counts"]]) if len(found) else np.zeros((0, WIDTH))
    return fit(counts, found["lang"].to_numpy(object))


def identify(docs: DataFrame, model: Centroids | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected), one row for each row of docs; no shuffle.

    score is the cosine with the nearest centroid. Null, empty and letterless texts get ``und``, score 0 and are
    rejected; so do all texts if nothing could be learned. A null doc_id is not held out and teaches nothing.
    An empty table gives no rows.
    """
    model = model or learn(docs, id_col, text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                langs, score, rejected = model.predict(some.column(2).to_pylist())
                yield pa.record_batch([some.column(0), some.column(1), pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(F.col(id_col).cast("long")).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, with its columns, whose text is not rejected; texts are not shuffled."""
    model = learn(docs, id_col, text_col, lang_col)

    @F.arrow_udf("boolean")
    def stays(texts: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([~model.predict(texts.slice(at, 1024).to_pylist())[2] for at in range(0, len(texts), 1024)] or [np.zeros(0, bool)]))

    return docs.where(stays(F.col(text_col).cast("string")))
