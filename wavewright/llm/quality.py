"""Quality scores from a sparse rule ensemble.

Whole-text statistics feed a few boosted trees; every root-to-node path becomes a conjunctive rule; lasso
logistic regression keeps the rules that matter; and the kept rules are compiled into one Spark column
expression over the statistics, so scoring runs inside the JVM.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Bound of the labelled rows that the ensemble is fitted on, least by a hash of the id.
FIT_ROWS = 20_000
#: A document is good from this score on.
GOOD = 0.3

STATISTICS = (
    "n_words", "n_lines", "mean_word", "distinct_words", "top_word", "distinct_lines", "top_line",
    "upper", "digit", "space", "symbol", "non_ascii", "punct_ended", "upper_words", "symbol_words", "bare_symbols",
    "long_words", "stop_short", "bigram_repeat", "sentence_words", "longest_line", "mean_line",
)

_DROP_LETTERS = str.maketrans("", "", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_END = re.compile(r"[.!?]+(?:\s|$)")


def statistics(text: str | None) -> tuple[float, ...]:
    """Statistics of a whole text; all 0 for null, empty and blank texts. Every one but the three sizes is a share."""
    text = text or ""
    words = text.split()
    if not words:
        return (0.0,) * len(STATISTICS)
    n, chars = len(words), len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    counts, line_counts = Counter(words), Counter(lines)
    rest = text.translate(_DROP_LETTERS)
    other = Counter(rest)
    digit = symbol = letters = blank = 0
    for c, m in other.items():
        if c.isspace():
            blank += m
        elif c.isdigit():
            digit += m
        elif c.isalpha():
            letters += m
        elif c not in ".,;:!?'\"()-":
            symbol += m
    upper = sum(map(str.isupper, words))
    ascii_letters = chars - len(rest)
    ends = sum(w[-1] in ".,;:!?" for w in words)
    odd = sum(m for w, m in counts.items() if not (w[-1].isalnum() or w[-1] in ".,;:!?'\")" and (len(w) < 2 or w[-2].isalnum())))
    bare = sum(m for w, m in counts.items() if not any(map(str.isalnum, w)))
    capitals = sum(m for c, m in Counter(w[0] for w in words).items() if c.isupper())
    pairs = Counter(zip(words, words[1:], strict=False))
    lengths = list(map(len, words))
    return (
        float(np.log1p(n)),
        float(np.log1p(len(lines))),
        sum(lengths) / n,
        len(counts) / n,
        max(counts.values()) / n,
        len(line_counts) / len(lines),
        max(line_counts.values()) / len(lines) if len(lines) > 1 else 0.0,
        capitals / n,
        digit / chars,
        blank / chars,
        symbol / chars,
        letters / max(1, letters + ascii_letters),
        ends / n,
        upper / n,
        odd / n,
        bare / n,
        sum(x > 20 for x in lengths) / n,
        sum(x <= 3 for x in lengths) / n,
        1 - len(pairs) / max(1, n - 1),
        float(np.log1p(n / max(1, len(_END.findall(text))))),
        max(map(len, lines)) / chars,
        float(np.log1p(chars / len(lines))),
    )


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, one double for each statistic), a row for each row of docs; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.array([statistics(t.as_py()) for t in batch.column(1)], np.float64).reshape(batch.num_rows, len(STATISTICS))
            yield pa.record_batch([batch.column(0), *(pa.array(m[:, i]) for i in range(len(STATISTICS)))], names=["doc_id", *STATISTICS])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


@dataclass(frozen=True)
class Rule:
    """All of (statistic, is_above, threshold) hold; above means >."""

    tests: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, t in self.tests:
            out &= (x[:, f] > t) if above else (x[:, f] <= t)
        return out

    def column(self, statistic: Callable[[int], Column]) -> Column:
        out = F.lit(True)
        for f, above, t in self.tests:
            c = statistic(f)
            out = out & ((c > F.lit(float(t))) if above else (c <= F.lit(float(t))))
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for r in self.rules:
            z += r.weight * r.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self, statistic: Callable[[int], Column] = lambda f: F.col(STATISTICS[f])) -> Column:
        """The score as one column expression; ``statistic`` gives the column of a statistic's number."""
        z = F.lit(float(self.intercept))
        for r in self.rules:
            z = z + F.when(r.column(statistic), F.lit(float(r.weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _paths(x: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int) -> tuple[list[tuple], np.ndarray]:
    """One gradient tree over binned statistics: the paths to its nodes and its step for each row."""
    step, paths = np.zeros(len(x)), []

    def grow(rows: np.ndarray, tests: tuple, left: int) -> None:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if left and len(rows) >= 2 * least:
            for f, edges in enumerate(cuts):
                if not len(edges):
                    continue
                size = len(edges) + 1
                b = binned[rows, f]
                gs, hs, ns = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
                gain = gs**2 / (hs + 1) + (total_g - gs) ** 2 / (total_h - hs + 1) - total_g**2 / (total_h + 1)
                gain = np.where((ns >= least) & (len(rows) - ns >= least), gain, 0)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], f, i)
        if best[1] is None:
            step[rows] = -total_g / (total_h + 1)
            return
        _, f, i = best
        low = binned[rows, f] <= i
        for side, above in ((rows[low], False), (rows[~low], True)):
            path = (*tests, (f, above, float(cuts[f][i])))
            paths.append(path)
            grow(side, path, left - 1)

    grow(np.arange(len(x)), (), depth)
    return paths, step


def _lasso(m: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all but the intercept, by accelerated proximal steps."""
    n, k = m.shape
    scale = np.maximum(m.std(axis=0), 1e-3)
    a = np.concatenate([(m - m.mean(axis=0)) / scale, np.ones((n, 1))], axis=1)
    v = np.ones(k + 1)
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.sqrt((v * v).sum())
    rate = 4 * n / max(1e-9, float(np.sqrt((((a.T @ (a @ v)) ** 2).sum()))))
    w, u, t = np.zeros(k + 1), np.zeros(k + 1), 1.0
    for _ in range(rounds):
        nxt = u - rate * (a.T @ (1 / (1 + np.exp(-(a @ u))) - y)) / n
        nxt[:-1] = np.sign(nxt[:-1]) * np.maximum(np.abs(nxt[:-1]) - rate * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, w, t = nxt + (t - 1) / t2 * (nxt - w), nxt, t2
    weights = w[:-1] / scale
    return float(w[-1] - (weights * m.mean(axis=0)).sum()), weights


def fit(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 3, penalty: float = 2e-3, seed: int = 0) -> RuleEnsemble:
    """Fit on statistics and 0/1 labels. Without labels, with one label only, or if nothing tells them apart, every
    score is the smoothed share of label 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    flat = RuleEnsemble(float(np.log(share / (1 - share))), ())
    if len(y) == 0 or y.min() == y.max():
        return flat
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1])) for f in range(x.shape[1])]
    cuts = [c[c < x[:, f].max()] for f, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    z, paths = np.full(len(y), flat.intercept), {}
    least = max(2, len(y) // 1000)
    for _ in range(trees):
        some = np.sort(rng.permutation(len(y))[: max(min(len(y), 200), len(y) // 2)])
        p = 1 / (1 + np.exp(-z[some]))
        found, _ = _paths(x[some], cuts, binned[some], p - y[some], p * (1 - p), depth, least)
        paths |= dict.fromkeys(found)
        p = 1 / (1 + np.exp(-z))
        z = z + 0.3 * np.clip(_paths(x, cuts, binned, p - y, p * (1 - p), depth, least)[1], -4, 4)
    if not paths:
        return flat
    rules = [Rule(tests) for tests in paths]
    m = {r.holds(x).tobytes(): r for r in reversed(rules)}  # rules that hold on the same rows are one
    rules = list(reversed(m.values()))
    m = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64)
    intercept, weights = _lasso(m, y.astype(np.float64), penalty)
    return RuleEnsemble(intercept, tuple(Rule(r.tests, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6))


def is_held_out(id_col: Column, parts: int = 5, part: int = 0) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % parts == part, F.lit(False))


def _taught(labels: DataFrame) -> DataFrame:
    """(doc_id, quality): FIT_ROWS rows at most, least by a hash of the id; see score_documents.

    A first cut by hash leaves about twice as many rows, so that tasks send few rows on; if it leaves too few, all are
    ordered.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~is_held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).withColumn("h", F.xxhash64("doc_id"))
    known = cut(known)
    n = known.count()
    some = known.where(F.col("h") < int(-(2**63) + 2**64 * min(1.0, 2 * FIT_ROWS / n)) - 1) if n > 2 * FIT_ROWS else known
    if some is not known and some.count() < FIT_ROWS:
        some = known
    return cut(some.orderBy("h", "doc_id").limit(FIT_ROWS).drop("h"))


def _fit_on(sample: DataFrame) -> RuleEnsemble:
    """Fit on rows (id, quality, statistics); of rows repeated under one id the least counts, so FIT_ROWS bounds them."""
    sample = sample.groupBy("id").agg(F.min(F.struct("quality", *STATISTICS)).alias("row")).select("row.*")
    rows = sample.select("quality", *STATISTICS).toPandas().sort_values(["quality", *STATISTICS])
    return fit(rows[list(STATISTICS)].to_numpy(np.float64), rows["quality"].to_numpy(np.int64))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good: float = GOOD) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of docs.

    Labels are learned from rows that are not held out, FIT_ROWS of them at most (least by a hash of the id);
    null labels and ids teach nothing, and of repeated labels or rows of an id the lowest counts. Null and empty texts
    have statistics 0 and a score as any other. A null doc_id is not held out. Without any label the score is
    0.5. An empty table gives no rows.
    """
    stats = cut(with_statistics(docs, id_col, text_col))
    model = _fit_on(stats.join(F.broadcast(_taught(labels)), "doc_id").withColumnRenamed("doc_id", "id"))
    score = stats.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), model.column().alias("score"))
    return score.withColumn("predicted", F.when(F.col("score") >= good, 1).otherwise(0))


def _statistics_of(texts: pa.Array) -> pa.Array:
    rows = [statistics(t.as_py()) for t in texts]
    flat = pa.array(np.array(rows, np.float64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS)), flat)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good: float = GOOD) -> DataFrame:
    """The rows of docs, with its columns, whose text scores at least ``good``.

    Decided in one pass over the texts: statistics are made beside each row, the fitted rules are a filter over
    them, and texts are neither shuffled nor sent back from Python.
    """
    taught = F.broadcast(_taught(labels).withColumnsRenamed({"doc_id": "__id", "quality": "__quality"}))
    picked = docs.join(taught, F.col(id_col).cast("long") == F.col("__id")).select("__id", "__quality", F.col(text_col).cast("string").alias("__text"))
    picked = picked.withColumn("s", F.arrow_udf(_statistics_of, "array<double>")("__text"))
    model = _fit_on(picked.select(F.col("__id").alias("id"), F.col("__quality").alias("quality"), *(F.col("s")[i].alias(x) for i, x in enumerate(STATISTICS))))
    made = docs.withColumn("__statistics", F.arrow_udf(_statistics_of, "array<double>")(F.col(text_col).cast("string")))
    return made.where(model.column(lambda f: F.col("__statistics")[f]) >= good).drop("__statistics")
