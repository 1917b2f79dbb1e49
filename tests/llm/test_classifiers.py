import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavewright.llm import langid, quality, queries


def rank_auc(score, label):
    pos, neg = score[label == 1], score[label == 0]
    return np.mean([(np.sum(p > neg) + 0.5 * np.sum(p == neg)) / len(neg) for p in pos])


def test_quality_query(spark, sf):
    big = sf.replace("0.001", "0.1")
    found = queries.op5_rule_ensemble(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").toPandas()
    assert (found.held_out == found.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    held = found[found.held_out]
    assert rank_auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.97
    assert held[held.quality == 1].predicted.mean() > 0.97 and (found.predicted == (found.score >= 0.3)).all()
    assert found.score.between(0, 1).all()


def test_column_equals_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, len(quality.STATISTICS)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(int)
    model = quality.fit(x, y)
    assert 0 < len(model.rules) < 120 and rank_auc(model.score(x), y) > 0.95
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{s} double" for s in quality.STATISTICS))
    assert np.array([r[0] for r in df.select(model.column()).collect()]) == pytest.approx(model.score(x))


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "word " * 100_000, 0.5), (None, "a b c", 0.5), (1, None, 0.5), (4, "\n\n  \n", 0.5), (5, "Ordinary words, as they come.", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 0), (3, 0, 0), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality.score_documents(docs, labels).collect()
    assert len(found) == 7 and all(0 <= r["score"] <= 1 for r in found)
    assert quality.score_documents(docs.limit(0), labels).isEmpty()
    assert {r["score"] for r in quality.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == 7
    assert quality.keep_good(docs.limit(0), labels).isEmpty()


def test_statistics():
    assert quality.statistics(None) == quality.statistics(" \n ") == (0.0,) * len(quality.STATISTICS)
    named = dict(zip(quality.STATISTICS, quality.statistics("WORD!! OTHER!! 12 %%%\nWORD!! OTHER!! 12 %%%"), strict=True))
    assert named["upper"] == 0.5 and named["distinct_lines"] == 0.5 and named["bare_symbols"] == 0.25


def test_language_query(spark, sf):
    big = sf.replace("0.001", "0.1")
    found = queries.op7_centroids(spark, big).join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    assert (found.held_out == found.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    held = found[found.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and found.score.between(0, 1).all() and not found.rejected.any()


def test_gram_counts(monkeypatch):
    whole = langid.gram_counts("Héllo, wörld 12 " * 700)
    for span in (64, 100, 101):
        monkeypatch.setattr(langid, "_SPAN", span)
        assert (langid.gram_counts("Héllo, wörld 12 " * 700) == whole).all()
    assert langid.gram_counts(None) is None and langid.gram_counts("12 !?") is None and langid.gram_counts("A").sum() > 0


def test_languages(spark):
    en, fr = "the house and the garden of this town with that river", "la maison et le jardin de cette ville avec une rivière"
    rows = [(i, (en if i % 2 else fr) + f" {'abc'[i % 3]}", "en" if i % 2 else "fr", 1) for i in range(60)]
    rows += [(100, None, "en", 1), (101, "12 34", "fr", 1), (102, "", None, 1), (None, en, "en", 1), (103, "qzx " * 400, None, 1), (103, "qzx " * 400, None, 1), (104, "漢字かな交じり文" * 50, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    found = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert all(found[i]["lang_pred"] == ("en" if i % 2 else "fr") for i in range(60))
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 and found[i]["rejected"] for i in (100, 101, 102))
    assert found[103]["rejected"] and found[104]["rejected"] and found[103]["lang_pred"] in ("en", "fr")
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == 61
    assert langid.identify(docs.limit(0)).isEmpty() and langid.keep_identified(docs.limit(0)).isEmpty()
    unlearned = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlearned.collect()} == {"und"}


def test_foreign_texts_are_rejected(spark, sf):
    model = langid.learn(spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet"))
    rng = np.random.default_rng(3)
    polish = "wczoraj wieczorem poszliśmy nad rzekę żeby zobaczyć jak zachodzi słońce a potem wróciliśmy powoli do domu przez ciemny las w którym śpiewały jeszcze ptaki moja babcia zawsze powtarzała że najlepszy chleb piecze się w drewnianym piecu".split()
    finnish = "eilen illalla kävelimme järven rannalle katsomaan auringonlaskua ja palasimme sitten hitaasti kotiin pimeän metsän läpi jossa linnut vielä lauloivat isoäitini sanoi aina että paras leipä paistetaan puulämmitteisessä uunissa".split()
    gibberish = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(3, 10)))) for _ in range(10_000)]
    for n in (100, 300, 1000, 10_000):
        texts = [" ".join(rng.choice(polish, n)), " ".join(rng.choice(finnish, n)), " ".join(gibberish[:n])]
        assert model.predict(texts)[2].all(), n
    short = ["Reouti anatha. 19.37.233.111", "Dans mentierment de ierpation eauen éê éch des.", 'Onst ator re reinged in anthouat. token = "5f367f08b1a810c7777ad785b0be42018"', "Ating. " * 300]
    assert not model.predict(short)[2].any()


def test_one_odd_text_does_not_widen_the_radius():
    rng = np.random.default_rng(2)
    words = ["house", "garden", "river", "town", "street", "bridge", "window", "morning"]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(300)]
    fitted = lambda more: langid.fit(np.stack([langid.gram_counts(t) for t in texts + more]), np.array(["en"] * (len(texts) + len(more)), object))
    odd = "zqx vkj wqz pfy jxk qvv " * 10
    stranger = "ørsted gyldig højskole smørrebrød æble længe " * 10
    assert fitted([]).predict([stranger])[2][0] and fitted([odd]).predict([stranger])[2][0]


def plain_statistics(text):
    """The statistics of a text, a character and a word at a time."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(quality.STATISTICS)
    n, chars = len(words), len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    plain, marks, ends = ".,;:!?", ".,;:!?'\"()-", ".,;:!?'\")"
    pairs = {(a, b) for a, b in zip(words, words[1:], strict=False)}
    stops = sum(1 for i, c in enumerate(text) if c in ".!?" and (i + 1 == chars or text[i + 1].isspace()))
    letters = [c for c in text if c.isalpha()]
    share = lambda test, of: sum(1 for x in of if test(x)) / len(of)
    named = {
        "n_words": np.log1p(n), "n_lines": np.log1p(len(lines)), "mean_word": sum(len(w) for w in words) / n, "distinct_words": len(set(words)) / n,
        "top_word": max(words.count(w) for w in set(words)) / n, "distinct_lines": len(set(lines)) / len(lines), "top_line": max(lines.count(x) for x in set(lines)) / len(lines) if len(lines) > 1 else 0.0,
        "upper": share(lambda w: w[0].isupper(), words), "digit": share(str.isdigit, text), "space": share(str.isspace, text),
        "symbol": share(lambda c: not (c.isspace() or c.isdigit() or c.isalpha() or c in marks), text), "non_ascii": sum(1 for c in letters if c > "\x7f") / max(1, len(letters)),
        "punct_ended": share(lambda w: w[-1] in plain, words), "upper_words": share(str.isupper, words),
        "symbol_words": share(lambda w: not (w[-1].isalnum() or w[-1] in ends and (len(w) < 2 or w[-2].isalnum())), words), "bare_symbols": share(lambda w: not any(c.isalnum() for c in w), words),
        "long_words": share(lambda w: len(w) > 20, words), "stop_short": share(lambda w: len(w) <= 3, words), "bigram_repeat": 1 - len(pairs) / max(1, n - 1),
        "sentence_words": np.log1p(n / max(1, stops)), "longest_line": max(len(x) for x in lines) / chars, "mean_line": np.log1p(chars / len(lines)),
    }
    return [float(named[s]) for s in quality.STATISTICS]


def test_quality_query_against_plain_scores(spark, sf):
    """Every row's statistics, rules and score, one document at a time."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet").toPandas() for t in ("documents", "labels"))
    stats = {r.doc_id: plain_statistics(r.text) for r in docs.itertuples()}
    for r in docs.itertuples():
        assert quality.statistics(r.text) == pytest.approx(stats[r.doc_id], abs=1e-9)
    taught = {r.doc_id: int(r.quality) for r in labels.itertuples() if r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5}
    rows = sorted([taught[d], *map(float, quality.statistics(t))] for d, t in zip(docs.doc_id, docs.text, strict=True) if d in taught)
    model = quality.fit(np.array([r[1:] for r in rows]), np.array([r[0] for r in rows]))
    found = {r["doc_id"]: r for r in queries.op5_rule_ensemble(spark, sf).collect()}
    for r in docs.itertuples():
        z, x = model.intercept, quality.statistics(r.text)
        for rule in model.rules:
            if all(x[f] > t if above else x[f] <= t for f, above, t in rule.tests):
                z += rule.weight
        score = 1 / (1 + np.exp(-z))
        got = found[r.doc_id]
        assert got["score"] == pytest.approx(score, abs=1e-9) and got["predicted"] == int(got["score"] >= 0.3)


def test_lasso_is_optimal():
    """Against the conditions that hold at the optimum only."""
    rng = np.random.default_rng(8)
    m = (rng.random((400, 12)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * m[:, 0] - 1.5 * m[:, 3])))).astype(float)
    penalty = 5e-3
    intercept, w = quality._lasso(m, y, penalty, rounds=6000)
    a = (m - m.mean(axis=0)) / np.maximum(m.std(axis=0), 1e-3)
    slope = a.T @ (1 / (1 + np.exp(-(m @ w + intercept))) - y) / len(y)
    assert abs(np.mean(1 / (1 + np.exp(-(m @ w + intercept))) - y)) < 1e-6
    assert (np.abs(slope[np.abs(w) > 1e-9] + penalty * np.sign(w[np.abs(w) > 1e-9])) < 1e-5).all() and (np.abs(slope[np.abs(w) <= 1e-9]) <= penalty + 1e-6).all()
    assert w[0] > 0 > w[3] and (np.abs(w) <= 1e-9).any()


def test_repeated_ids_teach_once(spark, monkeypatch):
    """A doc_id that is repeated very often brings no more rows to the driver than any other."""
    seen = []
    fit, lang_fit = quality.fit, langid.fit
    monkeypatch.setattr(quality, "fit", lambda x, y, *a: seen.append(len(y)) or fit(x, y, *a))
    monkeypatch.setattr(langid, "fit", lambda counts, langs, *a: seen.append(len(langs)) or lang_fit(counts, langs, *a))
    docs = spark.range(20_000).selectExpr("if(id < 19000, 3, id) as doc_id", "concat('some words of text ', id % 7) as text", "'en' as lang")
    labels = spark.createDataFrame([(3, 1), (19_500, 0), (19_501, 1)], "doc_id long, quality int")
    quality.score_documents(docs, labels).count()
    quality.keep_good(docs, labels).count()
    taught = sum(zlib.crc32(str(d).encode()) % 5 > 0 for d in (3, 19_500, 19_501))
    langid.learn(docs)
    assert seen[:2] == [taught, taught] and 0 < seen[2] <= 1000


def plain_grams(text):
    """Hashed counts of 1- to 3-grams in a dictionary, a character at a time."""
    c = [32, *(ord(x) if x.isalpha() else 32 for x in (text or "").lower()), 32]
    if set(c) == {32}:
        return None
    counts, full = {}, 2**32

    def add(h):
        h = (((h ^ (h >> 15)) * 2654435761) % full) >> 21
        counts[h] = counts.get(h, 0) + 1

    for i, x in enumerate(c):
        if i and x != 32:
            add(x * 2654435761 % full)
        if i >= 1 and (c[i - 1], x) != (32, 32):
            add((c[i - 1] * 2246822519 % full) ^ (x * 3266489917 % full))
        if i >= 2 and c[i - 1] != 32:
            add((c[i - 2] * 668265263 % full) ^ (c[i - 1] * 374761393 % full) ^ (x * 2869860233 % full))
    return counts


def test_language_query_against_dictionaries(spark, sf):
    """TF-IDF vectors and cosines with every centroid, one document at a time."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.learn(docs)
    found = {r["doc_id"]: r for r in queries.op7_centroids(spark, sf).collect()}
    for r in docs.toPandas().itertuples():
        counts, got = plain_grams(r.text), found[r.doc_id]
        if counts is None:
            assert got["lang_pred"] == "und" and got["score"] == 0
            continue
        weights = {h: np.log1p(n) * model.idf[h] for h, n in counts.items()}
        norm = np.sqrt(sum(x * x for x in weights.values()))
        cos = [sum(x * centre[h] for h, x in weights.items()) / norm for centre in model.centres]
        assert got["score"] == pytest.approx(max(0.0, min(1.0, max(cos))), abs=2e-5)
        assert cos[[i for i, k in enumerate(model.of) if model.langs[k] == got["lang_pred"]][int(np.argmax([cos[i] for i, k in enumerate(model.of) if model.langs[k] == got["lang_pred"]]))]] == pytest.approx(max(cos), abs=2e-5)
