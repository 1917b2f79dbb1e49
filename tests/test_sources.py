"""Readers, sinks, protocols and jobs on generated files."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavewright.functions import kernels
from wavewright.functions.errors import AuditError
from wavewright.operators import digests, scorers
from wavewright.plans import analysis, benchmark, protocol
from wavewright.sources import readers, sinks
from wavewright.streaming import monitor


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv(spark, tmp_path):
    df = readers.read_csv_series(spark, write(tmp_path / "a.csv", "Data,Label\n1.25,0\n2.5,1\n3.75,normal\n,1\n"))
    assert [(r["t"], r["value"], r["label"]) for r in df.orderBy("t").collect()] == [(0, 1.25, False), (1, 2.5, True), (2, 3.75, False)]
    bom = readers.read_csv_series(spark, write(tmp_path / "b.csv", "﻿time,value\n5,1\nx,2\n"))
    assert [(r["time"], r["t_raw"]) for r in bom.orderBy("t").collect()] == [(5, None), (None, "x")]
    with pytest.raises(AuditError):
        readers.read_csv_series(spark, write(tmp_path / "c.csv", "value\n1\ninf\n"))
    with pytest.raises(AuditError):
        readers.read_csv_series(spark, str(tmp_path / "a.csv"), signal="none")
    assert readers.read_csv_series(spark, str(tmp_path / "a.csv"), max_rows=1).count() == 1
    zero = readers.read_csv_series(spark, str(tmp_path / "a.csv"), blank="zero")
    assert zero.count() == 4
    assert [r["file_name"] for r in readers.discover(spark, str(tmp_path)).collect()] == ["a.csv", "b.csv", "c.csv"]


def archive(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, (signal, labels) in members.items():
            z.writestr(name, "Data,Label\n" + "".join(f"{s!r},{int(k)}\n" for s, k in zip(signal.tolist(), labels, strict=True)))
    return str(path)


def members(n=6, size=1200):
    out = {}
    for i, gid in enumerate(["001", "002", "003", "004", "005", "010"][:n]):
        rng = np.random.default_rng(1 if gid in ("001", "002") else i + 10)
        x = np.round(rng.normal(size=size), 6)
        label = np.zeros(size, bool)
        label[700:720] = True
        x[700:720] += i + 3
        out[f"{gid}_{'XFER' if gid == '010' else 'UCR'}_id_{i}_Sensor_tr_600_1st_700.csv"] = (x, label)
    return out


def test_primary_protocol(spark, tmp_path):
    src = readers.read_archive(spark, archive(tmp_path / "a.zip", members()))
    assert src.count() == 6
    names = {m[:3]: m for m in members()}
    official = lambda *ids: spark.createDataFrame([(names[i],) for i in ids], "file_name string")
    args = (src, official("001", "010"), official("003"), protocol.ProtocolSettings())
    windows, manifest = protocol.primary_protocol(*args)
    split = {r["file_name"][:3]: r["split"] for r in windows.select("file_name", "split").distinct().collect()}
    assert split["001"] == split["010"] == "test" and split["003"] == "validation" and split["004"] == split["005"] == "train"
    assert {r["n"] for r in windows.select(F.size("signal").alias("n")).distinct().collect()} == {512}
    event = windows.where("kind = 'event'").first()
    assert event["window_start"] == 709 - 256 and sum(event["labels"]) == 20
    assert {r["eligible_events"] for r in manifest.collect()} == {1}
    tables = {"windows": windows.drop("signal"), "manifest": manifest}
    locked = protocol.lock(tables)
    again = protocol.primary_protocol(*args)
    protocol.verify_lock({"windows": again[0].drop("signal"), "manifest": again[1]}, locked)
    with pytest.raises(AuditError):
        protocol.verify_lock({**tables, "manifest": manifest.limit(1)}, locked)
    bad = members()
    first = next(iter(bad))
    bad[first][1][10] = True
    with pytest.raises(AuditError):
        protocol.primary_protocol(readers.read_archive(spark, archive(tmp_path / "b.zip", bad)), official("001"), official("003"), protocol.ProtocolSettings())


def test_confirmation_protocol(spark, tmp_path):
    src = readers.read_archive(spark, archive(tmp_path / "a.zip", members())).withColumn("domain_key", F.lit("sensor"))
    src = src.withColumn("official_split", F.when(F.col("file_name").startswith("002"), "tuning").otherwise("evaluation"))
    prior = protocol.with_groups(src).where(F.col("file_name").startswith("003")).select("prefix_digest")
    out = protocol.confirmation_protocol(src, prior, protocol.ProtocolSettings(window=128, seed=9, longest_event=30))
    groups = out["groups"].collect()
    assert len(groups) == 3 and sum(g["partition"] == "calibration" for g in groups) == 1
    reasons = sorted(r["reason"] for r in out["exclusions"].collect())
    assert reasons == ["exact_normal_prefix_seen_in_prior_protocol", "group_not_exclusively_official_evaluation"]
    kinds = {(r["partition"], r["kind"]) for r in out["windows"].select("partition", "kind").distinct().collect()}
    assert kinds == {("calibration", "normal"), ("confirmation", "normal"), ("confirmation", "event")}


def test_archive_rules(spark, tmp_path):
    with pytest.raises(AuditError):
        readers.parse_member("Data,Label\n,0\n", "x")
    with pytest.raises(AuditError):
        readers.parse_member("Data\n1\n", "x")
    with zipfile.ZipFile(tmp_path / "evil.zip", "w") as z:
        z.writestr("../x.txt", "x")
    with pytest.raises(AuditError):
        readers.extract_zip(str(tmp_path / "evil.zip"), str(tmp_path / "out"))
    archive(tmp_path / "ok.zip", members(1))
    assert len(readers.extract_zip(str(tmp_path / "ok.zip"), str(tmp_path / "out"))) == 1


def test_other_sources(spark, tmp_path):
    np.savez(tmp_path / "x.npz", signal=np.sin(np.arange(100.0)))
    assert readers.read_npz_cases(spark, str(tmp_path)).first()["labels"] == [0] * 100
    names = write(tmp_path / "list.txt", "file\na/b/001_X.csv\n001_X.csv\r\n002.csv,\n")
    assert sorted(r[0] for r in readers.read_official_list(spark, names).collect()) == ["001_X.csv", "002.csv"]
    demo = readers.demo_series(spark).toPandas()
    assert len(demo) == 512 and demo.label.sum() == 23 and demo.value.to_numpy() == pytest.approx(kernels.demo_series()[0])
    up = readers.upload(spark, list(np.arange(64.0)), labels=[0] * 63 + [2])
    assert up.where("label").count() == 1
    for values in ([1.0] * 64, [1.0, 2.0], [float("inf")] * 64):
        with pytest.raises(AuditError):
            readers.upload(spark, values)
    with pytest.raises(AuditError):
        readers.upload(spark, list(np.arange(64.0)), labels=[0])
    assert readers.read_config(write(tmp_path / "c.json", json.dumps({"a": 1})), ("a",)) == {"a": 1}
    data = io.BytesIO()
    np.savez(data, w=np.ones(2))
    assert readers.read_bundle(data.getvalue())["w"].tolist() == [1, 1]
    with pytest.raises(AuditError):
        readers.read_bundle(data.getvalue(), "0" * 64)


def test_replay_source(spark, tmp_path):
    rows = [(str(i), "none" if i == 0 else "gaussian", 0.0 if i == 0 else 0.5, 0, i == 0, "m", [float(i)] * 8) for i in range(5)]
    df = spark.createDataFrame(rows, "condition_id string, family string, severity double, replicate int, identity boolean, method string, values array<float>")
    path = str(tmp_path / "replay")
    receipt = sinks.write_with_receipt(df, path)
    assert readers.read_replay(spark, path, receipt["digest"], 5, 8).count() == 5
    sinks.verify_receipt(spark, receipt)
    for options in ({"digest": "0"}, {"n_conditions": 4}, {"length": 9}):
        with pytest.raises(AuditError):
            readers.read_replay(spark, path, **{"n_conditions": 5, "length": 8, **options}).count()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, 0.1, True), ("a", 1, float("nan"), False)], "series_id string, t long, value double, label boolean")
    sinks.write_case_csv(df, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True).orderBy("time").collect()
    assert float(back[0]["value"]) == 0.1 and back[0]["label"] == "1"
    assert [r["body"] for r in sinks.response(df).collect()][1] == '{"series_id":"a","t":1,"label":false}'
    sinks.write_json(df, str(tmp_path / "json"))
    with pytest.raises(AuditError):
        sinks.write_rows_csv(df.limit(0), str(tmp_path / "rows"))
    sinks.write_rows_csv(df, str(tmp_path / "rows"))
    assert readers.read_rows_csv(spark, str(tmp_path / "rows"), "series_id string, t long, value double, label boolean").count() == 2
    a, b = digests.table_digest(df.repartition(3)).first(), digests.table_digest(df).first()
    assert a == b
    files = digests.file_digests(spark, str(tmp_path / "csv"), "*.csv")
    assert digests.tree_digest(files).first()["files"] == files.count()


def windows_table(spark, n=4, size=64):
    rng = np.random.default_rng(0)
    rows = [("even" if i % 2 else "odd", f"g{i // 2}", f"w{i}", rng.normal(size=size).tolist(), [20 <= t < 25 for t in range(size)], False) for i in range(n)]
    return spark.createDataFrame(rows, "domain string, source_group_id string, window_id string, values array<double>, labels array<boolean>, identity boolean")


def test_benchmark_job(spark, tmp_path):
    w = windows_table(spark)
    c = benchmark.conditions(w, "t", ("gaussian",), (0.5,))
    witness = [scorers.Witness("A", scorers.magnitude, 1.0)]
    receipts = benchmark.evaluate(c, witness, str(tmp_path / "job"))
    benchmark.audit(spark, receipts)
    frozen = benchmark.freeze({"windows": w}, {"x": 1})
    benchmark.verify_freeze({"windows": w}, frozen)
    with pytest.raises(AuditError):
        benchmark.verify_freeze({"windows": w.limit(1)}, frozen)
    grid = benchmark.WAVELET_GRID[:2]
    chosen = benchmark.select(benchmark.tune(c, grid, kernels.wavelet_shrink), grid)
    assert chosen["config"] in grid and len(benchmark.WAVELET_GRID) == 18 and len(benchmark.SPECTRAL_GRID) == 12
    s = benchmark.summary(benchmark.waveform_rows(c))
    assert s.count() == 5 and benchmark.parity(s, s, ["method"], {"overall_os_nrmse": 0.0}).isEmpty()
    off = s.withColumn("overall_os_nrmse", F.col("overall_os_nrmse") + 1e-6)
    assert not benchmark.parity(off, s, ["method"], {"overall_os_nrmse": 1e-9}).isEmpty()
    assert scorers.traces(c, ["condition_id"], ["median_w3"], timed=True).count() == 4
    assert benchmark.selected_windows(w).count() == 2


def test_inference(spark):
    out = analysis.inference(windows_table(spark), ["window_id"], lambda x, k: x + (k - 1) * 0.1, 3).first()
    assert len(out["output"]) == 64 and max(out["mad"]) == pytest.approx(0.1)
    r = windows_table(spark).select("window_id", F.posexplode("values").alias("t", "value"))
    assert analysis.request_window(r, ["window_id"], 40, 20).groupBy("window_id").count().first()["count"] == 64


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, f"2024-01-01 00:{i:02d}:00", float(i)) for i in range(20)], "k long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = monitor.windowed_rates(stream, ["k"], "ts", "value", 10.0, "10 minutes").writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["n"], r["crossings"]) for r in spark.table("rates").collect()) == [(10, 0), (10, 10)]
    q = monitor.causal_scores(stream, "k", "value", 4).writeStream.outputMode("append").format("memory").queryName("scores").start()
    q.processAllAvailable()
    q.stop()
    got = [r["score"] for r in spark.table("scores").orderBy("ts").collect()]
    assert got[:4] == [0.0] * 4 and got[10] == pytest.approx(2.5**2)


def test_bundles_and_packages(spark, tmp_path):
    digest = sinks.write_bundle(str(tmp_path / "m.npz"), {"w": np.ones(3)})
    assert readers.read_bundle((tmp_path / "m.npz").read_bytes(), digest)["w"].tolist() == [1, 1, 1]
    sources = {"m.npz": (str(tmp_path / "m.npz"), digest)}
    assert sinks.package_files(sources, str(tmp_path / "out")) == {"m.npz": digest}
    with pytest.raises(FileExistsError):
        sinks.package_files(sources, str(tmp_path / "out"))
    with pytest.raises(AuditError):
        sinks.package_files({"m.npz": (str(tmp_path / "m.npz"), "0")}, str(tmp_path / "other"))
    found = digests.file_digests(spark, str(tmp_path / "out"))
    digests.require_files(found, {"m.npz": digest})
    with pytest.raises(AuditError):
        digests.require_files(found, {"m.npz": "0"})
