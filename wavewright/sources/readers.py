"""Sources: CSV series, archives, packed arrays, replays, uploads, file lists and configurations."""

from __future__ import annotations

import io
import json
import posixpath
import stat
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.errors import AuditError
from ..operators import validate
from ..operators.windows import number_samples

#: Names of columns, in lower case, in order of preference.
TIME_NAMES = ("timestamp", "time", "datetime", "date", "index")
SIGNAL_NAMES = ("value", "signal", "data", "observation")
LABEL_NAMES = ("label", "labels", "is_anomaly", "anomaly", "class")
#: Limits of an upload.
UPLOAD_LEAST, UPLOAD_MOST = 64, 250_000
#: Most domains that an archive scan is given.
MOST_DOMAINS = 100_000


def resolve_column(requested: str | None, columns: list[str], usual: tuple[str, ...]) -> str | None:
    """The requested column without regard to case (AuditError if there is none), else the first usual name."""
    low = {c.strip().lower(): c for c in columns}
    if requested is not None:
        if requested.strip().lower() not in low:
            raise AuditError(f"no column {requested!r}")
        return low[requested.strip().lower()]
    return next((low[n] for n in usual if n in low), None)


def resolve_signal(requested: str | None, columns: list[str], time: str | None, label: str | None) -> str:
    """As resolve_column; else the first column that is neither time nor label."""
    found = resolve_column(requested, columns, SIGNAL_NAMES)
    if found is None:
        found = next((c for c in columns if c not in (time, label)), None)
    if found is None:
        raise AuditError("no signal column")
    return found


def csv_header(spark: SparkSession, path: str) -> list[str]:
    line = spark.read.text(path).first()
    if line is None:
        raise AuditError(f"{path} is empty")
    return [c.strip() for c in next(iter(_rows(line[0].lstrip("﻿"))))]


def _rows(text: str) -> Iterator[list[str]]:
    import csv

    yield from csv.reader(io.StringIO(text))


def read_csv_series(spark: SparkSession, path: str, signal: str | None = None, label: str | None = None, time: str | None = None, max_rows: int | None = None, blank: str = "skip") -> DataFrame:
    """(series_id, t, t_raw, value, label) of CSV files with a header. blank: ``skip`` leaves rows without a signal
    out, ``error`` refuses them, ``zero`` reads 0. Rows keep their file order; values that are no finite number
    are refused."""
    columns = csv_header(spark, path)
    time_c, label_c = resolve_column(time, columns, TIME_NAMES), resolve_column(label, columns, LABEL_NAMES)
    signal_c = resolve_signal(signal, columns, time_c, label_c)
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.read.schema(schema).csv(path, header=True, mode="FAILFAST", enforceSchema=True).select("*", F.col("_metadata.file_path").alias("series_id"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row"))
    text = F.trim(F.col(f"`{signal_c}`"))
    empty = F.coalesce(text == "", F.lit(True))
    value = F.when(empty, F.lit(0.0)).otherwise(text.try_cast("double")) if blank == "zero" else text.try_cast("double")
    rows = raw.withColumn("value", value)
    if blank == "skip":
        rows = rows.where(~empty)
    validate.require_empty(rows.where(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))).select("series_id", F.col(f"`{signal_c}`").alias("signal")), "signal is no finite number")
    rows = number_samples(rows, ["series_id"], ["__block", "__row"], "ordinal")
    t, t_raw = validate.parse_time(F.col(f"`{time_c}`") if time_c else F.lit(None).cast("string"), F.col("ordinal"))
    flag = validate.parse_label(F.coalesce(F.col(f"`{label_c}`"), F.lit(""))) if label_c else F.lit(False)
    out = rows.select("series_id", F.col("ordinal").cast("long").alias("t"), t.alias("time"), t_raw.alias("t_raw"), "value", flag.alias("label"))
    return out.where(F.col("t") < max_rows) if max_rows is not None else out


def numeric_column(df: DataFrame, columns: list[str]) -> str:
    """The column with most numeric cells, the first of equals: for files without usable headers."""
    counts = df.agg(*(F.count_if(F.col(f"`{c}`").cast("string").try_cast("double").isNotNull()).alias(f"c{i}") for i, c in enumerate(columns))).first()
    return columns[max(range(len(columns)), key=lambda i: (counts[i], -i))]


def read_archive(spark: SparkSession, path: str, domains: DataFrame | None = None) -> DataFrame:
    """(member, fields of its name, signal, labels) of the CSV members of ZIP archives, listed and read by
    executors; names are parsed, and domains tested, before a member is read. Blank signals are refused; a positive
    label is any number but zero."""
    return archive_members(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content"), domains)


def archive_members(files: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """read_archive for archives (path, content) at hand. domains (source_collection, domain) are few: AuditError beyond
    MOST_DOMAINS, none is dropped. An archive is one cell, so it must be below 2 GB."""
    wanted = None
    if domains is not None:
        rows = domains.select("source_collection", "domain").distinct().limit(MOST_DOMAINS + 1).collect()
        if len(rows) > MOST_DOMAINS:
            raise AuditError(f"more than {MOST_DOMAINS} domains")
        wanted = {(r["source_collection"], r["domain"]) for r in rows}

    def run(batches):
        import re

        for pdf in batches:
            for archive, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in sorted(z.infolist(), key=lambda i: i.filename):
                        name = posixpath.basename(info.filename)
                        m = re.match(validate.FILE_NAME, name)
                        if m is None or (wanted is not None and (m[2], None) not in wanted and (m[2], m[4]) not in wanted):
                            continue
                        signal, labels = parse_member(z.read(info).decode("utf-8-sig"), name)
                        rows.append((archive, info.filename, name, m[2], int(m[3]), m[4], int(m[5]), int(m[6]), signal, labels))
                yield pd.DataFrame(rows, columns=["archive", "member", "file_name", "source_collection", "source_id", "domain", "training_end", "first_anomaly", "signal", "labels"])

    return files.mapInPandas(run, "archive string, member string, file_name string, source_collection string, source_id int, domain string, training_end long, first_anomaly long, signal array<double>, labels array<int>")


def parse_member(text: str, name: str) -> tuple[list[float], list[int]]:
    rows = list(_rows(text))
    if not rows:
        raise AuditError(f"{name} is empty")
    head = [c.strip() for c in rows[0]]
    label = resolve_column(None, head, LABEL_NAMES)
    if label is None:
        raise AuditError(f"{name} has no label column")
    s, k = head.index(resolve_signal(None, head, None, label)), head.index(label)
    try:
        signal, labels = [float(r[s]) for r in rows[1:] if r], [int(float(r[k]) != 0) for r in rows[1:] if r]
    except (ValueError, IndexError) as error:
        raise AuditError(f"{name} has a blank or malformed row") from error
    kernels.finite_window(signal)
    return signal, labels


def read_npz_cases(spark: SparkSession, path: str, signal: str = "signal", label: str = "labels") -> DataFrame:
    """(path, values, labels) of npz cases: 64 samples at least, not constant, labels optional."""
    return npz_cases(spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", "true").load(path).select("path", "content"), signal, label)


def npz_cases(files: DataFrame, signal: str = "signal", label: str = "labels") -> DataFrame:
    """read_npz_cases for files (path, content) at hand."""

    def run(batches):
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                a = kernels.read_npz(content)
                x = kernels.finite_window(a[signal], 64)
                if x.std() < 1e-10:
                    raise AuditError(f"{p} is constant")
                rows.append((p, x, a[label].astype(int) if label in a else [0] * x.size))
            yield pd.DataFrame(rows, columns=["path", "values", "labels"])

    return files.mapInPandas(run, "path string, values array<double>, labels array<int>")


def read_replay(spark: SparkSession, path: str, digest: str | None = None, n_conditions: int = 25, length: int = 512) -> DataFrame:
    """Conditions with their traces from Parquet: (condition_id, family, severity, replicate, identity, center, scale,
    method, values). Fails closed: one identity, the expected number of conditions and samples, finite values,
    and the table's digest if one is given."""
    from ..operators.digests import table_digest

    df = validate.require_schema(spark.read.parquet(path), {"condition_id": "string", "family": "string", "identity": "boolean", "method": "string", "values": "array<float>"})
    per = df.groupBy("method").agg(F.count_distinct("condition_id").alias("n"), F.count_if("identity").alias("i"))
    validate.require_empty(per.where((F.col("n") != n_conditions) | (F.col("i") != 1)), "wrong number of conditions")
    validate.require_empty(df.where((F.size("values") != length) | F.exists("values", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))).select("condition_id", "method"), "bad trace")
    if digest is not None and table_digest(df).first()["digest"] != digest:
        raise AuditError("replay differs from its manifest")
    return df


def read_traces(spark: SparkSession, path: str, expected: dict[str, int]) -> DataFrame:
    """Audit traces (domain, condition_id, method, values); AuditError unless each domain has its number of conditions."""
    df = spark.read.parquet(path)
    found = df.groupBy("domain").agg(F.count_distinct("condition_id").alias("n")).limit(len(expected) + 1).collect()
    counts = {r["domain"]: r["n"] for r in found}
    if counts != expected:
        raise AuditError(f"conditions by domain differ: {counts}")
    return df


def read_official_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct base names of the CSV files that a text file lists."""
    name = F.element_at(F.split(F.trim(F.regexp_replace("value", r"[\r,;\"]", "")), r"[/\\]"), -1)
    return spark.read.text(path).select(name.alias("file_name")).where(F.lower("file_name").endswith(".csv")).distinct()


def discover(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """(path, file_name, length) of files below a folder, contents not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length").orderBy("path")


def demo_series(spark: SparkSession, length: int = 512, seed: int = 2026) -> DataFrame:
    """The synthetic labelled case, its noise drawn inside a task: (series_id, t, value, label)."""

    def run(batches):
        for pdf in batches:
            for _ in range(len(pdf)):
                x, label = kernels.demo_series(length, seed)
                yield pd.DataFrame({"series_id": "demo", "t": range(length), "value": x, "label": label})

    return spark.range(1).coalesce(1).mapInPandas(run, "series_id string, t long, value double, label boolean")


def read_rows_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Metric rows written earlier; empty cells are null."""
    return spark.read.schema(schema).csv(path, header=True, nullValue="", mode="FAILFAST")


def read_latencies(spark: SparkSession, path: str, method: str) -> DataFrame:
    """(condition_id, latency_ms) of one method; one row for each condition."""
    rows = spark.read.schema("condition_id string, method string, latency_ms double").csv(path, header=True, mode="FAILFAST")
    return validate.require_unique(rows.where(F.col("method") == method).select("condition_id", "latency_ms"), ["condition_id"])


def upload(spark: SparkSession, values: list[float], labels: list | None = None, timestamps: list | None = None) -> DataFrame:
    """(series_id, t, t_raw, value, label) of an uploaded signal; refused unless it has 64 to 250,000 finite, not
    constant samples and equally many labels and timestamps. Labels above 0 are positive."""
    x = kernels.finite_window(values, UPLOAD_LEAST)
    if x.size > UPLOAD_MOST or x.std() < 1e-10:
        raise AuditError("uploads have 64 to 250,000 samples that are not constant")
    for other in (labels, timestamps):
        if other is not None and len(other) != x.size:
            raise AuditError("labels and timestamps are as many as values")
    pdf = pd.DataFrame({"series_id": "upload", "t": range(x.size), "t_raw": None if timestamps is None else list(map(str, timestamps)), "value": x, "label": False if labels is None else [float(v) > 0 for v in labels]})
    return spark.createDataFrame(pdf, "series_id string, t long, t_raw string, value double, label boolean")


def read_config(path: str, required: tuple[str, ...] = (), spark: SparkSession | None = None) -> dict:
    """A JSON object on the driver; AuditError if it is none or lacks a key. With a session the path may be anywhere
    that Spark reads."""
    if spark is not None:
        value = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).limit(2).collect()))
    else:
        with open(path, encoding="utf-8") as file:
            value = json.load(file)
    if not isinstance(value, dict) or set(required) - set(value):
        raise AuditError(f"{path}: not an object with {required}")
    return value


def read_bundle(data: bytes, expected_sha256: str | None = None) -> dict:
    """Named weight arrays of a model bundle, for scorers; refused if the digest differs."""
    import hashlib

    if expected_sha256 is not None and hashlib.sha256(data).hexdigest() != expected_sha256:
        raise AuditError("model bundle differs from its manifest")
    return kernels.read_npz(data)


def safe_member(name: str) -> str:
    """The normal form of an archive member's path; refused if it leaves the target folder."""
    path = posixpath.normpath(name.replace("\\", "/"))
    if path.startswith(("/", "../")) or path == ".." or ":" in path.split("/")[0]:
        raise AuditError(f"unsafe member {name!r}")
    return path


def extract_zip(source: str, target: str, max_bytes: int = 2**31) -> list[str]:
    """Members of a ZIP archive below target: no traversal, no links, no more bytes than allowed, checksums tested."""
    import os

    done, total = [], 0
    with zipfile.ZipFile(source) as z:
        for info in z.infolist():
            if info.is_dir():
                continue
            name = safe_member(info.filename)
            if stat.S_ISLNK(info.external_attr >> 16):
                raise AuditError(f"{name} is a link")
            total += info.file_size
            if total > max_bytes:
                raise AuditError("archive is too large")
            out = os.path.join(target, *name.split("/"))
            os.makedirs(os.path.dirname(out), exist_ok=True)
            with z.open(info) as src, open(out, "wb") as dst:
                while chunk := src.read(1 << 20):
                    dst.write(chunk)
            done.append(name)
    return done
