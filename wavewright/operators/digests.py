"""Hashes of samples, files, documents and whole tables."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels
from .validate import require_empty


def prefix_digests(df: DataFrame, values: str = "values", length: str = "training_end", name: str = "prefix_digest") -> DataFrame:
    """Packed series with the digest of their normal prefix, over the raw bytes of doubles."""

    @F.pandas_udf("string")
    def run(x: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([kernels.prefix_hash(a, int(k)) for a, k in zip(x, n, strict=True)])

    return df.withColumn(name, run(values, length))


def array_digests(df: DataFrame, values: str = "values", dtype: str = "<f4", name: str = "digest") -> DataFrame:
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([kernels.array_hash(np.asarray(a), dtype) for a in x])

    return df.withColumn(name, run(values))


def json_digests(df: DataFrame, document: str, name: str = "digest") -> DataFrame:
    """Digest of JSON text in canonical form: sorted keys, no spaces."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else kernels.json_hash(json.loads(a)) for a in x])

    return df.withColumn(name, run(document))


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256, crc32) of files, read by executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), F.crc32("content").alias("crc32"))


def tree_digest(files: DataFrame, name: str = "path") -> DataFrame:
    """One digest of a set of files: of their sorted names and digests. A set of files is a bounded list."""
    lines = F.array_sort(F.collect_list(F.concat_ws(" ", name, "sha256")))
    return files.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("sha256"), F.count("*").alias("files"))


def table_digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(rows, digest): a digest of a table's content that does not depend on the order of its rows."""
    cols = columns or sorted(df.columns)
    row = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)"))
    sums = df.agg(F.count("*").alias("rows"), *(F.coalesce(part(i), F.lit(0)).alias(f"p{i}") for i in range(8)))
    return sums.select("rows", F.sha2(F.concat_ws("|", *(F.col(f"p{i}").cast("string") for i in range(8))), 256).alias("digest"))


def require_files(found: DataFrame, expected: dict[str, str]) -> None:
    """AuditError unless each named file has its digest."""
    spark = found.sparkSession
    wanted = spark.createDataFrame(list(expected.items()), "name string, wanted string")
    named = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")
    require_empty(wanted.join(named, "name", "left").where("sha256 is null or sha256 <> wanted"), "file differs")
