"""Sinks. Spark's commit protocol makes writes whole or absent; nothing is overwritten."""

from __future__ import annotations

import hashlib
import io
import os
import shutil

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import json_safe
from ..functions.errors import AuditError
from ..operators.digests import table_digest


def write_case_csv(df: DataFrame, path: str, folder: str = "series_id") -> None:
    """time, value, label with 17 significant digits, one file for each series, in a folder named for it."""
    rows = df.select(F.col("series_id").alias(folder), F.col("t").alias("time"), F.format_string("%.17g", "value").alias("value"), F.col("label").cast("int").alias("label"))
    rows.repartition(folder).sortWithinPartitions(folder, "time").write.mode("errorifexists").partitionBy(folder).csv(path, header=True)


def write_cases(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Packed or long cases as Parquet, partitioned by split, domain or the like."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_rows_csv(df: DataFrame, path: str) -> None:
    """Metric rows; an empty table is refused."""
    if df.isEmpty():
        raise AuditError("no rows to write")
    df.write.mode("errorifexists").csv(path, header=True, nullValue="", emptyValue="")


def write_json(df: DataFrame, path: str) -> None:
    """Documents, a line each, with null in place of numbers that JSON lacks."""
    kinds = dict(df.dtypes)
    safe = df.select(*(json_safe(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns))
    safe.write.mode("errorifexists").json(path)


def response(df: DataFrame, name: str = "body") -> DataFrame:
    """Each row as one JSON text."""
    kinds = dict(df.dtypes)
    return df.select(F.to_json(F.struct(*(json_safe(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns))).alias(name))


def write_with_receipt(df: DataFrame, path: str) -> dict:
    """Write Parquet and return the digest of what was written, which a rebuild must equal whatever its files."""
    write_cases(df, path)
    found = table_digest(df.sparkSession.read.parquet(path)).first()
    return {"path": path, "rows": found["rows"], "digest": found["digest"]}


def verify_receipt(spark, receipt: dict) -> None:
    """AuditError if the table is not the one that the receipt names."""
    if table_digest(spark.read.parquet(receipt["path"])).first()["digest"] != receipt["digest"]:
        raise AuditError(f"{receipt['path']} differs from its receipt")


def write_bundle(path: str, arrays: dict[str, np.ndarray]) -> str:
    """Named weight arrays as one npz file on the driver, put in place whole; its digest."""
    data = io.BytesIO()
    np.savez(data, **arrays)
    with open(f"{path}.part", "wb") as file:
        file.write(data.getvalue())
    os.replace(f"{path}.part", path)
    return hashlib.sha256(data.getvalue()).hexdigest()


def package_files(sources: dict[str, tuple[str, str]], target: str) -> dict[str, str]:
    """Copy (path, SHA-256) files under their names into a new folder, each only if its digest holds; the manifest."""
    for name, (path, wanted) in sources.items():
        with open(path, "rb") as file:
            if hashlib.file_digest(file, "sha256").hexdigest() != wanted:
                raise AuditError(f"{name} differs from its digest")
    os.makedirs(target)  # an existing folder is refused
    for name, (path, _) in sources.items():
        shutil.copyfile(path, f"{target}/{name}.part")
        os.replace(f"{target}/{name}.part", f"{target}/{name}")
    return {name: wanted for name, (_, wanted) in sources.items()}
