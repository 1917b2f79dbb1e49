"""Shared pieces: lineage cuts in the cluster's checkpoint folder, Arrow maps, table reads."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own; a cluster
    gets none, as its machines do not share one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = sc.getCheckpointDir()
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
            named = tempfile.mkdtemp(prefix="wavewright-checkpoint-")
            sc.setCheckpointDir(named)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Compute df once into the checkpoint folder and continue from there, so that later steps neither
    recompute it nor depend on the executors that made it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def arrow_map(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    """Apply fn to each Arrow batch of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def partitions_for(spark: SparkSession, rows: int, per_partition: int) -> int:
    """A partition count that keeps partitions at a bounded number of rows, at least the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))
