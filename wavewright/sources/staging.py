"""The shared folder for tables between steps, and steps that must not be computed twice."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

from ..functions.errors import AuditError


def staging_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local session gets a folder of its own; a cluster
    gets none, as its machines do not share one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise AuditError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="wavewright-staging-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def settled(df: DataFrame) -> DataFrame:
    """df computed once into the shared folder, so that a lost executor changes nothing that was read from it."""
    staging_dir(df.sparkSession)
    return df.checkpoint(eager=True)
