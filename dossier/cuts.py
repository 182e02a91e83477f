"""Cutting lineage: tables written into the folder that all executors share, and read back."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: spark.checkpoint.dir.

    Where it is unset, a temporary one in local mode (tests), as driver and executors are one process there; an error on
    a cluster, whose executors would write where nobody reads.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="dossier-"))
        where = sc.getCheckpointDir()
    return where.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    Later stages then depend on files that every executor sees, so a lost executor costs no recomputation
    of what lies before the cut. Each call takes a folder of its own.
    """
    path = f"{scratch_dir(df.sparkSession)}/dossier-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
