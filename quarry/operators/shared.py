"""Scratch tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh_path(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``; a local folder serves only a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quarry.scratch.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that all executors of {master} share")
        root = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("quarry.scratch.dir", root)
    return f"{root.rstrip('/')}/quarry-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Writes a table below ``spark.checkpoint.dir`` and reads it again, which cuts the lineage."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
