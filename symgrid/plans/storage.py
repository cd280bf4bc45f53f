"""Cutting lineage through a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in ``spark.checkpoint.dir``; only where the session has none, in a temporary folder.

    A checkpoint would compute the last stage twice and write rows as they are in memory, uncompressed.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None) or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="symgrid-"))
    at = f"{sc.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` over as many tasks as a shuffle has, for a join that makes many rows of each: what is small on disk is read by few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
