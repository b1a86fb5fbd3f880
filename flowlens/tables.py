"""Cutting lineage with written tables.

``cut`` writes a result once, as Parquet in the shared checkpoint folder, and goes on from there. The
written table survives the loss of executors, is read with column pruning and filter pushdown, and has
a known size: whether a join against it is broadcast is decided by Catalyst from that size
(``spark.sql.autoBroadcastJoinThreshold``), never by a hint. A table above the threshold is joined by
shuffle, where adaptive execution splits hot keys.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without that setting gets a
    temporary folder, since on a cluster a machine-local folder is lost with its machine.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, name: str = "table") -> str:
    return f"{checkpoint_folder(spark).rstrip('/')}/flowlens-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and go on from the written rows."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
