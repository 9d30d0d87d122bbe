"""Lineage cuts: a table in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a folder of this machine, if the whole session runs on it; else an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = "file://" + os.path.join(tempfile.gettempdir(), "maskwright-shared")
    return d


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table in the shared folder; what is written there is deleted when the application ends."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes a stage and reads it back: later plans start from its files, and it survives the loss of executors."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def wide(df: DataFrame, least_bytes: int = 32 << 20) -> DataFrame:
    """``df`` in enough partitions for all cores, where the estimated size is so small that Spark would give a few tasks all the work.

    For stages that spend much time on each row. Tables of over ``least_bytes`` a core are left as they are, so nothing large is shuffled for it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size < cores * least_bytes else df
