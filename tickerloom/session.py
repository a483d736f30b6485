"""Session-level helpers: recommended settings and shared scratch folders."""

from __future__ import annotations

import math
import os
import uuid

from pyspark.sql import SparkSession

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # no look at the Python stack for every column expression; wide plans have thousands
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


#: Rows of a task where a stage holds and sorts them several times (about 1 KB a row of bars).
ROWS_A_TASK = 100_000


def local_session(cpus: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tickerloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the cluster's shared checkpoint folder, gone when the session ends.

    ``spark.checkpoint.dir`` (or ``SparkContext.setCheckpointDir``) names storage every executor
    can reach. Only a ``local`` master, where driver and executors are one process, may leave
    both unset; its JVM's temporary folder serves then. Anywhere else that is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = context._jvm.java.lang.System.getProperty("java.io.tmpdir")
    path = os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def materialised(df, name: str = "table"):
    """``df`` written once to the shared folder and read back.

    Cuts the lineage with storage that survives lost executors; used before algorithms
    that pass over the same data many times.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df, *keys, rows: int | None = None, each: int | None = None):
    """``df`` by the hash of ``keys`` (in turn, without any) in tasks of about ``each`` rows.

    Adaptive execution merges partitions up to a number of compressed bytes, which sorts and
    windows blow up many times; a given number of partitions stays and grows with the rows, so a
    task's memory does not. ``df`` should be a stored table, whose rows are counted from its
    footers, or come with their number. What fits one task is left as it is.
    """
    parts = math.ceil((df.count() if rows is None else rows) / (each or ROWS_A_TASK))
    return df.repartition(parts, *keys) if parts > 1 else df


def kept(df, name: str, rows: int):
    """``df`` written once if it has more ``rows`` than one task; what fits one task is derived again."""
    return materialised(df, name) if rows > ROWS_A_TASK else df
