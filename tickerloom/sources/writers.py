"""Durable, restartable writes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tickerloom.session import shared_folder


def write_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Replace exactly the partitions present in ``df``.

    ``df`` may be computed from the table at ``path`` itself: it is staged in the shared
    folder first, so the overwrite never reads what it deletes, and a crash before the
    final commit leaves the old table whole.
    """
    spark = df.sparkSession
    stage = shared_folder(spark, "stage")
    df.write.partitionBy(partition).parquet(stage)
    (
        spark.read.parquet(stage)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_blacklist(spark: SparkSession, path: str, rows: dict[str, dict]) -> None:
    """The blacklist file: one JSON object keyed by ticker."""
    text = json.dumps(rows, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
