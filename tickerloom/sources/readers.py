"""Table, CSV and JSON sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.operators.tables import where_all

SYMBOL = "Symbol"


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, **criteria):
    """Parquet scan with optional filters, which reach the scan as pushed predicates."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return where_all(reader.parquet(path), **criteria)


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """CSV of symbols; the file must have a ``Symbol`` column."""
    df = spark.read.option("header", True).csv(path)
    if SYMBOL not in df.columns:
        raise ValueError(f"{path} has no column {SYMBOL!r}: {df.columns}")
    return df


BLACKLIST_ENTRY = "map<string, struct<reason: string, details: string, date_added: string, active: boolean>>"


def read_blacklist(spark: SparkSession, path: str) -> DataFrame:
    """JSON object keyed by ticker -> one row per ticker."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", BLACKLIST_ENTRY)).alias("ticker", "e")).select(
        "ticker", "e.reason", "e.details", "e.date_added", "e.active"
    )


def blacklist_object(df: DataFrame) -> DataFrame:
    """Blacklist rows -> the one JSON object of the file, keyed by ticker (one file's worth)."""
    entry = F.struct("reason", "details", "date_added", "active")
    cells = F.array_sort(F.collect_list(F.struct("ticker", entry.alias("e"))))
    return df.agg(F.to_json(F.map_from_entries(cells)).alias("value"))


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether a table was ever written to ``path``, in any file system Spark reads."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
