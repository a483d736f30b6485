"""Incremental operators on Structured Streaming.

Every stream can run with the ``availableNow`` trigger and then equals the batch operator
over the same input. The caller names the checkpoint folder: a later call with the same
folder goes on where the last one ended. Sinks are idempotent: a batch that is replayed
after a failure overwrites its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickerloom.operators.joins import keep_latest
from tickerloom.session import dealt, materialised
from tickerloom.sources.readers import has_files
from tickerloom.sources.writers import write_partitions

BATCH = "batch_id"


def stream_table(spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None,
                 files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
                  mode: str = "append") -> StreamingQuery:
    """Process everything new since the last run with this ``checkpoint``; the ended query tells its progress."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return query


def log_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Each batch becomes one folder; replaying a batch overwrites the same folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    return write


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All batches written by ``log_sink``, with their ``batch_id``."""
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/{BATCH}=*")


def compact_log(spark: SparkSession, path: str, schema: T.StructType, keys, precedence: list[str]) -> None:
    """Resolve all batches but the newest into one: its newest row per key.

    The newest batch may still be replayed and is left alone. Older folders are emptied only
    after the resolved rows stand; in between, rows are doubled but resolve to the same ones.
    """
    log = read_log(spark, path, schema)
    batches = sorted(r[0] for r in log.select(BATCH).distinct().collect())  # ids of batches since the last compaction
    if len(batches) < 3:
        return
    *old, target, _ = batches
    done = log.where(F.col(BATCH) <= target)
    order = [*[F.col(c) for c in precedence], F.col(BATCH)]
    resolved = materialised(keep_latest(done, list(keys), order).drop(BATCH), "compacted")
    resolved.write.mode("overwrite").parquet(f"{path}/{BATCH}={target}")
    for batch in old:
        resolved.limit(0).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch}")


# ---- X1: ticks to daily bars -----------------------------------------------------------
def daily_bars(ticks: DataFrame, lateness: str = "2 days") -> DataFrame:
    """One-day bars from (ticker, ts, event_id, price); works on streams and tables.

    Ties on the timestamp are ordered by ``event_id``. Ticks later than ``lateness`` behind
    the newest one may be dropped by a stream.
    """
    order = F.struct("ts", "event_id")
    day = F.window("ts", "1 day")
    source = ticks.withWatermark("ts", lateness) if ticks.isStreaming else ticks
    return source.groupBy("ticker", day.alias("w")).agg(
        F.min_by("price", order).alias("open_Price"),
        F.max("price").alias("high_Price"),
        F.min("price").alias("low_Price"),
        F.max_by("price", order).alias("close_Price"),
        F.count(F.lit(1)).alias("trade_Volume"),
    ).select(
        F.col("w.start").cast("date").alias("date"), "ticker", "open_Price", "high_Price", "low_Price",
        "close_Price", "trade_Volume",
    )


def newest_version(log: DataFrame, keys) -> DataFrame:
    """The last written row per key of an update-mode log."""
    return keep_latest(log, list(keys), [F.col(BATCH)]).drop(BATCH)


# ---- X2: keep the newest row per key ---------------------------------------------------
def deduplicating_sink(path: str, keys, precedence: list[str]) -> Callable[[DataFrame, int], None]:
    """Log of each batch's newest row per key; ``newest_per_key`` resolves across batches."""
    write = log_sink(path)

    def dedupe(batch: DataFrame, batch_id: int) -> None:
        write(keep_latest(batch, list(keys), [F.col(c) for c in precedence]), batch_id)

    return dedupe


def first_deliveries(stream: DataFrame, keys, event_time: str, lateness: str) -> DataFrame:
    """Each key once, in the row that came first; deliveries of it that follow are dropped.

    The state holds a key until the watermark is ``lateness`` past its event time, so its size
    follows the rows of that span, not those of the stream. A repeat with the same event time
    that comes later still is behind the watermark and dropped for that reason. Rows whose first
    delivery is later than ``lateness``, and rows without an event time or key, are left out.
    """
    known = stream.na.drop(subset=[*keys, event_time])
    return known.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(list(keys))


def newest_per_key(log: DataFrame, keys, precedence: list[str]) -> DataFrame:
    return keep_latest(log, list(keys), [*[F.col(c) for c in precedence], F.col(BATCH)]).drop(BATCH)


# ---- X3: keyed upsert of a stored table ------------------------------------------------
def upserting_sink(path: str, version: str, partition: str = "year",
                   keys=("ticker", "date")) -> Callable[[DataFrame, int], None]:
    """Merge each batch of bars by key into a table partitioned by ``year(date)``.

    The larger ``version`` wins, within the batch and against the stored row; of equal ones
    the later batch. Rows of other keys stay. Only the years a batch touches are read and
    rewritten. Replaying a batch replaces the same rows by themselves.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.count()
        fresh = keep_latest(dealt(batch, *keys, rows=rows), list(keys), [F.col(version)])
        years = [r[0] for r in fresh.select(F.year("date")).distinct().collect()]  # calendar years
        if not years:
            return
        merged = fresh.withColumn("_new", F.lit(1))
        if has_files(spark, path):
            old = spark.read.parquet(path).where(F.col(partition).isin(*years)).drop(partition)
            rows += old.count()
            merged = old.withColumn("_new", F.lit(0)).unionByName(merged)
        merged = keep_latest(dealt(merged, *keys, rows=rows), list(keys), [F.col(version), F.col("_new")]).drop("_new")
        write_partitions(merged.withColumn(partition, F.year("date")), path, partition)

    return merge


# ---- X4: running state per ticker ------------------------------------------------------
RUNNING_STATE = T.StructType([
    T.StructField("last_close", T.DoubleType()),
    T.StructField("streak", T.LongType()),
    T.StructField("obv", T.DoubleType()),
    T.StructField("ema", T.DoubleType()),
    T.StructField("rows", T.LongType()),
])
RUNNING_OUTPUT = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("ticker", T.StringType()),
    T.StructField("momentum", T.DoubleType()),
    T.StructField("obv", T.DoubleType()),
    T.StructField("ema", T.DoubleType()),
])


def running_indicators(bars: DataFrame, span: int = 20) -> DataFrame:
    """Momentum streak, OBV and exponential mean, carried across micro-batches.

    A micro-batch must not hold dates before those already seen of a ticker. The state is
    five numbers per ticker, whatever the history; a batch is computed on whole columns.
    """
    alpha = 2.0 / (span + 1.0)

    def advance(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, streak, obv, ema, rows = state.get if state.exists else (None, 0, 0.0, None, 0)
        held = list(frames)
        new = (held[0] if len(held) == 1 else pd.concat(held)).sort_values("date")
        close = new["close_Price"].to_numpy(np.float64)
        n = len(close)
        before = np.concatenate([[close[0] if rows == 0 else last], close[:-1]])
        change = close - before
        way = np.where(change >= 0, 1, -1)
        flow = new["trade_Volume"].to_numpy(np.float64) * np.sign(change)
        if rows == 0:
            way[0] = 0
        # length of the run of equal signs that ends in each row; the first run may go on from the state
        at = np.arange(n)
        begins = np.concatenate([[True], way[1:] != way[:-1]])
        run = at - np.maximum.accumulate(np.where(begins, at, 0)) + 1
        carried = abs(streak) if rows and streak * way[0] > 0 else 0
        first = np.cumsum(begins) == 1
        streaks = way * (run + np.where(first, carried, 0))
        volume = obv + np.cumsum(flow)
        start = [] if rows == 0 else [ema]
        smooth = pd.Series([*start, *close]).ewm(alpha=alpha, adjust=False).mean().to_numpy()[len(start):]
        shown = np.where(rows + at + 1 >= span, smooth, np.nan)
        state.update((float(close[-1]), int(streaks[-1]), float(volume[-1]), float(smooth[-1]), int(rows + n)))
        out = pd.DataFrame({"date": new["date"].to_numpy(), "ticker": key[0], "momentum": streaks.astype(np.float64),
                            "obv": volume, "ema": np.where(np.isnan(shown), None, shown)})
        yield out

    # every column of every group is converted on its own
    return bars.select("ticker", "date", "close_Price", "trade_Volume").groupBy("ticker").applyInPandasWithState(
        advance, RUNNING_OUTPUT, RUNNING_STATE, "append", GroupStateTimeout.NoTimeout
    )


# ---- X5: stream against static tables --------------------------------------------------
def filtered_ticks(ticks: DataFrame, blacklist: DataFrame, info: DataFrame) -> DataFrame:
    """Ticks of tickers that are not blacklisted, with their country."""
    return (
        ticks.join(blacklist.select("ticker"), "ticker", "left_anti")
        .join(info.select("ticker", "country"), "ticker", "left")
    )
