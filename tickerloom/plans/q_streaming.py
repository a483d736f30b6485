"""X: incremental operators run as streams over everything available, compared as tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.plans.domain import ticker_of
from tickerloom.plans.registry import query
from tickerloom.session import shared_folder
from tickerloom.streaming import incremental as inc

OHLC = "open_Price high_Price low_Price close_Price"


PARTS = 4
#: Rows of an arriving file; larger parts arrive in several files, written by as many tasks.
ROWS_A_FILE = 1_000_000


def _in_parts(d, rows, part, run, schema=None):
    """Feeds ``rows`` to a stream in PARTS parts, one micro-batch each, in two runs.

    ``part`` numbers the part of each row. Every part has the same number of files, so that a
    micro-batch takes exactly one. ``run(stream, checkpoint)`` is called when half of the parts
    are there and again, with the same checkpoint, when all are.
    """
    folder, checkpoint = shared_folder(d.spark, "arriving"), shared_folder(d.spark, "checkpoint")
    schema = schema or rows.schema
    files = math.ceil(rows.count() / PARTS / ROWS_A_FILE) or 1
    for k in range(PARTS):
        share = rows.where(part == k).select(*schema.names)
        share = share.coalesce(1) if files == 1 else share.repartition(files, *schema.names)
        share.write.mode("append").parquet(folder)
        for _ in range(files * (k + 1) - len(d.spark.read.schema(schema).parquet(folder).inputFiles())):
            share.limit(0).coalesce(1).write.mode("append").parquet(folder)  # for a task without rows
        if k in (PARTS // 2 - 1, PARTS - 1):
            run(inc.stream_table(d.spark, folder, schema, files_per_batch=files), checkpoint)


def _mixed(*cols):
    """Files in which neither dates nor keys are in order."""
    return F.pmod(F.xxhash64(*cols), F.lit(PARTS))


def _tick_columns(e):
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), ticker_of(F.col("user_id")).alias("ticker"),
                    F.col("value").alias("price"))


@query("X01_daily_bars", """
SELECT CAST(ts AS DATE) AS date, ticker, arg_min(price, event_id) AS open_Price, max(price) AS high_Price, min(price) AS low_Price,
       arg_max(price, event_id) AS close_Price, count(*) AS trade_Volume FROM ticks GROUP BY 1, 2""", OHLC)
def _(d):
    path = shared_folder(d.spark, "bars")
    e = d.raw("events")
    bars = []

    def run(stream, checkpoint):
        bars.append(inc.daily_bars(_tick_columns(stream)))
        inc.run_available(bars[-1], inc.log_sink(path), checkpoint, "update")

    span = e.agg(F.min("ts"), F.max("ts")).first()
    width = (span[1] - span[0]) / PARTS
    edges = [span[0] + width * k for k in range(1, PARTS)]
    # files in the order of time; rows near an edge arrive a file late, within the lateness
    late = F.pmod(F.xxhash64("event_id"), F.lit(24)).cast("int")
    shifted = F.col("ts") - F.make_interval(hours=late)
    part = sum((F.when(shifted >= F.lit(x), 1).otherwise(0) for x in edges), F.lit(0))
    _in_parts(d, e, part, run)
    schema = T.StructType([*bars[0].schema.fields, T.StructField(inc.BATCH, T.LongType())])
    return inc.newest_version(inc.read_log(d.spark, path, schema), ["ticker", "date"])


@query("X02_deduplicate", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1", "value")
def _(d):
    path = shared_folder(d.spark, "newest")
    keys = ["user_id", "event_type"]
    e = d.raw("events").select(*keys, "event_id", "value")
    schema = T.StructType([*e.schema.fields, T.StructField(inc.BATCH, T.LongType())])

    def run(stream, checkpoint):
        inc.run_available(stream, inc.deduplicating_sink(path, keys, ["event_id"]), checkpoint)
        inc.compact_log(d.spark, path, schema, keys, ["event_id"])

    _in_parts(d, e, _mixed("event_id"), run)
    return inc.newest_per_key(inc.read_log(d.spark, path, schema), keys, ["event_id"])


@query("X02_first_deliveries", "SELECT event_id, user_id, event_type, value FROM events", "value")
def _(d):
    """Every fifth event is delivered again, in its own file and in the next one."""
    path = shared_folder(d.spark, "first")
    names = ["event_id", "user_id", "event_type", "value"]
    e = d.raw("events").select(*names, F.col("ts").cast("timestamp").alias("ts"))
    span = e.agg(F.min("ts"), F.max("ts")).first()
    width = (span[1] - span[0]) / PARTS
    part = sum((F.when(F.col("ts") >= F.lit(span[0] + width * k), 1).otherwise(0) for k in range(1, PARTS)), F.lit(0))
    again = F.sequence(F.lit(0), F.when(F.col("event_id") % 5 == 0, 2).otherwise(0))
    sent = e.withColumn("part", part).withColumn("_k", F.explode(again))
    sent = sent.withColumn("part", F.least(F.col("part") + (F.col("_k") == 2).cast("int"), F.lit(PARTS - 1)))
    schema = T.StructType([*e.schema.fields, T.StructField(inc.BATCH, T.LongType())])

    def run(stream, checkpoint):
        inc.run_available(inc.first_deliveries(stream, ["event_id"], "ts", "1 day"), inc.log_sink(path), checkpoint)

    _in_parts(d, sent, F.col("part"), run, e.schema)
    return inc.read_log(d.spark, path, schema).select(*names)


@query("X03_upsert", "SELECT * FROM bars", OHLC)
def _(d):
    """Bars out of order, every third one first in a wrong older version."""
    path = shared_folder(d.spark, "table")
    right = d.bars.withColumn("version", F.lit(2)).withColumn("part", _mixed("ticker", "date"))
    wrong = right.where(F.pmod(F.xxhash64("date", "ticker"), F.lit(3)) == 0).withColumns(
        {"version": F.lit(1), "close_Price": F.lit(-1.0), "part": F.pmod(F.col("part") + 1, F.lit(PARTS))})
    rows = right.unionByName(wrong)
    schema = T.StructType([f for f in rows.schema.fields if f.name != "part"])
    _in_parts(d, rows, F.col("part"),
              lambda stream, checkpoint: inc.run_available(stream, inc.upserting_sink(path, "version"), checkpoint), schema)
    return d.spark.read.parquet(path).select(*d.bars.columns)


@query("X04_running_state", """
SELECT m.date, m.ticker, momentum, o.obv, e.ema_20 AS ema FROM raw_momentum m JOIN raw_obv o USING (date, ticker) JOIN raw_ema e USING (date, ticker)""", "momentum obv ema")
def _(d):
    path = shared_folder(d.spark, "running")
    span = d.bars.agg(F.min("date"), F.max("date")).first()
    edges = [span[0] + (span[1] - span[0]) * k // PARTS for k in range(1, PARTS)]
    part = sum((F.when(F.col("date") >= F.lit(x), 1).otherwise(0) for x in edges), F.lit(0))
    _in_parts(d, d.bars, part, lambda stream, checkpoint: inc.run_available(
        inc.running_indicators(stream), inc.log_sink(path), checkpoint))
    schema = T.StructType([*inc.RUNNING_OUTPUT.fields, T.StructField(inc.BATCH, T.LongType())])
    return inc.read_log(d.spark, path, schema).drop(inc.BATCH)


@query("X05_filter_enrich", """
SELECT event_id, t.ticker, price, country FROM ticks t LEFT JOIN stock_info s ON t.ticker = s.ticker
WHERE t.ticker NOT IN (SELECT ticker FROM blacklist WHERE active)""", "price")
def _(d):
    path = shared_folder(d.spark, "filtered")
    columns = ["event_id", "ticker", "price", "country"]
    blocked, info = d.blacklist.where("active"), d.stock_info
    _in_parts(d, d.raw("events"), _mixed("event_id"), lambda stream, checkpoint: inc.run_available(
        inc.filtered_ticks(_tick_columns(stream), blocked, info).select(*columns), inc.log_sink(path), checkpoint))
    shape = inc.filtered_ticks(_tick_columns(d.raw("events")), blocked, info).select(*columns).schema
    schema = T.StructType([*shape.fields, T.StructField(inc.BATCH, T.LongType())])
    return inc.read_log(d.spark, path, schema).drop(inc.BATCH)
