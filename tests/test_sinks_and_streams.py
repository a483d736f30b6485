"""Durable writes, and streams that equal their batch counterparts over several batches."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.test_indicators import random_walk
from tickerloom.operators import indicators as ind
from tickerloom.operators.merges import replace_range
from tickerloom.session import shared_folder
from tickerloom.sources import readers, writers
from tickerloom.streaming import incremental as inc


def tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_partition_write_reads_its_own_table(spark, bars):
    path = shared_folder(spark, "table")
    b = bars({"A": random_walk(500)})
    with_year = lambda df: df.withColumn("year", F.year("date"))
    writers.write_partitions(with_year(b), path, "year")
    new = b.where("date BETWEEN '2020-06-01' AND '2020-06-10'").withColumn("close_Price", F.lit(1.0))
    for _ in range(2):  # replay changes nothing
        old = spark.read.parquet(path).where("year = 2020").drop("year")
        writers.write_partitions(with_year(replace_range(old, new)), path, "year")
    table = spark.read.parquet(path)
    assert table.count() == 500 and table.where("close_Price = 1.0").count() == 10


def test_symbol_csv_needs_its_column(spark):
    path = shared_folder(spark, "csv")
    writers.write_csv(spark.createDataFrame([("A",)], "Name string"), path)
    with pytest.raises(ValueError):
        readers.read_symbols(spark, path)


def test_blacklist_file_round_trip(spark):
    path = shared_folder(spark, "blacklist")
    entry = {"reason": "delisted", "details": "d", "date_added": "2024-01-01", "active": True}
    writers.write_blacklist(spark, path, {"A.L": entry, "B": {**entry, "active": False}})
    assert tuples(readers.read_blacklist(spark, path).select("ticker", "active")) == [("A.L", True), ("B", False)]


def bar_stream(spark, b, parts):
    folder = shared_folder(spark, "files")
    ordered = b.orderBy("date").collect()
    step = -(-len(ordered) // parts)
    for i in range(parts):
        chunk = spark.createDataFrame(ordered[i * step : (i + 1) * step], b.schema)
        chunk.coalesce(1).write.mode("append").parquet(folder)
    return inc.stream_table(spark, folder, b.schema, files_per_batch=1)


def log_of(spark, path, schema):
    return inc.read_log(spark, path, T.StructType([*schema.fields, T.StructField(inc.BATCH, T.LongType())]))


def test_running_state_over_batches(spark, bars):
    b = bars({"A": random_walk(60), "B": random_walk(60, 4)})
    path = shared_folder(spark, "state")
    inc.run_available(inc.running_indicators(bar_stream(spark, b, 3)), inc.log_sink(path), shared_folder(spark, "cp"))
    got = log_of(spark, path, inc.RUNNING_OUTPUT)
    assert got.select(inc.BATCH).distinct().count() == 3
    full = ind.indicators(b, ["momentum", "obv", "ema"], lag=0)
    want = full.select("date", "ticker", "momentum", "obv", F.col("ema_20").alias("ema"))
    r = lambda df: df.select("date", "ticker", "momentum", "obv", F.round("ema", 9))
    assert tuples(r(got)) == tuples(r(want))


def test_upsert_keeps_stored_bars_and_the_newest_version(spark, bars):
    b = bars({"A": random_walk(40), "B": random_walk(30, 4)}).withColumn("version", F.lit(2))
    rows = b.orderBy("date", "ticker").collect()
    old = [r.asDict() | {"version": 1, "close_Price": -1.0} for r in rows[::3]]
    folder, path, checkpoint = (shared_folder(spark, x) for x in ("files", "upsert", "cp"))
    batches = [rows[10:30], [rows[0], *rows[50:]], [*old, *rows[30:50]], rows[1:10]]
    for k, chunk in enumerate(batches):
        spark.createDataFrame(chunk, b.schema).coalesce(1).write.mode("append").parquet(folder)
        if k in (1, 3):  # two runs over one checkpoint
            inc.run_available(inc.stream_table(spark, folder, b.schema, files_per_batch=1),
                              inc.upserting_sink(path, "version"), checkpoint)
    assert tuples(spark.read.parquet(path).select(*b.columns)) == tuples(b)


def test_compacted_log_resolves_to_the_same_rows(spark):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.LongType())])
    path = shared_folder(spark, "log")
    sink = inc.deduplicating_sink(path, ["k"], ["v"])
    for i in range(5):
        sink(spark.createDataFrame([(k, (k * 7 + i * 3) % 11) for k in range(6)], schema), i)
    full = T.StructType([*schema.fields, T.StructField(inc.BATCH, T.LongType())])
    want = tuples(inc.newest_per_key(inc.read_log(spark, path, full), ["k"], ["v"]))
    inc.compact_log(spark, path, full, ["k"], ["v"])
    log = inc.read_log(spark, path, full)
    assert log.count() == 12 and tuples(inc.newest_per_key(log, ["k"], ["v"])) == want


def test_daily_bars_and_newest_over_batches(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(hours=5 * i), f"S{i % 3}", float(i % 11)) for i in range(90)]
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
                           T.StructField("ticker", T.StringType()), T.StructField("price", T.DoubleType())])
    ticks = spark.createDataFrame(rows, schema)
    folder = shared_folder(spark, "ticks")
    for i in range(3):
        spark.createDataFrame(rows[30 * i : 30 * i + 30], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: inc.stream_table(spark, folder, schema, files_per_batch=1)
    path = shared_folder(spark, "daily")
    inc.run_available(inc.daily_bars(stream()), inc.log_sink(path), shared_folder(spark, "cp"), "update")
    batch = inc.daily_bars(ticks)
    assert tuples(inc.newest_version(log_of(spark, path, batch.schema), ["ticker", "date"])) == tuples(batch)

    path = shared_folder(spark, "newest")
    inc.run_available(stream(), inc.deduplicating_sink(path, ["ticker"], ["event_id"]), shared_folder(spark, "cp"))
    got = inc.newest_per_key(log_of(spark, path, schema), ["ticker"], ["event_id"])
    assert sorted(r["event_id"] for r in got.collect()) == [87, 88, 89]


def test_state_of_first_deliveries_stays_bounded(spark):
    import datetime as dt

    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("t", T.TimestampType()), T.StructField("n", T.LongType())])
    folder, path, checkpoint = (shared_folder(spark, x) for x in ("sent", "first", "cp"))
    row = lambda i, n: (i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), n)
    sizes = []
    for batch in range(20):  # an hour each; again what came up to three hours before
        new = [row(i, 0) for i in range(60 * batch, 60 * batch + 60)]
        old = [row(i, 1) for i in range(max(0, 60 * batch - 180), 60 * batch, 7)]
        none = [(None, row(0, 2)[1], 2), (-1, None, 2)]
        spark.createDataFrame(new + new[::9] + old + none, schema).coalesce(1).write.mode("append").parquet(folder)
        if batch in (6, 19):  # a restart between
            stream = inc.stream_table(spark, folder, schema, files_per_batch=1)
            query = inc.run_available(inc.first_deliveries(stream, ["k"], "t", "2 hours"), inc.log_sink(path), checkpoint)
            sizes += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    got = sorted((r.k, r.n) for r in log_of(spark, path, schema).collect())
    assert got == [(i, 0) for i in range(1200)]
    assert len(sizes) >= 20 and max(sizes) <= 5 * 60
