"""Tasks hold a bounded number of rows, and plans do not repeat whole derivations."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickerloom import session
from tickerloom.functions.windows import pct_change
from tickerloom.plans import all_queries, q_ml


class Rows:
    """A stand-in for the domain: stored bars of a few tickers."""

    def __init__(self, spark, path, days=320, tickers=6):
        day = F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") % days).cast("int"))
        close = F.lit(100.0) + F.pmod(F.xxhash64("id"), F.lit(17))
        spark.range(days * tickers).select(
            day.alias("date"), F.concat(F.lit("S"), F.floor(F.col("id") / days).cast("string")).alias("ticker"),
            close.alias("open_Price"), (close + 1).alias("high_Price"), (close - 1).alias("low_Price"),
            close.alias("close_Price"), (F.lit(100) + F.col("id") % 7).alias("trade_Volume"),
        ).write.parquet(path)
        self.spark, self.bars = spark, spark.read.parquet(path)


@pytest.fixture
def small_tasks(monkeypatch):
    all_queries.load()
    monkeypatch.setattr(session, "ROWS_A_TASK", 400)


def test_partitions_grow_with_the_rows(spark, small_tasks, tmp_path):
    d = Rows(spark, str(tmp_path / "bars"))
    out = session.dealt(d.bars, "ticker").withColumn("y", pct_change("close_Price"))
    assert out.rdd.getNumPartitions() == 5  # 1,920 rows; adaptive execution would make one of them
    assert session.dealt(d.bars.limit(400), "ticker").rdd.getNumPartitions() < 5
    assert session.dealt(d.bars, rows=900).rdd.getNumPartitions() == 3


def test_features_are_derived_in_tasks_of_bounded_size(spark, small_tasks, tmp_path):
    rows = q_ml.dataset(Rows(spark, str(tmp_path / "bars")))
    assert rows.rdd.getNumPartitions() == 5
    assert rows.groupBy("ticker").count().count() == 6


def test_forecast_plan_does_not_repeat_the_features(spark, small_tasks, tmp_path):
    from tickerloom.plans.registry import CASES

    out = CASES["M18_direct_forecast"].build(Rows(spark, str(tmp_path / "bars")))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 0
    assert out.count() == 6


def test_weights_are_drawn_once_in_tasks_of_bounded_size(spark, monkeypatch):
    from tickerloom.operators import portfolio as pf

    monkeypatch.setattr(pf, "WEIGHTS_A_TASK", 20)
    stats = spark.createDataFrame([("A", 0, 0.1, [0.2, 0.01]), ("B", 1, 0.2, [0.01, 0.3])],
                                  "ticker string, pos int, mu double, cov array<double>")
    drawn = pf.random_weights(spark.range(100).withColumnRenamed("id", "portfolio_id"), stats)
    assert "md5" not in drawn._jdf.queryExecution().optimizedPlan().toString()
    assert len(drawn.inputFiles()) == 5
    assert drawn.count() == 100 and drawn.where("abs(w[0] + w[1] - 1) > 1e-12").count() == 0


def test_upsert_sorts_in_tasks_of_bounded_size(spark, small_tasks, tmp_path):
    from tickerloom.streaming import incremental as inc

    d = Rows(spark, str(tmp_path / "bars"))
    right = d.bars.withColumn("version", F.lit(2))
    wrong = right.withColumns({"version": F.lit(1), "close_Price": F.lit(-1.0)})
    merge = inc.upserting_sink(str(tmp_path / "table"), "version")
    for batch in (right.where("ticker < 'S3'"), wrong, right.where("ticker >= 'S3'")):
        merge(batch, 0)
    out = spark.read.parquet(str(tmp_path / "table")).select(*d.bars.columns)
    assert out.exceptAll(d.bars).count() == 0 and d.bars.exceptAll(out).count() == 0
    assert len(out.inputFiles()) > 1


def test_ratios_keep_the_partitions_they_are_given(spark, small_tasks, tmp_path):
    from tickerloom.operators import ratios

    d = Rows(spark, str(tmp_path / "bars"))
    quarter = F.lit(dt.date(2020, 3, 31)).alias("fiscal_quarter_end")
    values = ("eps_ttm", "book_value_per_share", "revenue_ttm", "fcf_per_share", "shares_diluted")
    reports = d.bars.select("ticker").distinct().select(
        "ticker", quarter, *[F.lit(float(i + 1)).alias(c) for i, c in enumerate(values)])
    rows = d.bars.count()
    given, free = (ratios.ratios_from_ttm(d.bars, reports, rows=n) for n in (rows, None))
    assert given.rdd.getNumPartitions() == 5
    assert given.exceptAll(free).count() == 0 and given.count() == free.count() == rows


def test_full_suite_is_derived_in_tasks_of_bounded_size(spark, small_tasks, monkeypatch, tmp_path):
    from tickerloom.operators import indicators as ind
    from tickerloom.plans.registry import CASES

    monkeypatch.setattr(ind, "ROWS_A_TASK", 400)
    out = CASES["T14_full_suite"].build(Rows(spark, str(tmp_path / "bars")))
    assert out.rdd.getNumPartitions() == 5
    assert out.count() == 1920


def test_incremental_rows_meet_no_join_and_tasks_are_bounded(spark, monkeypatch, tmp_path):
    from tickerloom.operators import indicators as ind

    monkeypatch.setattr(ind, "ROWS_A_TASK", 400)
    bars = Rows(spark, str(tmp_path / "bars")).bars
    cut = F.lit(dt.date(2020, 11, 1))
    history, fresh = bars.where(F.col("date") < cut), bars.where((F.col("date") >= cut) & (F.col("ticker") != "S3"))
    out = ind.incremental_indicators(history, fresh, ["sma", "obv"], rows=1920)
    assert out.rdd.getNumPartitions() == 5
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert min(k for k, line in enumerate(plan) if "Join" in line) > max(
        k for k, line in enumerate(plan) if "Window" in line)
    whole = ind.indicators(bars, ["sma", "obv"]).where((F.col("date") >= cut) & (F.col("ticker") != "S3"))
    got = out.select(*whole.columns)
    assert out.count() == whole.count() > 0
    assert got.exceptAll(whole).count() == 0


def test_arriving_parts_are_written_by_several_tasks(spark, monkeypatch, tmp_path):
    from tickerloom.plans import q_streaming

    monkeypatch.setattr(q_streaming, "ROWS_A_FILE", 100)
    d = Rows(spark, str(tmp_path / "bars"))
    taken, opened = [], []

    def run(stream, checkpoint):
        def keep(batch, batch_id):
            opened.append(batch.select(F.input_file_name()).distinct().count())
            taken.append((batch_id, {r[0] for r in batch.select(F.year("date") * 100 + F.month("date")).distinct().collect()}))

        q_streaming.inc.run_available(stream, keep, checkpoint)

    months = F.floor((F.month("date") - 1) / 3)
    q_streaming._in_parts(d, d.bars.where("ticker < 'S3'"), months, run)
    assert [k for k, _ in taken] == [0, 1, 2, 3]
    assert [sorted(m) for _, m in taken] == [[202001, 202002, 202003], [202004, 202005, 202006],
                                             [202007, 202008, 202009], [202010, 202011]]
    assert max(opened) == 3  # 960 rows; the parts' 240 rows are written by three tasks


def test_parts_without_rows_take_a_batch_of_their_own(spark, monkeypatch, tmp_path):
    from tickerloom.plans import q_streaming

    monkeypatch.setattr(q_streaming, "ROWS_A_FILE", 1)
    d = Rows(spark, str(tmp_path / "bars"), days=4, tickers=5)
    sizes = []

    def run(stream, checkpoint):
        q_streaming.inc.run_available(stream, lambda batch, batch_id: sizes.append(batch.count()), checkpoint)

    few = F.when(F.col("date") < F.lit(dt.date(2020, 1, 4)), 0).otherwise(2)
    q_streaming._in_parts(d, d.bars, few, run)
    assert sizes == [15, 0, 5, 0]


def test_labelled_rows_are_derived_once_for_all_horizons(spark, small_tasks, monkeypatch, tmp_path):
    from tickerloom.operators import ml
    from tickerloom.plans.registry import CASES

    fitted = []
    monkeypatch.setattr(ml, "tuned", lambda models, rows, features, tuned=ml.tuned: fitted.append(rows) or tuned(models, rows, features))
    out = CASES["M18_direct_forecast"].build(Rows(spark, str(tmp_path / "bars")))
    assert out.count() == 6 and len(fitted) == 4
    for rows in fitted:  # read from storage: the moving windows of the features are not in the plan, nor a join
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 1 and "Join" not in plan and "close_Price" not in plan


def test_scaling_beside_the_rows_gives_the_joined_rows(spark):
    from tickerloom.operators import ml

    rows = spark.createDataFrame(
        [("A", "train", 1.0, 5.0), ("A", "train", 3.0, 5.0), ("A", "val", 9.0, 6.0), ("B", "val", 1.0, 1.0), ("C", "train", None, 2.0),
         ("C", None, 4.0, 3.0), (None, "train", 1.0, 1.0), ("A", "train", 3.0, 5.0)], "ticker string, split string, a double, b double")
    train = F.col("split") == "train"
    joined = ml.minmax_apply(rows, ml.minmax_fit(rows, ["a", "b"], train), ["a", "b"])
    beside = ml.minmax_scaled(rows, ["a", "b"], train)
    assert beside.count() == joined.count() == 6 and beside.columns == joined.columns
    assert beside.exceptAll(joined).count() == 0
