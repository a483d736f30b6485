"""Ratios and the model dataset leave their bars in one shuffle by ticker."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickerloom.operators import ratios
from tickerloom.operators import statements as st
from tickerloom.plans import all_queries
from tickerloom.plans.domain import Domain
from tickerloom.plans.registry import CASES

DAY = dt.date(2020, 1, 1)


def _bars(spark, rows):
    return spark.createDataFrame([(t, None if i is None else DAY + dt.timedelta(days=i), c) for t, i, c in rows],
                                 "ticker string, date date, close_Price double")


def _reports(spark):
    """Ticker A has no value by quarter, B misses some, C has no report by year."""
    quarters = spark.createDataFrame(
        [("A", DAY, None, None, None, None, None), ("B", DAY, 2.0, None, 30.0, 4.0, 5.0), ("C", DAY, 1.0, 2.0, 3.0, 4.0, 5.0)],
        f"ticker string, {st.QUARTER} date, " + ", ".join(f"{c} double" for c in ratios.QUARTER_VALUES))
    years = spark.createDataFrame(
        [("A", DAY, 7.0, 8.0, 9.0, 10.0), ("B", DAY + dt.timedelta(days=2), 7.0, 8.0, 9.0, 10.0), (None, DAY, 1.0, 1.0, 1.0, 1.0)],
        f"ticker string, {st.YEAR} date, " + ", ".join(f"{c} double" for c in ratios.YEAR_VALUES))
    return quarters, years


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("rows", [None, 250_000])
def test_fallback_without_a_join_gives_the_joined_rows(spark, rows):
    bars = _bars(spark, [(t, i, 10.0 + (i or 0)) for t in ("A", "B", "C", "D", None) for i in (None, 0, 1, 2, 3)])
    quarters, years = _reports(spark)
    joined = ratios.with_annual_fallback(ratios.ratios_from_ttm(bars, quarters), ratios.ratios_from_annual(bars, years))
    passed = ratios.ratios_with_fallback(bars, quarters, years, rows=rows)
    assert passed.columns == joined.columns and passed.count() == 25
    assert _same(passed, joined)


def test_days_that_repeat_are_paired_as_by_the_join(spark):
    bars = _bars(spark, [("A", 1, 10.0), ("A", 1, 20.0), ("B", 3, 5.0), ("B", 3, 6.0), ("B", 3, 7.0), ("C", 1, 1.0), (None, 1, 1.0), (None, 1, 2.0)])
    quarters, years = _reports(spark)
    joined = ratios.with_annual_fallback(ratios.ratios_from_ttm(bars, quarters, 0), ratios.ratios_from_annual(bars, years, 0))
    passed = ratios.ratios_with_fallback(bars, quarters, years, 0)
    assert passed.count() == 4 + 9 + 1 + 2
    assert _same(passed, joined)


def test_model_dataset_pairs_bars_and_ratios_of_a_day(spark):
    bars = _bars(spark, [("A", 0, 8.0), ("A", 1, 9.0), ("B", 1, 5.0), ("B", 2, 6.0), ("B", 2, 6.0), ("D", 1, 1.0), (None, 1, 1.0), ("C", None, 1.0)])
    quarters, years = _reports(spark)
    market = spark.createDataFrame([(DAY + dt.timedelta(days=1), 3.0)], "date date, market_close double")
    reports = spark.createDataFrame([("A", DAY + dt.timedelta(days=1), 0.5)], f"ticker string, {st.YEAR} date, eps double")
    out = ratios.model_dataset(bars, market, reports, quarters, years)
    got = ratios.drop_empty(ratios.ratios_with_fallback(bars, quarters, years)).select("date", "ticker", *ratios.RATIOS)
    assert _same(out.select("date", "ticker", "close_Price", *ratios.RATIOS), bars.join(got, ["date", "ticker"], "left").select(
        "date", "ticker", "close_Price", *ratios.RATIOS))
    assert out.columns == ["date", "ticker", "close_Price", "market_close", "eps", *ratios.RATIOS]
    assert {tuple(r) for r in out.select("ticker", "date", "market_close", "eps").where("ticker = 'A'").collect()} == {
        ("A", DAY, None, 0.5), ("A", DAY + dt.timedelta(days=1), 3.0, 0.5)}
    assert out.count() == 2 + 1 + 8 + 1 + 1 + 1


def test_repeated_statements_are_not_paired(spark):
    def table(*names):
        cells = [F.lit(float(i + 1)).alias(c) for i, c in enumerate(names)]
        year = F.make_date(2018 + F.col("id") % 3, F.lit(12), F.lit(31)).alias(st.YEAR)
        one = spark.range(3).select(F.lit("A").alias("ticker"), year, *cells)
        return one.union(one).union(one.limit(0)).union(one.withColumn("ticker", F.lit("B")))

    income, balance, cash = table("eps"), table("book"), table("free")
    full, once = (st.assemble_annual(income, balance, cash, x) for x in (False, True))
    assert full.groupBy("ticker").count().orderBy("ticker").collect() == [("A", 3 * 8 - 1), ("B", 2)]
    assert _same(once, full.distinct()) and once.columns == full.columns
    assert once.count() == 3 + 2


def _tables(spark, path):
    """Base tables of four suppliers, two of which share the ticker S10000."""
    keys = F.element_at(F.array(*[F.lit(k) for k in (1, 2, 10_000, 100_001)]), (F.col("id") % 4 + 1).cast("int"))
    spark.range(600).select(
        keys.cast("bigint").alias("l_suppkey"), (F.lit(dt.datetime(2018, 1, 1)) + F.make_dt_interval(F.floor(F.col("id") / 4) * 7)).alias("l_shipdate"),
        (F.col("id") % 40 + 1).cast("double").alias("l_quantity"), (F.col("id") + 100).cast("double").alias("l_extendedprice"),
        F.lit(0.1).alias("l_discount"), F.lit("N").alias("l_returnflag")).write.parquet(f"{path}/lineitem.parquet")
    spark.range(1).select(F.explode(F.array(*[F.lit(k).cast("bigint") for k in (1, 2, 10_000, 100_001)])).alias("s_suppkey"),
                          F.lit("s").alias("s_name"), F.lit(0).alias("s_nationkey")).write.parquet(f"{path}/supplier.parquet")
    spark.createDataFrame([(0, "n", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{path}/nation.parquet")
    spark.createDataFrame([(0, "r")], "r_regionkey int, r_name string").write.parquet(f"{path}/region.parquet")
    return Domain(spark, path)


def test_bars_are_read_once(spark, tmp_path):
    all_queries.load()
    d = _tables(spark, str(tmp_path))
    for name, shared in (("V04_annual_fallback", 150 * 4), ("V09_model_dataset", None)):  # two bars a day, paired by each join
        out = CASES[name].build(d)
        plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert sum("Relation [" in line and "close_Price" in line for line in plan) == 1, name
        assert out.where("ticker <> 'S10000'").count() == 300
        pairs = out.where("ticker = 'S10000'").count()
        assert pairs == shared if shared else 300 < pairs <= 150 * 8  # empty ratios are not paired
