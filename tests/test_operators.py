"""Micro fixtures for joins, statements, merges, percentiles, portfolios, quality."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tickerloom.functions import scalar as sc
from tickerloom.operators import joins, merges, portfolio as pf, quality as dq, statements as st, tables
from tickerloom.operators.percentiles import exact_percentiles

D = dt.date


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_as_of_includes_equal_dates_and_keeps_nulls(spark):
    left = spark.createDataFrame([("A", D(2020, 1, d)) for d in (1, 5, 9, 12)], "ticker string, date date")
    right = spark.createDataFrame(
        [("A", D(2020, 1, 5), 1.0, "x"), ("A", D(2020, 1, 10), None, "y"), ("B", D(2020, 1, 1), 9.0, "z")],
        "ticker string, date date, v double, w string")
    out = joins.as_of(left, right, matched="seen")
    assert rows(out, "date") == [
        ("A", D(2020, 1, 1), None, None, None),
        ("A", D(2020, 1, 5), 1.0, "x", D(2020, 1, 5)),
        ("A", D(2020, 1, 9), 1.0, "x", D(2020, 1, 5)),
        ("A", D(2020, 1, 12), None, "y", D(2020, 1, 10)),
    ]


@pytest.mark.parametrize("accuracy", [5, 100, 10000])
def test_exact_percentiles_match_sorting(spark, accuracy):
    rng = random.Random(3)
    data = [("a", rng.gauss(0, 1)) for _ in range(997)] + [("b", float(rng.randint(0, 3))) for _ in range(500)] + [("c", 4.0)]
    df = spark.createDataFrame(data, "g string, v double")
    probs = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p84": 0.84, "p100": 1.0}
    got = {r["g"]: r for r in exact_percentiles(df, ["g"], "v", probs, accuracy).collect()}
    for g in "abc":
        xs = sorted(v for k, v in data if k == g)
        for name, p in probs.items():
            pos = p * (len(xs) - 1)
            lo, hi = xs[math.floor(pos)], xs[math.ceil(pos)]
            assert got[g][name] == pytest.approx(lo + (hi - lo) * (pos - math.floor(pos)))


def test_ttm_strict_and_tolerant(spark):
    def quarters(t, values):
        return [(t, D(2020 + i // 4, 3 * (i % 4) + 3, 28), v, 1.0, 1.0, v, 10.0) for i, v in enumerate(values)]

    df = spark.createDataFrame(
        quarters("A", [1.0, 2.0, None, 4.0, 5.0]) + quarters("B", [1.0, 1.0, 1.0]),
        "ticker string, fiscal_quarter_end date, revenue_q double, gross_profit_q double, operating_income_q double, "
        "net_income_q double, shares_diluted double")
    strict = st.ttm_strict(df)
    assert rows(strict.select("ticker", "revenue_ttm")) == [("A", 7.0), ("A", 11.0)]
    tolerant = st.ttm_tolerant(df).orderBy("ticker", "fiscal_quarter_end").select("ticker", "revenue_ttm").collect()
    assert [r[1] for r in tolerant] == [None, None, None, pytest.approx(7 * 4 / 3), pytest.approx(11 * 4 / 3), None, None, None]


def test_divisions(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 0.005), (3, 0.01), (4, -0.01), (5, None)], "i int, d double")
    out = rows(df.select("i", sc.safe_divide(F.lit(1.0), "d"), sc.safe_ratio(F.lit(1e9), "d")), "i")
    assert [r[1] for r in out] == [None, None, pytest.approx(100.0), pytest.approx(-100.0), None]
    assert {r[2] for r in out} == {None}


def test_merges_are_idempotent(spark):
    base = spark.createDataFrame([("A", D(2020, 1, d), float(d)) for d in range(1, 10)], "ticker string, date date, v double")
    new = spark.createDataFrame([("A", D(2020, 1, 3), 30.0), ("A", D(2020, 1, 5), 50.0), ("B", D(2020, 1, 1), 1.0)], base.schema)
    once = merges.replace_range(base, new)
    assert rows(once) == rows(merges.replace_range(once, new))
    assert [r[2] for r in rows(once) if r[0] == "A"] == [1.0, 2.0, 30.0, 50.0, 6.0, 7.0, 8.0, 9.0]
    up = merges.upsert(base, new, ["ticker", "date"])
    assert rows(up) == rows(merges.upsert(up, new, ["ticker", "date"]))
    assert up.count() == 10
    only_new = merges.insert_only_new(base, new, ["ticker", "date"], [F.col("v")])
    assert only_new.count() == 10 and rows(only_new.where("v = 30")) == []
    kept, counts = merges.delete_from(base, spark.createDataFrame([("A", D(2020, 1, 6))], "ticker string, from_date date"))
    assert kept.count() == 5 and rows(counts) == [("A", 4)]


def test_two_asset_portfolio(spark):
    stats = spark.createDataFrame(
        [("X", 0, 0.10, [0.04, 0.01]), ("Y", 1, 0.20, [0.01, 0.09])], "ticker string, pos int, mu double, cov array<double>")
    w = spark.createDataFrame([(1, [0.5, 0.5]), (2, [1.0, 0.0])], "portfolio_id bigint, w array<double>")
    out = {r["portfolio_id"]: r for r in pf.performance(w, stats).collect()}
    assert out[1]["ret"] == pytest.approx(0.15)
    assert out[1]["vol"] == pytest.approx(math.sqrt(0.25 * 0.04 + 0.25 * 0.09 + 0.5 * 0.01))
    assert out[2]["sharpe"] == pytest.approx((0.10 - 0.04) / 0.2)
    h = pf.holdings(w.withColumnRenamed("portfolio_id", "run_id"), stats)
    parts = {r["run_id"]: r[1] for r in h.groupBy("run_id").agg(F.sum("marginal_contribution_to_risk")).collect()}
    assert parts[1] == pytest.approx(out[1]["vol"]) and parts[2] == pytest.approx(0.2)


def test_random_weights_sum_to_one(spark):
    stats = spark.createDataFrame([("X", 0, 0.1, [0.04]), ("Y", 1, 0.2, [0.01])], "ticker string, pos int, mu double, cov array<double>")
    w = pf.random_weights(spark.range(200).withColumnRenamed("id", "portfolio_id"), stats)
    sums = [sum(r["w"]) for r in w.collect()]
    assert len(sums) == 200 and sums == pytest.approx([1.0] * 200)
    assert len({tuple(r["w"]) for r in w.collect()}) == 200


def test_frontier_keeps_rising_returns_only(spark):
    df = spark.createDataFrame(
        [(1, 0.1, 0.10), (2, 0.3, 0.2001), (3, 0.2, 0.3), (4, 0.3, 0.4), (5, 0.05, 0.2002)], "portfolio_id bigint, ret double, vol double")
    assert rows(pf.discrete_frontier(df)) == [(0.1, 1, 0.1), (0.2, 2, 0.3), (0.4, 4, 0.3)]


def test_duplicates_found_and_removed(spark):
    df = spark.createDataFrame([("A", 1, "x"), ("A", 1, "y"), ("B", 2, "z")], "ticker string, date int, v string")
    assert rows(dq.duplicate_rows(df).select("v")) == [("x",), ("y",)]
    assert rows(dq.without_duplicates(df, precedence=[F.col("v")]).select("v")) == [("x",), ("z",)]


def test_gate_and_spikes(bars):
    b = bars({"OK": [10, 11, 12], "BAD": [10, 50, 12]})
    assert {r["ticker"] for r in dq.continuity_gate(b).collect()} == {"OK"}
    assert rows(dq.price_spikes(b).select("ticker", "value")) == [("BAD", 76.0), ("BAD", 400.0)]


def test_outlier_needs_enough_rows(bars):
    few = bars({"A": [100, 101, 99, 100, 102, 98, 100, 500]})
    many = bars({"A": [100 + i % 3 for i in range(40)] + [500]})
    assert dq.zscore_outliers(few, "close_Price").count() == 0
    assert dq.zscore_outliers(many, "close_Price").count() == 1


def test_symbols_and_calendar(spark):
    df = spark.createDataFrame([(" novo b.co ", "copenhagen"), ("sap", "xetra"), ("brk b", "us"), ("", "us")], "s string, e string")
    assert {r[0] for r in df.select(sc.clean_symbol("s", "e")).collect()} == {"NOVO-B.CO", "SAP.DE", "BRK-B", ""}
    one = spark.createDataFrame([(D(2024, 3, 1),), (D(2024, 3, 3),)], "d date")  # Friday, Sunday
    got = rows(one.select("d", sc.next_trading_day("d"), sc.last_trading_day("d", F.lit(False))))
    assert got == [(D(2024, 3, 1), D(2024, 3, 4), D(2024, 2, 29)), (D(2024, 3, 3), D(2024, 3, 4), D(2024, 3, 1))]


def test_schema_completion(spark):
    from tickerloom.schemas import STOCK_RATIO

    df = spark.createDataFrame([("A", 1.5, "x")], "ticker string, p_e double, junk string")
    out = tables.complete_schema(df, STOCK_RATIO)
    assert out.schema.names == STOCK_RATIO.names and out.first()["p_e"] == 1.5


def test_split_is_chronological(bars):
    parts = tables.chronological_parts(bars({"A": list(range(1, 101))}))
    counts = {r["split"]: r["count"] for r in parts.groupBy("split").count().collect()}
    assert counts["predict"] == 5 and counts["train"] in (65, 66) and sum(counts.values()) == 100
    bounds = {r["split"]: (r[1], r[2]) for r in parts.groupBy("split").agg(F.min("date"), F.max("date")).collect()}
    assert bounds["train"][1] < bounds["val"][0] <= bounds["val"][1] < bounds["test"][0] <= bounds["test"][1] < bounds["predict"][0]


def test_portfolios_of_many_names_lose_none(spark, bars):
    """120 names: every one has moments, weights and holdings, equal to a direct computation."""
    import numpy as np

    from tests.test_indicators import random_walk

    names = [f"T{i:03d}" for i in range(120)]
    b = bars({t: random_walk(40, 3 + i) for i, t in enumerate(names)})
    stats = pf.covariance(pf.return_matrix(b, b.select("ticker").distinct(), 30))
    rows = stats.orderBy("pos").collect()
    assert [r["ticker"] for r in rows] == names
    prices = {t: [] for t in names}
    for r in b.orderBy("date").collect():
        prices[r["ticker"]].append(r["close_Price"])
    x = np.diff(np.log(np.array([prices[t] for t in names])), axis=1)
    assert np.allclose(np.array([r["cov"][:120] for r in rows]), np.cov(x) * 252)
    ids = spark.createDataFrame([(1,), (2**62,), (-5,)], "portfolio_id long")
    w = pf.random_weights(ids, stats).collect()
    assert all(len(r["w"]) == 120 and abs(sum(r["w"]) - 1) < 1e-9 and min(r["w"]) > 0 for r in w)
