"""Closed-form answers, invariances and agreement with direct recursions."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tickerloom.operators import indicators as ind
from tickerloom.operators import recurrence
from tickerloom.operators.beta import rolling_betas
from tickerloom.operators.indicators import indicators
from tickerloom.operators.recurrence import Decay, exponential_means


def column(df, ticker, name):
    return [r[name] for r in df.where(F.col("ticker") == ticker).orderBy("date").collect()]


RAMP = [100 + i for i in range(300)]


def test_ramp_closed_forms(bars):
    df = ind.indicators(bars({"RAMP": RAMP, "FLAT": [100] * 300}), ind.FAMILIES, lag=0, bollinger_lag=0).cache()
    for n in ind.MA_WINDOWS:
        sma, std = column(df, "RAMP", f"sma_{n}"), column(df, "RAMP", f"std_Div_{n}")
        assert sma[: n - 1] == [None] * (n - 1)
        assert sma[n - 1 :] == pytest.approx([c - (n - 1) / 2 for c in RAMP[n - 1 :]])
        assert std[n - 1 :] == pytest.approx([math.sqrt(n * (n + 1) / 12)] * (300 - n + 1))
    assert column(df, "RAMP", "momentum") == [float(i) for i in range(300)]
    assert set(column(df, "RAMP", "rsi_14")[14:]) == {100.0}
    assert set(column(df, "FLAT", "rsi_14")[14:]) == {50.0}
    assert set(column(df, "FLAT", "std_Div_20")[19:]) == {0.0}
    assert set(column(df, "FLAT", "volatility_20d")[20:]) == {0.0}
    assert set(column(df, "FLAT", "obv")) == {0.0}
    assert column(df, "FLAT", "momentum") == [float(i) for i in range(300)]
    assert column(df, "RAMP", "bollinger_Band_20_2STD")[19] == pytest.approx(4 * math.sqrt(20 * 21 / 12))


def test_alternating_streak_and_obv(bars):
    df = ind.indicators(bars({"ALT": [100, 101] * 10}), ["momentum", "obv"], lag=0)
    assert column(df, "ALT", "momentum") == [0.0] + [1.0, -1.0] * 9 + [1.0]
    assert column(df, "ALT", "obv") == [0.0, 100.0] * 10


def test_values_are_lagged_one_row_and_bands_two(bars):
    walk = random_walk(60)
    raw = ind.indicators(bars({"A": walk}), ["sma", "bands"], lag=0, bollinger_lag=0)
    shown = ind.indicators(bars({"A": walk}), ["sma", "bands"])
    assert column(shown, "A", "sma_5")[1:] == column(raw, "A", "sma_5")[:-1]
    band = "bollinger_Band_5_2STD"
    assert column(shown, "A", band)[2:] == column(raw, "A", band)[:-2]


def test_other_tickers_do_not_matter(bars):
    walk = random_walk(80)
    alone = ind.indicators(bars({"A": walk}), ["ema", "rsi", "std"])
    mixed = ind.indicators(bars({"A": walk, "B": random_walk(50, 2)}), ["ema", "rsi", "std"])
    for c in ("ema_20", "rsi_14", "std_Div_20"):
        assert column(alone, "A", c) == column(mixed, "A", c)


def test_null_close_blanks_the_windows_that_hold_it(bars):
    b = bars({"A": RAMP[:30]}).withColumn(
        "close_Price", F.when(F.col("close_Price") != 110, F.col("close_Price"))
    )
    sma = column(ind.indicators(b, ["sma"], lag=0), "A", "sma_5")
    assert [i for i, v in enumerate(sma) if v is None] == [0, 1, 2, 3, 10, 11, 12, 13, 14]


def random_walk(n, seed=1):
    rng, x, out = random.Random(seed), 100.0, []
    for _ in range(n):
        x *= 1 + rng.uniform(-0.03, 0.03)
        out.append(x)
    return out


def recursion(xs, alpha):
    out = [xs[0]]
    for x in xs[1:]:
        out.append(alpha * x + (1 - alpha) * out[-1])
    return out


@pytest.mark.parametrize("block,sub", [(4096, 1024), (512, 64)])
def test_blocked_recurrence_equals_direct(bars, monkeypatch, block, sub):
    monkeypatch.setattr(recurrence, "BLOCK", block)
    monkeypatch.setattr(recurrence, "SUB_BLOCK", sub)
    walk = random_walk(700)
    decays = {f"e{n}": Decay.span("close_Price", n, 1) for n in (3, 5, 26, 200)}
    df = exponential_means(bars({"A": walk}), decays)
    for n in (3, 5, 26, 200):
        assert column(df, "A", f"e{n}") == pytest.approx(recursion(walk, 2 / (n + 1)), rel=1e-12)


def test_long_history_crosses_blocks(bars):
    walk = random_walk(9000)
    df = exponential_means(bars({"A": walk}), {"e200": Decay.span("close_Price", 200, 1), "e5": Decay.span("close_Price", 5, 1)})
    assert column(df, "A", "e200") == pytest.approx(recursion(walk, 2 / 201), rel=1e-12)
    assert column(df, "A", "e5") == pytest.approx(recursion(walk, 2 / 6), rel=1e-12)


def test_std_of_a_long_drifting_series(bars):
    walk = [1000 * c for c in random_walk(1500, 3)]
    std = column(ind.indicators(bars({"A": walk}), ["std"], lag=0), "A", "std_Div_20")
    for i in range(19, 1500, 37):
        w = walk[i - 19 : i + 1]
        m = sum(w) / 20
        assert std[i] == pytest.approx(math.sqrt(sum((v - m) ** 2 for v in w) / 19), rel=1e-9)


def test_incremental_equals_full(bars):
    b = bars({"A": random_walk(120), "B": random_walk(90, 5)})
    old, new = b.where("date < '2020-03-20'"), b.where("date >= '2020-03-15'")
    inc = ind.incremental_indicators(old, new, ["ema", "vwap", "momentum"])
    full = ind.indicators(b, ["ema", "vwap", "momentum"]).where("date >= '2020-03-15'")
    assert sorted(map(tuple, inc.collect())) == sorted(map(tuple, full.select(*inc.columns).collect()))


def test_suite_has_the_table_columns(bars):
    from tickerloom.schemas import STOCK_PRICE

    out = ind.add_all_indicators(bars({"^I": random_walk(70), "A": random_walk(70)}), F.col("ticker").startswith("^"))
    assert [c for c in STOCK_PRICE.names if c != "currency"] == [
        "date", "ticker", "trade_Volume", *[c for c in out.columns if c not in ("date", "ticker", "trade_Volume")]]
    assert set(column(out, "^I", "volatility_5d")) == {None}
    assert column(out, "A", "volatility_5d")[-1] > 0


def test_bad_arguments(bars):
    with pytest.raises(ValueError):
        ind.indicators(bars({"A": [1, 2]}), ["nope"])
    with pytest.raises(ValueError):
        Decay("close_Price", 1.0)


@pytest.mark.parametrize("odd", [1e-6, 1e-4, 1e8, 1e12, float("nan"), float("inf"), None])
def test_one_extreme_close_is_forgotten(spark, odd):
    """After the last window that holds the odd row, every rolling value is that of a clean series."""
    rng = random.Random(11)
    closes = [100.0]
    while len(closes) < 700:
        closes.append(round(closes[-1] * (1 + rng.uniform(-0.01, 0.01)), 2))
    start = dt.date(2018, 1, 1)

    def table(values):
        rows = [(start + dt.timedelta(days=i), "A", c, c, c, c, 100 + i) for i, c in enumerate(values)]
        return spark.createDataFrame(rows, "date date, ticker string, open_Price double, high_Price double, "
                                     "low_Price double, close_Price double, trade_Volume bigint")

    spoilt = closes[:50] + [odd] + closes[51:]
    index = table([100 + 3 * math.sin(i / 5) + i % 7 for i in range(700)]).select("date", F.col("close_Price").alias("index_close"))
    seen = []
    for values in (closes, spoilt):
        full = indicators(table(values), ["sma", "std", "volatility", "rsi", "bands", "volume"]).orderBy("date").collect()
        pairs = table(values).join(index, "date").withColumn("index_code", F.lit("I"))
        betas = rolling_betas(pairs).orderBy("date").collect()
        seen.append([*full[400][7:], *betas[-1][3:]])
    assert all(a is not None and abs(a - b) <= 1e-9 * abs(a) for a, b in zip(*seen, strict=True))


def test_exponential_means_carry_over_a_missing_close(bars):
    rows = indicators(bars({"A": [10.0, float("nan"), 12.0, 11.0, 13.0, 12.0, 14.0]}), ["ema"], lag=0).orderBy("date").collect()
    value = 10.0
    for x in (10.0, 12.0, 11.0, 13.0, 12.0, 14.0):
        value = value + (x - value) / 3
    assert abs(rows[-1]["ema_5"] - value) < 1e-12 and rows[1]["close_Price"] is None
