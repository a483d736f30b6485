"""T: technical indicators; W11 recurrence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.operators import indicator_state
from tickerloom.operators import indicators as ind
from tickerloom.operators.recurrence import Decay, exponential_means
from tickerloom.plans.domain_sql import register
from tickerloom.plans.registry import query
from tickerloom.session import dealt, materialised

KEYS = ("date", "ticker")
_W = "(PARTITION BY ticker ORDER BY date)"


def _frame(n: int) -> str:
    return f"(PARTITION BY ticker ORDER BY date ROWS {n - 1} PRECEDING)"


def _full(n: int, agg: str, x: str) -> str:
    return f"CASE WHEN count({x}) OVER {_frame(n)} = {n} THEN {agg}({x}) OVER {_frame(n)} END"


def _lagged(names, lag=1) -> str:
    return ", ".join(f'lag("{n}", {lag}) OVER {_W} AS "{n}"' for n in names)


def _shown(names, source: str, lag: int = 1) -> str:
    return f"SELECT date, ticker, {_lagged(names, lag)} FROM {source}"


# Direct recursion over all rows of all tickers, one step per row number.
_SPANS = {"ema_5": 5, "ema_20": 20, "ema_40": 40, "ema_120": 120, "ema_200": 200,
          "fast": 12, "slow": 26}


def _step(old: str, new: str, alpha: str) -> str:
    return f"{alpha} * {new} + (1e0 - {alpha}) * {old}"


def _alpha(n: int) -> str:
    return f"(2e0 / {n + 1}e0)"


register("numbered", f"""
SELECT *, row_number() OVER {_W} AS rn, lag(close_Price) OVER {_W} AS prev,
       CASE WHEN lag(close_Price) OVER {_W} IS NULL THEN high_Price - low_Price
            ELSE greatest(high_Price - low_Price, abs(high_Price - lag(close_Price) OVER {_W}),
                          abs(low_Price - lag(close_Price) OVER {_W})) END AS tr,
       CASE WHEN lag(close_Price) OVER {_W} IS NOT NULL
            THEN greatest(close_Price - lag(close_Price) OVER {_W}, 0e0) END AS up,
       CASE WHEN lag(close_Price) OVER {_W} IS NOT NULL
            THEN greatest(lag(close_Price) OVER {_W} - close_Price, 0e0) END AS down,
       close_Price / nullif(lag(close_Price) OVER {_W}, 0) - 1 AS ret
FROM bars
""")
register("smoothed", f"""
SELECT ticker, rn, date, {', '.join(f'close_Price AS {k}' for k in _SPANS)},
       CAST(trade_Volume AS DOUBLE) AS volume_ema_20, tr AS atr, 0e0 AS signal,
       0e0 AS wup, 0e0 AS wdown
FROM numbered WHERE rn = 1
UNION ALL
SELECT n.ticker, n.rn, n.date,
       {', '.join(f"{_step('s.' + k, 'n.close_Price', _alpha(v))}" for k, v in _SPANS.items())},
       {_step('s.volume_ema_20', 'n.trade_Volume', _alpha(20))},
       {_step('s.atr', 'n.tr', '(1e0 / 14e0)')},
       {_step('s.signal',
              '((' + _step('s.fast', 'n.close_Price', _alpha(12)) + ') - ('
              + _step('s.slow', 'n.close_Price', _alpha(26)) + '))', _alpha(9))},
       {_step('s.wup', 'n.up', '(1e0 / 14e0)')}, {_step('s.wdown', 'n.down', '(1e0 / 14e0)')}
FROM smoothed s JOIN numbered n ON n.ticker = s.ticker AND n.rn = s.rn + 1
""")
_EMAS = [f"ema_{n}" for n in ind.MA_WINDOWS]
register("raw_ema", "SELECT date, ticker, " + ", ".join(
    f"CASE WHEN rn >= {n} THEN ema_{n} END AS ema_{n}" for n in ind.MA_WINDOWS) + " FROM smoothed")
register("raw_macd", """
SELECT date, ticker, CASE WHEN rn >= 26 THEN fast - slow END AS macd,
       CASE WHEN rn >= 34 THEN signal END AS macd_signal,
       CASE WHEN rn >= 34 THEN fast - slow - signal END AS macd_histogram FROM smoothed
""")
register("raw_atr", "SELECT date, ticker, CASE WHEN rn >= 14 THEN atr END AS atr_14 FROM smoothed")
register("raw_returns", "SELECT date, ticker, " + ", ".join(
    f'close_Price / nullif(lag(close_Price, {n}) OVER {_W}, 0) - 1 AS "{k}"'
    for k, n in ind.RETURN_PERIODS.items()) + " FROM bars")
register("raw_sma", "SELECT date, ticker, " + ", ".join(
    f"{_full(n, 'avg', 'close_Price')} AS sma_{n}" for n in ind.MA_WINDOWS) + " FROM bars")
register("raw_std", "SELECT date, ticker, " + ", ".join(
    f"{_full(n, 'stddev_samp', 'close_Price')} AS std_Div_{n}" for n in ind.MA_WINDOWS)
    + " FROM bars")
register("raw_rsi", f"""
SELECT date, ticker, CASE WHEN down = 0 THEN CASE WHEN up > 0 THEN 1e2 ELSE 5e1 END
       ELSE 1e2 - 1e2 / (1 + up / down) END AS rsi_14
FROM (SELECT date, ticker, {_full(14, 'avg', 'up')} AS up, {_full(14, 'avg', 'down')} AS down
      FROM numbered)
""")
register("raw_volume", f"""
SELECT n.date, n.ticker, volume_sma_20, volume_ema_20,
       trade_Volume / nullif(volume_sma_20, 0) AS volume_ratio
FROM (SELECT *, {_full(20, 'avg', 'trade_Volume')} AS volume_sma_20 FROM numbered) n
JOIN smoothed s ON s.ticker = n.ticker AND s.rn = n.rn
""")
_RUN = "(PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)"
register("raw_vwap", f"""
SELECT date, ticker, sum(close_Price * trade_Volume) OVER {_RUN}
       / nullif(CAST(sum(trade_Volume) OVER {_RUN} AS DOUBLE), 0) AS vwap FROM bars
""")
register("raw_obv", f"""
SELECT date, ticker, sum(trade_Volume * CAST(sign(coalesce(close_Price - prev, 0)) AS DOUBLE))
       OVER {_RUN} AS obv FROM numbered
""")
register("raw_volatility", "SELECT date, ticker, " + ", ".join(
    f"{_full(n, 'stddev_samp', 'ret')} AS {k}" for k, n in ind.VOLATILITY_WINDOWS.items())
    + " FROM numbered")
register("raw_momentum", f"""
SELECT date, ticker, CAST(dir * row_number() OVER (PARTITION BY ticker, island ORDER BY date)
       AS DOUBLE) AS momentum
FROM (SELECT *, sum(CASE WHEN dir IS DISTINCT FROM pdir THEN 1 ELSE 0 END) OVER {_RUN} AS island
      FROM (SELECT *, lag(dir) OVER {_W} AS pdir
            FROM (SELECT *, CASE WHEN prev IS NULL THEN 0 WHEN close_Price >= prev THEN 1 ELSE -1
                         END AS dir FROM numbered)))
""")

_VOL = list(ind.VOLATILITY_WINDOWS)
_BANDS = [f"bollinger_Band_{n}_2STD" for n in ind.MA_WINDOWS]
_STDS = [f"std_Div_{n}" for n in ind.MA_WINDOWS]
_SMAS = [f"sma_{n}" for n in ind.MA_WINDOWS]
_FAMILY = {
    "T01_period_returns": ("returns", list(ind.RETURN_PERIODS), "raw_returns"),
    "T02_sma": ("sma", _SMAS, "raw_sma"),
    "T03_ema": ("ema", _EMAS, "raw_ema"),
    "T04_rolling_std": ("std", _STDS, "raw_std"),
    "T06_rsi": ("rsi", ["rsi_14"], "raw_rsi"),
    "T07_macd": ("macd", ["macd", "macd_signal", "macd_histogram"], "raw_macd"),
    "T08_atr": ("atr", ["atr_14"], "raw_atr"),
    "T09_volume": ("volume", ["volume_sma_20", "volume_ema_20", "volume_ratio"], "raw_volume"),
    "T10_vwap": ("vwap", ["vwap"], "raw_vwap"),
    "T11_obv": ("obv", ["obv"], "raw_obv"),
    "T12_volatility": ("volatility", _VOL, "raw_volatility"),
    "T13_momentum_streak": ("momentum", ["momentum"], "raw_momentum"),
}
for _key, (_fam, _names, _source) in _FAMILY.items():
    query(_key, _shown(_names, _source), " ".join(_names))(
        lambda d, fam=_fam, names=_names: ind.indicators(d.bars, [fam]).select(*KEYS, *names)
    )

register("shown_bands", "SELECT date, ticker, " + ", ".join(
    f"4e0 * lag({s}, 2) OVER {_W} AS {b}" for s, b in zip(_STDS, _BANDS)) + " FROM raw_std")
query("T05_band_width", "SELECT * FROM shown_bands", " ".join(_BANDS))(
    lambda d: ind.indicators(d.bars, ["bands"]).select(*KEYS, *_BANDS)
)


@query("T06_rsi_wilder", f"""
SELECT date, ticker, lag(CASE WHEN rn >= 15 THEN CASE WHEN wdown = 0
         THEN CASE WHEN wup > 0 THEN 1e2 ELSE 5e1 END ELSE 1e2 - 1e2 / (1 + wup / wdown) END END)
       OVER {_W} AS rsi_14 FROM smoothed""", "rsi_14")
def _(d):
    return ind.indicators(d.bars, ["rsi"], rsi_method="wilder").select(*KEYS, "rsi_14")


@query("T01_period_returns_long", _shown(list(ind.RETURN_PERIODS), "raw_returns")
       .replace("raw_returns", "nation_returns"), " ".join(ind.RETURN_PERIODS))
def _(d):
    return ind.indicators(d.bars_nation, ["returns"]).select(*KEYS, *ind.RETURN_PERIODS)


register("nation_returns", "SELECT date, ticker, " + ", ".join(
    f'close_Price / nullif(lag(close_Price, {n}) OVER {_W}, 0) - 1 AS "{k}"'
    for k, n in ind.RETURN_PERIODS.items()) + " FROM bars_nation")

_ALL = ind._columns(ind.FAMILIES)
_SUITE_SOURCES = [s for _, _, s in _FAMILY.values()]


def _suite_sql() -> str:
    owner = {n: s for _, names, s in _FAMILY.values() for n in names}
    cols = []
    for n in _ALL:
        cols.append(f'shown_bands."{n}"' if n in _BANDS else f'lag({owner[n]}."{n}") OVER w AS "{n}"')
    joins = " ".join(f"JOIN {s} USING (ticker, date)" for s in [*_SUITE_SOURCES, "shown_bands"])
    return (
        "SELECT bars.*, " + ", ".join(cols) + f" FROM bars {joins} "
        "WINDOW w AS (PARTITION BY bars.ticker ORDER BY bars.date)"
    )


register("suite", _suite_sql())
OHLC = "open_Price high_Price low_Price close_Price"
query("T14_full_suite", "SELECT * FROM suite", f"{OHLC} {' '.join(_ALL)}")(
    lambda d: ind.add_all_indicators(dealt(d.bars, "ticker", each=ind.ROWS_A_TASK), F.col("ticker").startswith("^"))
)

_ROWS = {"1W": 5, "1M": 21, "3M": 63, "6M": 126, "1Y": 252}


@query("T17_display_returns", """
SELECT ticker, """ + ", ".join(
    f'max(CASE WHEN r = 1 THEN close_Price END) / nullif(max(CASE WHEN r = least({n}, cnt) '
    f'THEN close_Price END), 0) - 1 AS "{k}"' for k, n in _ROWS.items()) + """,
       max(CASE WHEN r = 1 THEN close_Price END)
       / nullif(arg_min(close_Price, CASE WHEN date >= date_trunc('year', last) THEN date END), 0) - 1 AS YTD
FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS r,
             count(*) OVER (PARTITION BY ticker) AS cnt, max(date) OVER (PARTITION BY ticker) AS last
      FROM bars) GROUP BY ticker""", " ".join([*_ROWS, "YTD"]))
def _(d):
    return ind.trailing_returns(d.bars, _ROWS)


@query("T18_latest_quote", f"""
SELECT ticker, date, close_Price, prev AS prev_close, close_Price - prev AS change_abs,
       (close_Price - prev) / nullif(prev, 0) * 1e2 AS change_pct
FROM numbered QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1""",
       "close_Price prev_close change_abs change_pct")
def _(d):
    return ind.latest_quote(d.bars)


register("price_momentum", """
SELECT ticker,
       max(CASE WHEN r = 1 THEN close_Price END) / nullif(max(CASE WHEN r = 63 THEN close_Price END), 0) - 1 AS m3,
       max(CASE WHEN r = 1 THEN close_Price END) / nullif(max(CASE WHEN r = 126 THEN close_Price END), 0) - 1 AS m6
FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS r FROM bars)
WHERE r <= 252 GROUP BY ticker
""")


@query("T19_price_momentum", "SELECT * FROM price_momentum", "m3 m6")
def _(d):
    return ind.price_momentum(d.bars)


@query("T20_incremental_indicators", """
SELECT * FROM suite
WHERE date >= (SELECT as_of FROM as_of) - 60""", f"{OHLC} {' '.join(_ALL)}")
def _(d):
    cut = F.date_sub(d.last_bar_date, 60)
    return ind.incremental_indicators(
        d.bars.where(F.col("date") < cut), d.bars.where(F.col("date") >= cut), rows=d.bars.count()
    )


def _fresh_and_state(d):
    """The bars of the last 60 days, and the stored state of all before them."""
    cut = F.date_sub(d.last_bar_date, 60)
    state = d.stored("indicator_state", lambda: indicator_state.initial_state(d.bars.where(F.col("date") < cut)))
    return d.bars.where(F.col("date") >= cut), state


@query("T20_state_advance", """
SELECT * FROM suite
WHERE date >= (SELECT as_of FROM as_of) - 60""", f"{OHLC} {' '.join(_ALL)}")
def _(d):
    fresh, state = _fresh_and_state(d)
    return indicator_state.new_rows(indicator_state.advance(state, fresh))


@query("T20_state_batches", """
SELECT ticker, max(date) AS version, count(*) AS n, arg_max(close_Price, date) AS last_close,
       min(date) FILTER (date >= (SELECT as_of FROM as_of) - 60) AS first_new,
       count(*) FILTER (date >= (SELECT as_of FROM as_of) - 60) AS n_new, 0 AS n_replayed
FROM bars GROUP BY ticker""", "last_close")
def _(d):
    """The state after the same days in two batches, the second of which comes twice."""
    fresh, state = _fresh_and_state(d)
    half = F.date_sub(d.last_bar_date, 30)
    first = materialised(indicator_state.advance(state, fresh.where(F.col("date") < half)), "advanced")
    state = materialised(indicator_state.next_state(state, first), "state")
    second = materialised(indicator_state.advance(state, fresh), "advanced")
    state = materialised(indicator_state.next_state(state, second), "state")
    again = indicator_state.new_rows(indicator_state.advance(state, fresh)).groupBy("ticker").agg(F.count("*").alias("r"))
    rows = indicator_state.new_rows(first).unionByName(indicator_state.new_rows(second)).groupBy("ticker").agg(
        F.min("date").alias("first_new"), F.count("*").alias("n_new"))
    return state.join(rows, "ticker", "left").join(again, "ticker", "left").select(
        "ticker", "version", F.col("carry.n").alias("n"), F.element_at("closes", -1).alias("last_close"), "first_new",
        F.coalesce("n_new", F.lit(0)).alias("n_new"), F.coalesce("r", F.lit(0)).alias("n_replayed"))


@query("W11_exponential_mean", "SELECT date, ticker, ema_20, ema_200 FROM raw_ema", "ema_20 ema_200")
def _(d):
    decays = {f"ema_{n}": Decay.span("close_Price", n) for n in (20, 200)}
    return exponential_means(d.bars.select(*KEYS, "close_Price"), decays).select(
        *KEYS, "ema_20", "ema_200"
    )
