"""Daily technical indicators for all tickers in one window pipeline.

Every family is built from the same stages, so that asking for all of them costs one
shuffle by ticker and one sort. All values are lagged one row by default (no look-ahead);
``lag=0`` shows the raw value of the row. Band widths are lagged twice by default.

Conventions where the literature varies: exponential means start at the first value and
are shown from row ``n``; RSI averages 14 simple changes (``rsi_method="wilder"`` smooths
with 1/14 instead); ATR is Wilder-smoothed. NaN and infinite prices count as NULL. Windows
holding a NULL give NULL; exponential means carry the last close over a NULL. Means and
deviations merge the windows of earlier rows (``moments``), which hold only their own rows: one
extreme value is forgotten as soon as it leaves the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.scalar import finite
from tickerloom.functions.windows import running
from tickerloom.operators.moments import Rolling, with_moments
from tickerloom.operators.recurrence import Decay, Series
from tickerloom.session import dealt

# Column names and their row counts.
RETURN_PERIODS = {
    "1D": 1, "1M": 21, "3M": 63, "6M": 126, "9M": 189,
    "1Y": 252, "2Y": 504, "3Y": 756, "4Y": 1008, "5Y": 1260,
}
MA_WINDOWS = (5, 20, 40, 120, 200)
VOLATILITY_WINDOWS = {"volatility_5d": 5, "volatility_20d": 20, "volatility_60d": 60}
RSI_ROWS = ATR_ROWS = 14
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
VOLUME_ROWS = 20
#: Bars of a task of the full suite, whose generated code takes seconds of every task to get going.
ROWS_A_TASK = 1_000_000

FAMILIES = (
    "returns", "sma", "ema", "std", "bands", "rsi", "macd", "atr",
    "volume", "vwap", "obv", "volatility", "momentum",
)

def _zero() -> Column:
    return F.lit(0.0)


def _columns(families) -> list[str]:
    names = {
        "returns": list(RETURN_PERIODS),
        "sma": [f"sma_{n}" for n in MA_WINDOWS],
        "ema": [f"ema_{n}" for n in MA_WINDOWS],
        "std": [f"std_Div_{n}" for n in MA_WINDOWS],
        "bands": [f"bollinger_Band_{n}_2STD" for n in MA_WINDOWS],
        "momentum": ["momentum"],
        "rsi": ["rsi_14"],
        "atr": ["atr_14"],
        "macd": ["macd", "macd_signal", "macd_histogram"],
        "volume": ["volume_sma_20", "volume_ema_20", "volume_ratio"],
        "vwap": ["vwap"],
        "obv": ["obv"],
        "volatility": list(VOLATILITY_WINDOWS),
    }
    order = ("returns", "sma", "ema", "std", "bands", "momentum", "rsi", "atr", "macd",
             "volume", "vwap", "obv", "volatility")
    return [c for f in order if f in families for c in names[f]]


def _steps(c: Column, prev: Column) -> dict[str, Column]:
    """Day-over-day quantities of a row."""
    change = c - prev
    tr = F.greatest(
        F.col("high_Price") - F.col("low_Price"),
        F.abs(F.col("high_Price") - prev),
        F.abs(F.col("low_Price") - prev),
    )
    return {
        "_up": F.greatest(change, _zero()),
        "_down": F.greatest(-change, _zero()),
        "_ret": F.try_divide(c, prev) - F.lit(1.0),
        "_tr": F.when(prev.isNull(), F.col("high_Price") - F.col("low_Price")).otherwise(tr),
        "_flow": F.col("trade_Volume") * F.signum(F.coalesce(change, _zero())),
        "_dir": F.when(prev.isNull(), 0).when(change >= 0, 1).otherwise(-1),
    }


def _turning(c: Column) -> Column:
    """Row number where the direction differs from the row before, else NULL."""
    prev, prev2 = F.col("_prev"), F.col("_prev2")
    same = prev2.isNotNull() & ((c >= prev) == (prev >= prev2))
    return F.when(~same, F.col("_rn"))


def _strength(up: Column, down: Column) -> Column:
    """RSI from average gain and loss; no losses means 100, no movement at all 50."""
    ratio = F.try_divide(up, down)
    return (
        F.when(down.isNull() | up.isNull(), None)
        .when(down == 0, F.when(up > 0, F.lit(100.0)).otherwise(F.lit(50.0)))
        .otherwise(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + ratio))
    )


def _rolling(families: set[str], rsi_method: str) -> dict[str, Rolling]:
    """The rolling windows that the families need, by the series they run over."""
    close = tuple(MA_WINDOWS)
    out = {}
    if families & {"std", "bands"}:
        out["close"] = Rolling("_close", "close_Price", close, "spread")
    elif "sma" in families:
        out["close"] = Rolling("_close", "close_Price", close)
    if "volume" in families:
        out["volume"] = Rolling("_volume", "trade_Volume", (VOLUME_ROWS,))
    if "rsi" in families and rsi_method == "mean":
        out |= {side: Rolling(f"_mean{side}", side, (RSI_ROWS,)) for side in ("_up", "_down")}
    if "volatility" in families:
        out["return"] = Rolling("_return", "_ret", tuple(VOLATILITY_WINDOWS.values()), "spread")
    return out


def indicators(
    bars: DataFrame,
    families=FAMILIES,
    lag: int = 1,
    bollinger_lag: int = 2,
    index_flag: Column | None = None,
    rsi_method: str = "mean",
) -> DataFrame:
    """Append the indicator columns of ``families`` to a (date, ticker) bar table.

    ``index_flag`` marks rows of index tickers; their volatility stays NULL.
    """
    families = set(families)
    unknown = families - set(FAMILIES)
    if unknown:
        raise ValueError(f"unknown indicator families: {sorted(unknown)}")
    c = F.col("close_Price")
    prices = ("open_Price", "high_Price", "low_Price", "close_Price")
    bars = bars.withColumns({p: finite(p) for p in prices if p in bars.columns})

    decays: dict[str, Decay] = {}
    if "ema" in families:
        decays |= {f"ema_{n}": Decay.span("_filled", n) for n in MA_WINDOWS}
    if "macd" in families:
        decays["_fast"] = Decay.span("_filled", MACD_FAST, warmup=1)
        decays["_slow"] = Decay.span("_filled", MACD_SLOW, warmup=1)
    if "volume" in families:
        volume = F.col("trade_Volume").cast("double")
        decays["volume_ema_20"] = Decay.span(volume, VOLUME_ROWS, warmup=1)
    if "atr" in families:
        decays["atr_14"] = Decay.wilder("_tr", ATR_ROWS)
    if "rsi" in families and rsi_method == "wilder":
        for side in ("_up", "_down"):
            decays[f"_smooth{side}"] = Decay.wilder(F.coalesce(F.col(side), _zero()), RSI_ROWS, 1)
    signal = {"macd_signal": Decay.span("macd", MACD_SIGNAL, warmup=1)} if "macd" in families else {}

    blocked = Series(bars, [*decays.values(), *signal.values()])
    df, w = blocked.df, blocked.window
    keep = list(bars.columns)

    # stage 1: neighbours of the row, then windows while rows are still narrow
    first = {"_prev": F.lag(c).over(w)}
    if families & {"ema", "macd"}:
        first["_filled"] = F.last(c, ignorenulls=True).over(running(w))
    if "momentum" in families:
        first["_prev2"] = F.lag(c, 2).over(w)
    df = df.withColumns(first)
    df = df.withColumns(_steps(c, F.col("_prev")))
    rolling = _rolling(families, rsi_method)
    df = with_moments(df, w, list(rolling.values()))
    means: dict[str, Column] = {}
    if families & {"std", "bands"}:
        means |= {f"std_Div_{n}": rolling["close"].std(n) for n in MA_WINDOWS}
    if "sma" in families:
        means |= {f"sma_{n}": rolling["close"].mean(n) for n in MA_WINDOWS}
    if "volume" in families:
        means["volume_sma_20"] = rolling["volume"].mean(VOLUME_ROWS)
    if "rsi" in families and rsi_method == "mean":
        means |= {f"_rsi{s}": rolling[s].mean(RSI_ROWS) for s in ("_up", "_down")}
    if "volatility" in families:
        for name, n in VOLATILITY_WINDOWS.items():
            value = rolling["return"].std(n)
            means[name] = F.when(~index_flag, value) if index_flag is not None else value
    df = df.withColumns(means) if means else df

    # stage 2: running values, block-local sums
    second = blocked.local_sums(decays)
    if "returns" in families:
        second |= {k: F.try_divide(c, F.lag(c, n).over(w)) - F.lit(1.0) for k, n in RETURN_PERIODS.items()}
    if "vwap" in families:
        volume = F.sum(F.col("trade_Volume").cast("double")).over(running(w))
        second["vwap"] = F.try_divide(F.sum(c * F.col("trade_Volume")).over(running(w)), volume)
    if "obv" in families:
        second["obv"] = F.sum("_flow").over(running(w))
    if "momentum" in families:
        length = F.col("_rn") - F.last(_turning(c), True).over(running(w)) + 1
        second["momentum"] = (F.col("_dir") * length).cast("double")
    df = df.withColumns(second) if second else df

    # stage 3: raw values of the row, in two projections small enough to be JIT-compiled
    def full(n: int, value: Column, extra: int = 0) -> Column:
        return F.when(F.col("_rn") >= n + extra, value)

    for step in range(1, max(1, blocked.max_depth(decays)) + 1):
        third = blocked.carries(decays, step)
        df = df.withColumns(third) if third else df
    values = blocked.values(decays, masked=False)
    df = df.withColumns(values) if values else df
    if "macd" in families:
        df = blocked.smooth(df.withColumn("macd", F.col("_fast") - F.col("_slow")), signal)

    raw: dict[str, Column] = {
        name: full(d.warmup, F.col(name)) for name, d in decays.items() if d.warmup > 1
    }
    if "rsi" in families:
        source = "_rsi" if rsi_method == "mean" else "_smooth"
        raw |= {f"_rsi{s}": full(RSI_ROWS, F.col(source + s), 1) for s in ("_up", "_down")}
    df = df.withColumns(raw) if raw else df

    # stage 4: values built from raw values
    if "macd" in families:
        shown = MACD_SLOW + MACD_SIGNAL - 1
        df = df.withColumns(
            {
                "macd_histogram": full(shown, F.col("macd") - F.col("macd_signal")),
                "macd_signal": full(shown, F.col("macd_signal")),
                "macd": full(MACD_SLOW, F.col("macd")),
            }
        )
    late: dict[str, Column] = {}
    if "rsi" in families:
        late["rsi_14"] = _strength(F.col("_rsi_up"), F.col("_rsi_down"))
    if "volume" in families:
        late["volume_ratio"] = F.try_divide(F.col("trade_Volume").cast("double"), F.col("volume_sma_20"))
    df = df.withColumns(late) if late else df

    # stage 5: shift
    def shift(x: Column, n: int) -> Column:
        return x if n == 0 else F.lag(x, n).over(w)

    out = []
    for name in _columns(families):
        if name.startswith("bollinger_Band_"):
            n = int(name.split("_")[2])
            out.append(shift(F.col(f"std_Div_{n}") * F.lit(4.0), bollinger_lag).alias(name))
        else:
            out.append(shift(F.col(name), lag).alias(name))
    return df.select(*keep, *out)


def add_all_indicators(bars: DataFrame, index_flag: Column | None = None) -> DataFrame:
    """The full suite in table order."""
    return indicators(bars, FAMILIES, index_flag=index_flag)


def momentum_streak(bars: DataFrame, lag: int = 1) -> DataFrame:
    """Length of the current run of rises (+) or falls (-); no change counts as a rise."""
    return indicators(bars, ["momentum"], lag=lag)


def trailing_returns(bars: DataFrame, rows: dict[str, int]) -> DataFrame:
    """Latest close against the first close of the trailing ``n`` rows, plus year to date."""
    from pyspark.sql import Window

    newest = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    whole = Window.partitionBy("ticker")
    numbered = bars.select("ticker", "date", "close_Price").select(
        "*",
        F.row_number().over(newest).alias("_r"),
        F.max("date").over(whole).alias("_last"),
    )
    c = F.col("close_Price")
    in_year = F.col("date") >= F.trunc("_last", "year")

    def change(mask: Column) -> Column:
        first = F.min_by(c, F.when(mask, F.col("date")))
        last = F.max_by(c, F.when(mask, F.col("date")))
        return F.try_divide(last, first) - F.lit(1.0)

    aggs = [change(F.col("_r") <= n).alias(name) for name, n in rows.items()]
    return numbered.groupBy("ticker").agg(*aggs, change(in_year).alias("YTD"))


def latest_quote(bars: DataFrame) -> DataFrame:
    """Newest bar per ticker with the change against the bar before it."""
    from pyspark.sql import Window

    w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    c, prev = F.col("close_Price"), F.col("prev_close")
    last_two = (
        bars.select("ticker", "date", "close_Price")
        .withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= 2)
    )
    return (
        last_two.groupBy("ticker")
        .agg(
            F.max("date").alias("date"),
            F.max(F.when(F.col("_r") == 1, c)).alias("close_Price"),
            F.max(F.when(F.col("_r") == 2, c)).alias("prev_close"),
        )
        .withColumn("change_abs", c - prev)
        .withColumn("change_pct", F.try_divide(c - prev, prev) * F.lit(100.0))
    )


def price_momentum(bars: DataFrame, rows: int = 252) -> DataFrame:
    """Latest close against the 63rd and 126th newest close of the last ``rows`` bars."""
    from pyspark.sql import Window

    w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    c = F.col("close_Price")
    at = lambda n: F.max(F.when(F.col("_r") == n, c))
    return (
        bars.select("ticker", "date", "close_Price")
        .withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= rows)
        .groupBy("ticker")
        .agg(
            (F.try_divide(at(1), at(63)) - F.lit(1.0)).alias("m3"),
            (F.try_divide(at(1), at(126)) - F.lit(1.0)).alias("m6"),
        )
    )


def incremental_indicators(history: DataFrame, fresh: DataFrame, families=FAMILIES, rows: int | None = None) -> DataFrame:
    """Indicator rows of newly arrived bars only, equal to a full recompute.

    New bars win over stored bars of the same key. Cumulative and recursive indicators
    need the whole history of the tickers that changed, and only of those. The day from which
    a ticker's rows are new travels with the narrow bars, so the wide rows meet no join.
    ``rows``, where known, is the number of bars of both sides and bounds the tasks' memory.
    """
    from tickerloom.operators.joins import keep_latest

    touched = fresh.groupBy("ticker").agg(F.min("date").alias("_from"))
    stored = history.join(touched, "ticker").withColumn("_src", F.lit(0))
    arrived = fresh.join(touched, "ticker").withColumn("_src", F.lit(1))
    merged = keep_latest(stored.unionByName(arrived), ["ticker", "date"], [F.col("_src")]).drop("_src")
    if rows is not None:
        merged = dealt(merged, "ticker", rows=rows, each=ROWS_A_TASK)
    return indicators(merged, families).where(F.col("date") >= F.col("_from")).drop("_from")
