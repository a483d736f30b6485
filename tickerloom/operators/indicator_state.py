"""Indicators of new bars from one stored row per ticker, without reading any stored bar.

The row holds what the next bars need of the past: the number of bars, the last closes and
volumes that a window or a return can reach, and the carried values of everything recursive
(exponential means, true range, running sums, the streak). New bars advance it. Rows come out
as :func:`tickerloom.operators.indicators.add_all_indicators` would give them for the whole history.

``version`` is the date of the last bar that a row has taken in. Bars up to it are ignored, so a
batch that arrives twice changes nothing; corrections of older bars go through
:func:`~tickerloom.operators.indicators.incremental_indicators`.

New bars of a ticker are one array (as many as there are days in a batch); the join brings them
to the state, whose row is read once. Values are array expressions; no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.functions.scalar import finite
from tickerloom.operators.indicators import (
    ATR_ROWS, FAMILIES, MA_WINDOWS, MACD_FAST, MACD_SIGNAL, MACD_SLOW, RETURN_PERIODS, RSI_ROWS, VOLATILITY_WINDOWS,
    VOLUME_ROWS, _columns, _strength,
)
from tickerloom.operators.joins import keep_latest

#: The longest return, and the close it starts from.
CLOSES = max(RETURN_PERIODS.values()) + 1
#: The closes that windows of the last bar and of the one before it reach.
RECENT = max(*MA_WINDOWS, *VOLATILITY_WINDOWS.values()) + 1
PRICES = ("open_Price", "high_Price", "low_Price", "close_Price")
BAR = ("date", *PRICES, "trade_Volume")

#: Smoothing factors of the values that decay from bar to bar.
ALPHAS = {
    **{f"ema_{n}": 2.0 / (n + 1) for n in MA_WINDOWS},
    "fast": 2.0 / (MACD_FAST + 1), "slow": 2.0 / (MACD_SLOW + 1), "signal": 2.0 / (MACD_SIGNAL + 1),
    "volume_ema": 2.0 / (VOLUME_ROWS + 1), "atr": 1.0 / ATR_ROWS,
}
_DOUBLES = ("prev", "prev2", "filled", *ALPHAS, "price_volume", "volume", "obv")
CARRY = "struct<n:bigint,turn:bigint,dir:int," + ",".join(f"{c}:double" for c in _DOUBLES) + ">"


def _empty() -> Column:
    """The carry before the first bar."""
    return F.struct(
        F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("turn"), F.lit(0).alias("dir"),
        *[F.lit(None).cast("double").alias(c) for c in _DOUBLES],
    )


def _decayed(e: Column, x: Column, alpha: float, first: Column) -> Column:
    """Next value of an exponential mean; it starts at the first bar, a missing value only decays it."""
    kept = e * F.lit(1.0 - alpha)
    inflow = F.when(first, x).otherwise(x * F.lit(alpha))
    return F.when(x.isNull(), kept).otherwise(F.coalesce(kept, F.lit(0.0)) + inflow)


def _total(total: Column, x: Column) -> Column:
    return F.when(x.isNull(), total).otherwise(F.coalesce(total, F.lit(0.0)) + x)


def _advance(acc: Column, bar: Column) -> Column:
    """The carry after one more bar."""
    n = acc["n"] + F.lit(1)
    first = acc["n"] == 0
    c, high, low = (bar[p] for p in ("close_Price", "high_Price", "low_Price"))
    volume = bar["trade_Volume"].cast("double")
    prev, prev2 = acc["prev"], acc["prev2"]
    filled = F.coalesce(c, acc["filled"])
    true_range = F.when(prev.isNull(), high - low).otherwise(
        F.greatest(high - low, F.abs(high - prev), F.abs(low - prev))
    )
    new = {f"ema_{k}": _decayed(acc[f"ema_{k}"], filled, ALPHAS[f"ema_{k}"], first) for k in MA_WINDOWS}
    new |= {k: _decayed(acc[k], filled, ALPHAS[k], first) for k in ("fast", "slow")}
    new["signal"] = _decayed(acc["signal"], new["fast"] - new["slow"], ALPHAS["signal"], first)
    new["volume_ema"] = _decayed(acc["volume_ema"], volume, ALPHAS["volume_ema"], first)
    new["atr"] = _decayed(acc["atr"], true_range, ALPHAS["atr"], first)
    same = prev2.isNotNull() & ((c >= prev) == (prev >= prev2))
    new |= {
        "prev": c, "prev2": prev, "filled": filled,
        "price_volume": _total(acc["price_volume"], c * volume),
        "volume": _total(acc["volume"], volume),
        "obv": _total(acc["obv"], volume * F.signum(F.coalesce(c - prev, F.lit(0.0)))),
    }
    return F.struct(
        n.alias("n"), F.when(~same, n).otherwise(acc["turn"]).alias("turn"),
        F.when(prev.isNull(), 0).when(c >= prev, 1).otherwise(-1).alias("dir"),
        *[new[k].alias(k) for k in _DOUBLES],
    )


# ---------------------------------------------------------------- values of a bar

def _slice(values: str, upto: Column, n: int) -> Column:
    """The ``n`` values that end at place ``upto`` (from 1), NULL if there are not as many."""
    return F.when(upto >= n, F.slice(values, upto - F.lit(n - 1), F.lit(n)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _std(values: Column, n: int) -> Column:
    """Sample deviation of ``n`` values around their mean."""
    start = F.struct(F.lit(0.0).alias("sum"), (_sum(values) / F.lit(float(n))).alias("mean"))
    squares = F.aggregate(
        values, start,
        lambda a, x: F.struct((a["sum"] + (x - a["mean"]) * (x - a["mean"])).alias("sum"), a["mean"].alias("mean")),
        lambda a: a["sum"],
    )
    return F.sqrt(squares / F.lit(float(n - 1)))


def _values(carry: Column, at: Column, is_index: Column) -> dict[str, Column]:
    """Unlagged values of the bar whose close is number ``at`` of ``closes`` and whose carry is given.

    ``recent`` and ``volumes`` end where ``closes`` does but may start later; bands are those of
    the bar before.
    """
    n = carry["n"]
    closes, recent, volumes = "closes", "recent", "volumes"
    own = at - F.size(closes) + F.size(recent)
    shown = lambda rows, value: F.when(n >= rows, value)
    last = F.get(closes, (at - 1).cast("int"))
    out = {k: F.try_divide(last, F.when(at > p, F.get(closes, (at - 1 - p).cast("int")))) - F.lit(1.0)
           for k, p in RETURN_PERIODS.items()}
    for k in MA_WINDOWS:
        out[f"sma_{k}"] = _sum(_slice(recent, own, k)) / F.lit(float(k))
        out[f"ema_{k}"] = shown(k, carry[f"ema_{k}"])
        out[f"std_Div_{k}"] = _std(_slice(recent, own, k), k)
        out[f"bollinger_Band_{k}_2STD"] = _std(_slice(recent, own - 1, k), k) * F.lit(4.0)
    out["momentum"] = (carry["dir"] * (n - carry["turn"] + 1)).cast("double")
    moves = F.zip_with(_slice(recent, own, RSI_ROWS), _slice(recent, own - 1, RSI_ROWS), lambda a, b: a - b)
    side = lambda sign: _sum(
        F.transform(moves, lambda x: F.greatest(x * F.lit(sign), F.lit(0.0)))) / F.lit(float(RSI_ROWS))
    out["rsi_14"] = _strength(side(1.0), side(-1.0))
    out["atr_14"] = shown(ATR_ROWS, carry["atr"])
    macd, full = carry["fast"] - carry["slow"], MACD_SLOW + MACD_SIGNAL - 1
    out["macd"] = shown(MACD_SLOW, macd)
    out["macd_signal"] = shown(full, carry["signal"])
    out["macd_histogram"] = shown(full, macd - carry["signal"])
    place = F.size(volumes) - (F.size(closes) - at)
    mean_volume = _sum(_slice(volumes, place, VOLUME_ROWS)) / F.lit(float(VOLUME_ROWS))
    out["volume_sma_20"] = mean_volume
    out["volume_ema_20"] = carry["volume_ema"]
    out["volume_ratio"] = F.try_divide(F.get(volumes, (place - 1).cast("int")), mean_volume)
    out["vwap"] = F.try_divide(carry["price_volume"], carry["volume"])
    out["obv"] = carry["obv"]
    for name, k in VOLATILITY_WINDOWS.items():
        returns = F.zip_with(
            _slice(recent, own, k), _slice(recent, own - 1, k), lambda a, b: F.try_divide(a, b) - F.lit(1.0)
        )
        out[name] = F.when(~is_index, _std(returns, k))
    return out


# ---------------------------------------------------------------- operators

def _bars_of(bars: DataFrame) -> DataFrame:
    """``ticker, bars``: each ticker's bars by date, the later row of a repeated key."""
    clean = bars.select("ticker", "date", *[finite(p).alias(p) for p in PRICES], "trade_Volume")
    # few rows and much work on each: a fixed number of partitions, which are not merged by size
    clean = clean.repartition(int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ticker")
    clean = keep_latest(clean, ["ticker", "date"], [F.struct(*PRICES, "trade_Volume")])
    return clean.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct(*BAR))).alias("bars"))


def _tail(values: Column, n: int) -> Column:
    return F.slice(values, F.greatest(F.size(values) - F.lit(n - 1), F.lit(1)), F.lit(n))


def initial_state(bars: DataFrame) -> DataFrame:
    """``ticker, version, carry, closes, volumes`` after all bars of a (ticker, date) table."""
    rows = _bars_of(bars)
    volumes = F.transform(_tail(F.col("bars"), VOLUME_ROWS), lambda b: b["trade_Volume"].cast("double"))
    return rows.select(
        "ticker", F.element_at("bars", -1)["date"].alias("version"),
        F.aggregate("bars", _empty(), _advance).cast(CARRY).alias("carry"),
        F.transform(_tail(F.col("bars"), CLOSES), lambda b: b["close_Price"]).alias("closes"), volumes.alias("volumes"),
    )


def advance(state: DataFrame, fresh: DataFrame, index_flag: Column | None = None) -> DataFrame:
    """One row for each ticker that has bars after its version: those bars, and what they bring.

    Tickers without a state start one. Store the result before taking both :func:`new_rows` and
    :func:`next_state` from it, or it is computed twice.
    """
    flag = F.lit(False) if index_flag is None else index_flag
    joined = (
        _bars_of(fresh).join(state, "ticker", "left")
        .withColumn("bars", F.filter("bars", lambda b: F.coalesce(b["date"] > F.col("version"), F.lit(True))))
        .where(F.size("bars") > 0)
    )
    none = F.array().cast("array<double>")
    held = F.coalesce("closes", none)
    new = F.transform("bars", lambda b: b["close_Price"])
    return joined.select(
        "ticker", "bars", F.coalesce(flag, F.lit(False)).alias("is_index"), F.size(held).alias("known"),
        F.concat(held, new).alias("closes"), F.concat(_tail(held, RECENT), new).alias("recent"),
        F.concat(F.coalesce("volumes", none), F.transform("bars", lambda b: b["trade_Volume"].cast("double"))).alias("volumes"),
        # the carry before the first new bar, after it, and so on
        F.aggregate(
            "bars", F.array(F.coalesce("carry", _empty().cast(CARRY))),
            lambda seen, bar: F.concat(seen, F.transform(F.slice(seen, -1, 1), lambda c: _advance(c, bar).cast(CARRY))),
        ).alias("carries"),
    )


def new_rows(advanced: DataFrame) -> DataFrame:
    """Indicator rows of the new bars, with the columns of ``add_all_indicators``."""
    # a new bar shows the values of the bar before it; arrays stay columns, so each is built once
    rows = advanced.select("*", F.posexplode("bars").alias("i", "bar")).withColumn("carry", F.get("carries", F.col("i")))
    values = _values(F.col("carry"), F.col("known") + F.col("i"), F.col("is_index"))
    bar = [F.col(f"bar.{c}").alias(c) for c in BAR[1:]]
    return rows.select("bar.date", "ticker", *bar, *[values[c].alias(c) for c in _columns(FAMILIES)])


def next_state(state: DataFrame, advanced: DataFrame) -> DataFrame:
    """The state table after the new bars; tickers without any keep their row."""
    moved = advanced.select(
        "ticker", F.element_at("bars", -1)["date"].alias("version"), F.element_at("carries", -1).alias("carry"),
        _tail(F.col("closes"), CLOSES).alias("closes"), _tail(F.col("volumes"), VOLUME_ROWS).alias("volumes"),
    )
    return state.join(moved.select("ticker"), "ticker", "left_anti").unionByName(moved)


# ---------------------------------------------------------------- stored generations

def _generations(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete generations under ``path``, in order."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(f"{path}/generation=*/_SUCCESS")
    found = at.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete state under ``path``."""
    return spark.read.parquet(f"{path}/generation={_generations(spark, path)[-1]}")


def save_state(state: DataFrame, path: str) -> None:
    """Writes the next generation beside the older ones, so a reader never sees half a state.

    A crash leaves a folder without ``_SUCCESS``, which no reader takes and the next writer replaces.
    """
    spark = state.sparkSession
    number = max(_generations(spark, path), default=0) + 1
    state.write.mode("overwrite").parquet(f"{path}/generation={number}")


def advance_stored(fresh: DataFrame, state_path: str, rows_path: str, index_flag: Column | None = None) -> None:
    """Takes a batch in: its indicator rows go to ``rows_path`` by year, then the state moves on.

    After a crash in between, the same batch gives the same rows and overwrites them in place.
    """
    from tickerloom.session import materialised
    from tickerloom.sources.readers import has_files
    from tickerloom.sources.writers import write_partitions

    spark = fresh.sparkSession
    state = load_state(spark, state_path)
    advanced = materialised(advance(state, fresh, index_flag), "advanced")
    rows = new_rows(advanced).withColumn("year", F.year("date"))
    years = [r.year for r in rows.select("year").distinct().collect()]  # calendar years of a batch
    if not years:
        return
    if has_files(spark, rows_path):
        kept = spark.read.parquet(rows_path).where(F.col("year").isin(years))
        kept = kept.join(rows.select("ticker", "date"), ["ticker", "date"], "left_anti")
        rows = rows.unionByName(kept)
    write_partitions(rows, rows_path, "year")
    save_state(next_state(state, advanced), state_path)
