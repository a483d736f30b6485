"""Rolling beta, correlation and R-squared against benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.scalar import beta_label, finite
from tickerloom.operators.joins import keep_latest
from tickerloom.operators.moments import Rolling, with_moments

BETA_WINDOWS = (60, 120, 252)
LONG = 252
BETAS = [*(f"beta_{n}d" for n in BETA_WINDOWS), "correlation_252d", "r_squared_252d"]


def rolling_betas(pairs: DataFrame, keys=("ticker", "index_code"), windows=BETA_WINDOWS,
                  lag: int = 0) -> DataFrame:
    """Betas over (date, keys, close_Price, index_close) rows of common dates.

    Returns are taken between consecutive common dates; NaN and infinite closes count as
    missing. Windows are merged from shorter ones (``moments``); one extreme return is forgotten
    when it leaves them.
    """
    w = Window.partitionBy(*keys).orderBy("date")
    c, m = finite("close_Price"), finite("index_close")
    df = pairs.withColumns(
        {
            "_x": F.try_divide(c, F.lag(c).over(w)) - F.lit(1.0),
            "_y": F.try_divide(m, F.lag(m).over(w)) - F.lit(1.0),
        }
    )
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    df = df.withColumns({"_x": F.when(both, F.col("_x")), "_y": F.when(both, F.col("_y"))})
    pair = Rolling("_m", "_x", tuple(windows), "pair", "_y")
    df = with_moments(df, w, [pair])
    xx, yy, xy = (lambda n, f=f: pair.figure(f, n) for f in ("xx", "yy", "xy"))

    out: dict[str, Column] = {}
    for n in windows:
        out[f"beta_{n}d"] = F.when(yy(n) > F.lit(1e-18), F.try_divide(xy(n), yy(n)))
    ok = (yy(LONG) > F.lit(1e-18)) & (xx(LONG) > F.lit(1e-18))
    corr = F.when(ok, xy(LONG) / (F.sqrt(xx(LONG)) * F.sqrt(yy(LONG))))
    out["correlation_252d"] = corr
    out["r_squared_252d"] = corr * corr
    df = df.withColumns(out)
    shown = [F.lag(b, lag).over(w).alias(b) if lag else F.col(b) for b in BETAS]
    return df.select("date", *keys, *shown)


def beta_table(bars: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Betas of every ticker against every benchmark; rows without any value dropped."""
    index = benchmarks.select("index_code", "date", F.col("close_Price").alias("index_close"))
    pairs = bars.select("date", "ticker", "close_Price").join(index, "date")
    return rolling_betas(pairs).na.drop(how="all", subset=BETAS)


def own_beta(bars: DataFrame, membership: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Betas of every ticker against the index it belongs to."""
    index = benchmarks.select("index_code", "date", F.col("close_Price").alias("index_close"))
    pairs = (
        bars.select("date", "ticker", "close_Price")
        .join(membership.select("ticker", "index_code"), "ticker")
        .join(index, ["index_code", "date"])
    )
    return rolling_betas(pairs)


def latest_betas(betas: DataFrame) -> DataFrame:
    latest = keep_latest(betas, ["ticker", "index_code"], [F.col("date")])
    return latest.withColumn("label", beta_label("beta_252d"))
