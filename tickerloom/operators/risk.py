"""Price bands and tail risk from return distributions, in closed form.

A geometric Brownian motion has known quantiles, so bands come from the parameters instead
of simulated paths; path tables from elsewhere are summarised by exact percentiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.scalar import cagr
from tickerloom.operators.joins import keep_latest
from tickerloom.operators.percentiles import exact_percentiles
from tickerloom.operators.portfolio import TRADING_DAYS, Market, dot, log_returns
from tickerloom.session import materialised

# Standard normal quantiles and the 5 % point of chi-square(2).
Z = {"percentile_5": -1.6448536, "percentile_16": -0.9944579,
     "percentile_84": 0.9944579, "percentile_95": 1.6448536}
NORMALITY_LIMIT = 5.991


def gbm_parameters(prices: DataFrame) -> DataFrame:
    """Annual drift and volatility of log returns per ticker, with the latest close.

    The centre is the mean where the Jarque-Bera statistic accepts normality, else the
    median. A ticker's returns are bounded by its number of trading days.
    """
    r = F.col("r")
    n, s, k = F.count(r), F.skewness(r), F.kurtosis(r)
    jb = F.when(F.var_pop(r) > 0, n / F.lit(6.0) * (s * s + k * k / F.lit(4.0)))
    stats = log_returns(prices).groupBy("ticker").agg(
        n.alias("n"),
        F.avg(r).alias("mean_r"),
        F.median(r).alias("median_r"),
        F.stddev_samp(r).alias("std_r"),
        jb.alias("jarque_bera"),
    )
    last = keep_latest(prices.select("ticker", "date", "close_Price"), ["ticker"], [F.col("date")])
    normal = F.coalesce(F.col("jarque_bera") <= NORMALITY_LIMIT, F.lit(True))
    centre = F.when(normal, F.col("mean_r")).otherwise(F.col("median_r"))
    days = float(TRADING_DAYS)
    out = stats.withColumn("is_normal", normal).withColumns(
        {"mu": F.lit(days) * centre, "sigma": F.sqrt(F.lit(days)) * F.col("std_r")}
    )
    return out.join(
        last.select("ticker", F.col("close_Price").alias("starting_price")), "ticker"
    ).select("ticker", "n", "mean_r", "median_r", "std_r", "jarque_bera", "is_normal", "mu", "sigma",
             "starting_price")


def _bands(start: Column, mu: Column, sigma: Column, t: Column) -> dict[str, Column]:
    drift = (mu - sigma * sigma / F.lit(2.0)) * t
    out = {
        name: start * F.exp(drift + sigma * F.sqrt(t) * F.lit(z)) for name, z in Z.items()
    }
    out["mean_price"] = start * F.exp(mu * t)
    return out


def yearly_bands(parameters: DataFrame, years: int = 10) -> DataFrame:
    """Price quantiles and mean per ticker for year 0 .. ``years``."""
    rows = parameters.select(
        "ticker", "mu", "sigma", "starting_price",
        F.explode(F.sequence(F.lit(0), F.lit(years))).alias("simulation_year"),
    )
    t = F.col("simulation_year").cast("double")
    bands = _bands(F.col("starting_price"), F.col("mu"), F.col("sigma"), t)
    return rows.select(
        "ticker", "simulation_year", "starting_price", *[c.alias(n) for n, c in bands.items()]
    )


def band_returns(bands: DataFrame) -> DataFrame:
    """Annualised return of the 5 %, mean and 95 % band."""
    year, start = F.col("simulation_year"), F.col("starting_price")
    return bands.select(
        "ticker",
        "simulation_year",
        cagr("percentile_5", start, year).alias("return_percentile_5"),
        cagr("mean_price", start, year).alias("return_mean"),
        cagr("percentile_95", start, year).alias("return_percentile_95"),
    )


def portfolio_bands(portfolios: DataFrame, stats: DataFrame, years: int = 5, run: str = "run_id") -> DataFrame:
    """Value bands of a unit investment per run from weights, means and covariances.

    The portfolio's log return over t years is normal with mean (w.mu)t and variance
    (w'Sw)t; ``mu`` holds mean log returns, so the arithmetic drift adds half the variance.
    """
    market = Market(stats)
    base = portfolios.select(run, "w").withColumns({"_mu": market.mu, "_cov": market.cov})
    spread = F.transform("_cov", lambda row: dot(row, F.col("w")))
    # a run's moments once, then its years
    base = base.select(run, dot(F.col("w"), F.col("_mu")).alias("m"), dot(F.col("w"), spread).alias("v"))
    base = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(years))).alias("simulation_year"))
    t = F.col("simulation_year").cast("double")
    mu = F.col("m") + F.col("v") / F.lit(2.0)
    bands = _bands(F.lit(1.0), mu, F.sqrt("v"), t)
    return base.select(run, "simulation_year", *[c.alias(n) for n, c in bands.items()])


def path_summary(paths: DataFrame, days_per_year: int = TRADING_DAYS) -> DataFrame:
    """Percentiles and mean by year over a table (path_id, day, value) of any size."""
    rows = paths.select(F.floor((F.col("day") - 1) / days_per_year).cast("int").alias("year"), "value")
    probs = {"percentile_5": 0.05, "percentile_16": 0.16, "percentile_84": 0.84, "percentile_95": 0.95}
    means = rows.groupBy("year").agg(F.avg("value").alias("mean_price"))
    return exact_percentiles(rows, ["year"], "value", probs).join(means, "year")


def final_returns(paths: DataFrame) -> DataFrame:
    """Mean, 5 % and 95 % of the total return over all paths."""
    ends = paths.groupBy("path_id").agg(
        F.min_by("value", "day").alias("first"), F.max_by("value", "day").alias("last")
    )
    r = F.try_divide(F.col("last"), F.col("first")) - F.lit(1.0)
    rows = materialised(ends.select(F.lit("all").alias("scope"), r.alias("r")), "returns")
    probs = {"return_percentile_5": 0.05, "return_percentile_95": 0.95}
    means = rows.groupBy("scope").agg(F.avg("r").alias("return_mean"))
    return exact_percentiles(rows, ["scope"], "r", probs).join(means, "scope").drop("scope")


def historical_tail(prices: DataFrame, level: float = 0.05) -> DataFrame:
    """VaR and CVaR of daily log returns per ticker (bounded by its trading days)."""
    r = log_returns(prices)
    cut = r.groupBy("ticker").agg(F.percentile("r", F.lit(level)).alias("var_95"))
    return (
        r.join(cut, "ticker")
        .where(F.col("r") <= F.col("var_95"))
        .groupBy("ticker")
        .agg(F.first("var_95").alias("var_95"), F.avg("r").alias("cvar_95"), F.count(F.lit(1)).alias("tail_days"))
    )


def latest_runs(results: DataFrame, date: str = "simulation_date") -> DataFrame:
    """All rows of each ticker's newest run."""
    w = Window.partitionBy("ticker").orderBy(F.col(date).desc())
    return results.withColumn("_r", F.rank().over(w)).where(F.col("_r") == 1).drop("_r")
