"""Ranking, return moments, candidate portfolios and holdings.

A selection may hold any number of names; its moments are arrays in ticker order. The
covariance is aggregated in blocks of ``BLOCK`` names, so plans do not grow with the names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.scalar import clip
from tickerloom.operators.joins import complete_dates, keep_latest
from tickerloom.session import dealt, materialised

# Fixed values
TRADING_DAYS = 252
STRATEGIES = ("balanced", "dividend", "growth", "value", "garp", "quality", "momentum")
VOLATILITY_CAPS = {"low": 0.15, "medium": 0.25, "high": 0.40}
MIN_HOLDING = 0.001
SCORE_BLEND = (0.7, 0.3)

#: Names per covariance block (columns of one aggregate).
BLOCK = 32

#: Candidates of a task that draws their weights; tables of ids are small files, read by one task.
WEIGHTS_A_TASK = 10_000


# ---- scores ----------------------------------------------------------------------------
def _components() -> dict[str, list[Column]]:
    """Clipped components per strategy; a component is NULL if an input is missing."""
    f = F.col
    positive = lambda c: F.when(f(c) > 0, f(c))
    pe, pb, ps = positive("pe"), positive("pb"), positive("ps")
    one = F.lit(1.0)
    payout = F.abs(f("div_ttm")) / F.when(f("shares") != 0, f("shares"))
    dividend_yield = F.when(f("price") > 0, payout / f("price"))
    peg = pe / (F.lit(100.0) * positive("eps_g"))
    return {
        "balanced": [],
        "dividend": [
            F.when(dividend_yield > 0, F.least(dividend_yield / F.lit(0.05), one)),
            F.when(pe.isNotNull(), F.greatest(one - pe / F.lit(30.0), F.lit(-0.5))),
        ],
        "growth": [clip(f("rev_g") / F.lit(0.25), -1, 1), clip(f("eps_g") / F.lit(0.30), -1, 1)],
        "value": [
            clip(one - pe / F.lit(25.0), -1, 1),
            clip(one - pb / F.lit(3.0), -1, 1),
            clip(one - ps / F.lit(4.0), -1, 1),
        ],
        "garp": [
            clip(one - peg / F.lit(2.0), -1, 1),
            clip(f("rev_g") / F.lit(0.20), -0.5, 0.5),
        ],
        "quality": [
            clip(f("roe") / F.lit(0.20), -1, 1),
            clip(f("op_margin") / F.lit(0.20), -0.5, 0.5),
            clip(one - f("de") / F.lit(2.0), -1, 1),
        ],
        "momentum": [clip(f("m3") / F.lit(0.15), -1, 1), clip(f("m6") / F.lit(0.30), -1, 1)],
    }


def fundamental_score(strategy: str) -> Column:
    parts = _components()[strategy]
    if not parts:
        return F.lit(0.0)
    total, n = F.lit(0.0), F.lit(0)
    for p in parts:
        total = total + F.coalesce(p, F.lit(0.0))
        n = n + F.when(p.isNotNull(), 1).otherwise(0)
    return clip(F.when(n > 0, total / n).otherwise(F.lit(0.0)), -1, 1)


def fundamental_scores(inputs: DataFrame) -> DataFrame:
    """One column per strategy over a table of latest fundamentals per ticker."""
    return inputs.select("ticker", *[fundamental_score(s).alias(s) for s in STRATEGIES])


def best_horizon(predictions: DataFrame, preferred: int = TRADING_DAYS) -> DataFrame:
    """The preferred horizon per ticker and date if present, else the longest one."""
    h = F.col("prediction_horizon_days")
    rank = F.when(h == preferred, F.lit(2**31 - 1)).otherwise(h)
    return keep_latest(predictions, ["ticker", "prediction_date"], [rank])


def risk_scores() -> dict[str, Column]:
    """Risk-adjusted prediction score per risk level; 0 counts as unknown, as for NULL."""
    p, r = F.col("current_price"), F.col("predicted_return")
    known = lambda x, d: F.coalesce(F.when(x != 0, x), F.lit(d))
    down = F.when(p > 0, (F.col("confidence_lower_5") - p) / p)
    up = F.when(p > 0, (F.col("confidence_upper_95") - p) / p)
    zero = F.lit(0.0)
    return {
        "low": r + F.lit(2.0) * F.least(known(down, -0.5), zero),
        "medium": r + F.lit(0.5) * F.least(known(down, -0.3), zero),
        "high": r + F.lit(0.2) * F.greatest(known(up, 0.0), zero),
    }


def scored(best: DataFrame, fundamentals: DataFrame, risk: str, strategy: str) -> DataFrame:
    """70 % risk-adjusted prediction, 30 % fundamental score."""
    a, b = SCORE_BLEND
    funda = fundamentals.select("ticker", F.col(strategy).alias("fund_score"))
    return (
        best.where(F.col("predicted_return").isNotNull())
        .join(funda, "ticker", "left")
        .withColumn("fund_score", F.coalesce("fund_score", F.lit(0.0)))
        .select(
            "ticker",
            "predicted_return",
            "fund_score",
            (F.lit(a) * risk_scores()[risk] + F.lit(b) * F.col("fund_score")).alias("score"),
        )
    )


def ranked_top(scores: DataFrame, n: int) -> DataFrame:
    """Best ``n`` tickers with their rank; only the kept rows are numbered."""
    top = scores.orderBy(F.col("score").desc(), "ticker").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "ticker")))


def eligible(predictions: DataFrame, blacklist: DataFrame, as_of: Column, max_age: int,
             excluded=()) -> DataFrame:
    """Tickers with a fresh prediction that are neither blacklisted nor excluded."""
    fresh = predictions.where(F.datediff(as_of, F.col("prediction_date")) <= max_age)
    out = fresh.select("ticker").distinct().join(blacklist.select("ticker"), "ticker", "left_anti")
    return out.where(~F.col("ticker").isin(*excluded)) if excluded else out


# ---- moments ---------------------------------------------------------------------------
def log_returns(prices: DataFrame) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("date")
    c = F.col("close_Price")
    step = F.try_divide(c, F.lag(c).over(w))
    return prices.select("date", "ticker", F.when(step > 0, F.ln(step)).alias("r")).where("r IS NOT NULL")


def return_matrix(prices: DataFrame, selected: DataFrame, min_rows: int = 504) -> DataFrame:
    """One row per common date: the kept names and their log returns, both in ticker order.

    Every kept name has a close on every common date, so all rows hold the same names; a
    return is NULL where one of its closes is not positive.
    """
    full = complete_dates(prices.select("date", "ticker", "close_Price"), selected.select("ticker"), min_rows)
    w = Window.partitionBy("ticker").orderBy("date")
    c = F.col("close_Price")
    step = F.try_divide(c, F.lag(c).over(w))
    rows = full.select("date", "ticker", F.when(step > 0, F.ln(step)).alias("r"), F.row_number().over(w).alias("_rn"))
    cells = F.array_sort(F.collect_list(F.struct("ticker", "r")))  # one cell per name
    by_date = rows.where("_rn > 1").groupBy("date").agg(cells.alias("c"))
    return by_date.select(
        "date", F.transform("c", lambda x: x["ticker"]).alias("names"), F.transform("c", lambda x: x["r"]).alias("x")
    )


def covariance(matrix: DataFrame) -> DataFrame:
    """Annualised mean of each name, and its covariances as an array in ticker order.

    Each date is expanded to one row per (name, block of ``BLOCK`` names) and combined map-side;
    the aggregate has ``BLOCK`` columns whatever the number of names. Names without returns or
    variance drop out of the result; ``pos`` is the place in the arrays.
    """
    year = F.lit(float(TRADING_DAYS))
    own = matrix.select(F.posexplode(F.arrays_zip("names", "x")).alias("pos", "n"), "x")
    own = own.select("pos", F.col("n.names").alias("ticker"), F.col("n.x").alias("xi"), "x")
    starts = F.sequence(F.lit(0), F.size("x") - 1, F.lit(BLOCK))
    rows = own.select("pos", "ticker", "xi", "x", F.explode(starts).alias("at"))
    rows = rows.select("pos", "ticker", "xi", "at", F.slice("x", F.col("at") + 1, F.lit(BLOCK)).alias("xb"))
    cov = F.array(*[F.covar_samp("xi", F.get("xb", F.lit(j))) * year for j in range(BLOCK)])
    blocks = rows.groupBy("pos", "ticker", "at").agg((F.avg("xi") * year).alias("mu"), cov.alias("cov"))
    parts = F.array_sort(F.collect_list(F.struct("at", "cov")))  # names / BLOCK cells
    stats = blocks.groupBy("pos", "ticker").agg(F.first("mu").alias("mu"), parts.alias("p"))
    stats = stats.withColumn("cov", F.flatten(F.transform("p", lambda x: x["cov"])))
    return stats.where(F.col("mu").isNotNull() & (F.get("cov", F.col("pos")) > 0)).select("ticker", "pos", "mu", "cov")


def covariance_long(stats: DataFrame) -> DataFrame:
    """(ticker, other, covariance) rows of the matrix."""
    other = stats.select(F.col("ticker").alias("other"), F.col("pos").alias("_p"))
    cells = stats.select("ticker", F.posexplode("cov").alias("_p", "covariance"))
    return cells.join(other, "_p").select("ticker", "other", "covariance")


class Market:
    """Moment arrays of a selection as scalar subqueries (names squared numbers)."""

    def __init__(self, stats: DataFrame):
        ordered = F.array_sort(F.collect_list(F.struct("pos", "ticker", "mu", "cov")))
        one = stats.agg(ordered.alias("m"))
        self.names = one.select(F.transform("m", lambda s: s["ticker"]).alias("v")).scalar()
        self.mu = one.select(F.transform("m", lambda s: s["mu"]).alias("v")).scalar()
        keep = lambda s, m: F.transform(m, lambda t: F.get(s["cov"], t["pos"]))
        self.cov = one.select(F.transform("m", lambda s: keep(s, F.col("m"))).alias("v")).scalar()


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where the optimizer copies the column."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def performance(portfolios: DataFrame, stats: DataFrame, risk_free: float = 0.04) -> DataFrame:
    """Return, volatility and Sharpe ratio of weight arrays ``w`` in position order."""
    market = Market(stats)
    base = portfolios.withColumns({"_mu": market.mu, "_cov": market.cov})
    def figures(s: Column) -> Column:
        spread = F.transform(s["cov"], lambda row: dot(row, s["w"]))
        return F.struct(dot(s["w"], s["mu"]).alias("ret"), F.sqrt(dot(s["w"], spread)).alias("vol"))

    inputs = F.struct(F.col("w"), F.col("_mu").alias("mu"), F.col("_cov").alias("cov"))
    out = base.withColumn("_p", bound(inputs, figures)).withColumns({"ret": F.col("_p.ret"), "vol": F.col("_p.vol")})
    out = out.drop("_mu", "_cov", "_p")
    sharpe = F.when(F.col("vol") > 0, (F.col("ret") - F.lit(risk_free)) / F.col("vol")).otherwise(F.lit(0.0))
    return out.withColumn("sharpe", sharpe)


def unit_uniform(seed: Column, position: Column) -> Column:
    """Reproducible number in (0, 1) from two integers, for any 64-bit seed.

    Ten decimal digits' worth of the md5 of both, which other engines have too.
    """
    digest = F.md5(F.concat_ws(":", seed.cast("string"), position.cast("string")))
    value = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return (value + F.lit(0.5)) / F.lit(4294967296.0)


def random_weights(ids: DataFrame, stats: DataFrame, id_col: str = "portfolio_id") -> DataFrame:
    """One candidate per id: a random weight per name, normalised to sum 1.

    Written once: what reads the weights several times (filters, lambdas over the rows of a
    matrix) would draw them anew each time.
    """
    count = stats.agg(F.count(F.lit(1)).cast("int").alias("n")).scalar()
    slots = F.sequence(F.lit(0), F.col("_n") - 1)
    raw = F.transform(slots, lambda i: unit_uniform(F.col(id_col), i))

    def share(r: Column) -> Column:
        total = F.aggregate(r, F.lit(0.0), lambda acc, x: acc + x)
        return bound(total, lambda t: F.transform(r, lambda x: x / t))

    drawn = (
        dealt(ids.select(id_col), each=WEIGHTS_A_TASK)
        .withColumn("_n", count)
        .where(F.col("_n") > 0)  # an empty selection has no portfolios
        .select(id_col, bound(raw, share).alias("w"))
    )
    return materialised(drawn, "weights")


def weight_cap(k: Column) -> Column:
    """Largest allowed weight for ``k`` names."""
    return F.greatest(F.least(F.lit(0.25), F.lit(1.0) / F.greatest(k * F.lit(0.5), F.lit(1.0))), F.lit(0.05))


def best_candidates(candidates: DataFrame, vol_cap: float | None = None, min_weight: float = 0.0,
                    max_weight: Column | float = 1.0, id_col: str = "portfolio_id") -> DataFrame:
    """Best candidate per objective within the weight bounds and the volatility cap."""
    upper = max_weight if isinstance(max_weight, Column) else F.lit(max_weight)
    ok = candidates.where((F.array_max("w") <= upper) & (F.array_min("w") >= min_weight))
    if vol_cap is not None:
        ok = ok.where(F.col("vol") <= vol_cap)
    row = F.struct(id_col, "ret", "vol", "sharpe", "w")
    tie = -F.col(id_col)
    best = ok.agg(
        F.max_by(row, F.struct(-F.col("vol"), tie)).alias("min_volatility"),
        F.max_by(row, F.struct(F.col("sharpe"), tie)).alias("max_sharpe"),
        F.max_by(row, F.struct(F.col("ret"), tie)).alias("max_return"),
    )
    objectives = ("min_volatility", "max_sharpe", "max_return")
    pairs = F.array(*[F.struct(F.lit(o).alias("objective"), F.col(o).alias("r")) for o in objectives])
    return best.select(F.inline(pairs)).where("r IS NOT NULL").select("objective", "r.*")


def discrete_frontier(candidates: DataFrame, digits: int = 3, id_col: str = "portfolio_id") -> DataFrame:
    """Best candidate per rounded volatility, keeping only rising returns.

    The final window runs over rounded volatilities only: their number is bounded by the
    volatility range, not by the number of candidates.
    """
    bucket = F.round("vol", digits)
    best = candidates.groupBy(bucket.alias("vol_bucket")).agg(
        F.max_by(F.struct(id_col, "ret"), F.struct(F.col("ret"), -F.col(id_col))).alias("b")
    )
    rows = best.select("vol_bucket", f"b.{id_col}", "b.ret")
    top = F.max("ret").over(Window.orderBy("vol_bucket").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_top", top).where(F.col("ret") == F.col("_top")).drop("_top")


def holdings(portfolios: DataFrame, stats: DataFrame, risk_free: float = 0.04, run: str = "run_id") -> DataFrame:
    """Names of each run with a noticeable weight, with their own figures, ranked.

    Adds each holding's contribution to the run's volatility and its correlation to it.
    """
    market = Market(stats)
    base = portfolios.select(run, "w").withColumns({"_n": market.names, "_mu": market.mu, "_cov": market.cov})
    base = base.withColumn("_s", F.transform("_cov", lambda row: dot(row, F.col("w"))))
    base = base.withColumn("_vol", F.sqrt(dot(F.col("w"), F.col("_s"))))
    rows = base.select(
        run,
        "_vol",
        F.inline(
            F.transform(
                F.sequence(F.lit(0), F.size("w") - 1),
                lambda i: F.struct(
                    F.get("_n", i).alias("ticker"),
                    F.get("w", i).alias("weight"),
                    F.get("_mu", i).alias("expected_return"),
                    F.sqrt(F.get(F.get("_cov", i), i)).alias("volatility"),
                    F.get("_s", i).alias("_si"),
                ),
            )
        ),
    ).where(F.col("weight") > MIN_HOLDING)
    v = F.col("volatility")
    w = Window.partitionBy(run).orderBy(F.col("weight").desc(), "ticker")
    return rows.select(
        run,
        "ticker",
        "weight",
        "expected_return",
        "volatility",
        F.when(v > 0, (F.col("expected_return") - F.lit(risk_free)) / v).otherwise(F.lit(0.0)).alias("sharpe_ratio"),
        F.try_divide(F.col("_si"), v * F.col("_vol")).alias("correlation_to_portfolio"),
        F.try_divide(F.col("weight") * F.col("_si"), F.col("_vol")).alias("marginal_contribution_to_risk"),
        F.row_number().over(w).alias("rank"),
    )


def completed_runs(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status") == "completed").orderBy(F.col("run_date").desc(), "run_id")
