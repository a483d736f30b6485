"""T-15/16 betas; K: ranking and portfolios; R: risk; E: predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.operators import beta, joins, portfolio as pf, predictions as pr, risk
from tickerloom.operators.indicators import price_momentum
from tickerloom.plans.domain_sql import register
from tickerloom.plans.q_fundamentals import quarter_ratios, stock_ratio_data, _cash_strict
from tickerloom.plans.registry import query
from tickerloom.plans.sql_text import clip

Q = "fiscal_quarter_end"

# ---- betas -----------------------------------------------------------------------------
_BP = "(PARTITION BY ticker, index_code ORDER BY date)"


def _beta_sql(source: str) -> str:
    def f(n):
        return f"(PARTITION BY ticker, index_code ORDER BY date ROWS {n - 1} PRECEDING)"

    def ok(n, extra=""):
        return f"count(x + y) OVER {f(n)} = {n} AND var_samp(y) OVER {f(n)} > 1e-20 {extra}"

    cols = ", ".join(
        f"CASE WHEN {ok(n)} THEN covar_samp(x, y) OVER {f(n)} / var_samp(y) OVER {f(n)} END AS beta_{n}d"
        for n in beta.BETA_WINDOWS)
    long = ok(252, f"AND var_samp(x) OVER {f(252)} > 1e-20")
    return f"""
SELECT *, correlation_252d * correlation_252d AS r_squared_252d
FROM (SELECT date, ticker, index_code, {cols},
             CASE WHEN {long} THEN covar_samp(x, y) OVER {f(252)}
               / sqrt(var_samp(x) OVER {f(252)} * var_samp(y) OVER {f(252)}) END AS correlation_252d
      FROM (SELECT *, close_Price / nullif(lag(close_Price) OVER {_BP}, 0) - 1 AS x,
                   index_close / nullif(lag(index_close) OVER {_BP}, 0) - 1 AS y FROM {source}))"""


register("own_pairs", """
SELECT b.date, b.ticker, x.index_code, b.close_Price, m.close_Price AS index_close
FROM bars b JOIN index_membership x ON b.ticker = x.ticker
JOIN benchmarks m ON m.index_code = x.index_code AND m.date = b.date""")
register("all_pairs", """
SELECT b.date, b.ticker, m.index_code, b.close_Price, m.close_Price AS index_close
FROM bars b JOIN benchmarks m ON m.date = b.date""")
register("own_betas", _beta_sql("own_pairs"))
_ANY = " OR ".join(f"{b} IS NOT NULL" for b in beta.BETAS)
register("beta_table", f"SELECT * FROM ({_beta_sql('all_pairs')}) WHERE {_ANY}")
_B = " ".join(beta.BETAS)


@query("T15_rolling_beta", "SELECT * FROM own_betas", _B)
def _(d):
    return beta.own_beta(d.bars, d.index_membership, d.benchmarks)


@query("T16_beta_table", "SELECT * FROM beta_table", _B)
def _(d):
    return beta.beta_table(d.bars, d.benchmarks)


@query("J07_latest_beta", """
SELECT *, CASE WHEN beta_252d IS NULL THEN NULL WHEN beta_252d > 1.5e0 THEN 'high'
  WHEN beta_252d > 1 THEN 'above_market' WHEN beta_252d > 0.5e0 THEN 'defensive'
  WHEN beta_252d > 0 THEN 'very_defensive' ELSE 'negative' END AS label
FROM beta_table QUALIFY row_number() OVER (PARTITION BY ticker, index_code ORDER BY date DESC) = 1""", _B)
def _(d):
    return beta.latest_betas(beta.beta_table(d.bars, d.benchmarks))


# ---- scores ----------------------------------------------------------------------------
register("fund_inputs", f"""
SELECT b.ticker, b.close_Price AS price, r.p_e AS pe, r.p_b AS pb, r.p_s AS ps,
       q.revenue_growth_yoy AS rev_g, q.net_income_growth_yoy AS eps_g, q.roe_ttm AS roe,
       q.operating_margin_ttm AS op_margin, q.debt_to_equity AS de, q.shares_diluted AS shares,
       c.dividends_paid_ttm AS div_ttm, m.m3, m.m6
FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1) b
LEFT JOIN (SELECT * FROM stock_ratio_data QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1) r ON b.ticker = r.ticker
LEFT JOIN (SELECT * FROM quarter_ratios QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY {Q} DESC) = 1) q ON b.ticker = q.ticker
LEFT JOIN (SELECT * FROM cash_strict QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY {Q} DESC) = 1) c ON b.ticker = c.ticker
LEFT JOIN price_momentum m ON b.ticker = m.ticker
""")


def _mean(parts) -> str:
    total = " + ".join(f"coalesce({p}, 0)" for p in parts)
    n = " + ".join(f"CASE WHEN ({p}) IS NOT NULL THEN 1 ELSE 0 END" for p in parts)
    return f"CASE WHEN ({n}) > 0 THEN greatest(-1e0, least(1e0, ({total}) / ({n}))) ELSE 0e0 END"


def _pos(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN {x} END)"


_YIELD = "(CASE WHEN price > 0 THEN abs(div_ttm) / nullif(shares, 0) / price END)"
_SCORES = {
    "balanced": "0e0",
    "dividend": _mean([f"CASE WHEN {_YIELD} > 0 THEN least({_YIELD} / 0.05e0, 1e0) END",
                       "CASE WHEN pe > 0 THEN greatest(1 - pe / 3e1, -0.5e0) END"]),
    "growth": _mean([clip("rev_g / 0.25e0", "-1e0", "1e0"), clip("eps_g / 0.3e0", "-1e0", "1e0")]),
    "value": _mean([clip(f"1 - {_pos('pe')} / 25e0", "-1e0", "1e0"), clip(f"1 - {_pos('pb')} / 3e0", "-1e0", "1e0"),
                    clip(f"1 - {_pos('ps')} / 4e0", "-1e0", "1e0")]),
    "garp": _mean([clip(f"1 - {_pos('pe')} / (1e2 * {_pos('eps_g')}) / 2e0", "-1e0", "1e0"),
                   clip("rev_g / 0.2e0", "-0.5e0", "0.5e0")]),
    "quality": _mean([clip("roe / 0.2e0", "-1e0", "1e0"), clip("op_margin / 0.2e0", "-0.5e0", "0.5e0"),
                      clip("1 - de / 2e0", "-1e0", "1e0")]),
    "momentum": _mean([clip("m3 / 0.15e0", "-1e0", "1e0"), clip("m6 / 0.3e0", "-1e0", "1e0")]),
}
register("fund_scores", "SELECT ticker, " + ", ".join(f"{v} AS {k}" for k, v in _SCORES.items()) + " FROM fund_inputs")


def fund_inputs(d):
    last = joins.keep_latest(d.bars.select("ticker", "date", "close_Price"), ["ticker"], [F.col("date")])
    r = joins.keep_latest(stock_ratio_data(d), ["ticker"], [F.col("date")])
    q = joins.keep_latest(quarter_ratios(d), ["ticker"], [F.col(Q)])
    c = joins.keep_latest(_cash_strict(d), ["ticker"], [F.col(Q)])
    return (
        last.select("ticker", F.col("close_Price").alias("price"))
        .join(r.select("ticker", F.col("p_e").alias("pe"), F.col("p_b").alias("pb"), F.col("p_s").alias("ps")), "ticker", "left")
        .join(q.select("ticker", F.col("revenue_growth_yoy").alias("rev_g"),
                       F.col("net_income_growth_yoy").alias("eps_g"), F.col("roe_ttm").alias("roe"),
                       F.col("operating_margin_ttm").alias("op_margin"), F.col("debt_to_equity").alias("de"),
                       F.col("shares_diluted").alias("shares")), "ticker", "left")
        .join(c.select("ticker", F.col("dividends_paid_ttm").alias("div_ttm")), "ticker", "left")
        .join(price_momentum(d.bars), "ticker", "left")
    )


def fund_scores(d):
    return pf.fundamental_scores(fund_inputs(d))


query("K01_fundamental_scores", "SELECT * FROM fund_scores", " ".join(pf.STRATEGIES))(fund_scores)

register("latest_best", """
SELECT * FROM (SELECT * FROM predictions
  QUALIFY row_number() OVER (PARTITION BY ticker, prediction_date
          ORDER BY CASE WHEN prediction_horizon_days = 252 THEN 100000 ELSE prediction_horizon_days END DESC) = 1)
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY prediction_date DESC) = 1
""")
register("risk_scores", """
SELECT ticker, predicted_return + 2e0 * least(coalesce(nullif(dn, 0), -0.5e0), 0e0) AS low,
       predicted_return + 0.5e0 * least(coalesce(nullif(dn, 0), -0.3e0), 0e0) AS medium,
       predicted_return + 0.2e0 * greatest(coalesce(nullif(up, 0), 0e0), 0e0) AS high, predicted_return
FROM (SELECT *, CASE WHEN current_price > 0 THEN (confidence_lower_5 - current_price) / current_price END AS dn,
             CASE WHEN current_price > 0 THEN (confidence_upper_95 - current_price) / current_price END AS up
      FROM latest_best)
""")


def latest_best(d):
    return joins.keep_latest(pf.best_horizon(d.predictions), ["ticker"], [F.col("prediction_date")])


@query("K02_risk_scores", "SELECT * FROM risk_scores", "low medium high predicted_return")
def _(d):
    s = pf.risk_scores()
    return latest_best(d).select("ticker", *[s[k].alias(k) for k in ("low", "medium", "high")], "predicted_return")


@query("K03_ranked_top", """
SELECT ticker, predicted_return, value AS fund_score, 0.7e0 * medium + 0.3e0 * value AS score,
       row_number() OVER (ORDER BY 0.7e0 * medium + 0.3e0 * value DESC, ticker) AS rank
FROM risk_scores JOIN fund_scores USING (ticker)
QUALIFY row_number() OVER (ORDER BY 0.7e0 * medium + 0.3e0 * value DESC, ticker) <= 25""",
       "predicted_return fund_score score")
def _(d):
    return pf.ranked_top(pf.scored(latest_best(d), fund_scores(d), "medium", "value"), 25)


@query("K04_eligible", """
SELECT DISTINCT ticker FROM predictions WHERE (SELECT as_of FROM as_of) - prediction_date <= 7
AND ticker NOT IN (SELECT ticker FROM blacklist WHERE active) AND ticker NOT IN ('S00001')""")
def _(d):
    return pf.eligible(d.predictions, d.blacklist.where("active"), d.last_bar_date, 7, ["S00001"])


# ---- moments and candidates ------------------------------------------------------------
# Weekly closes: every nation trades in nearly every week, so that all of them share dates.
register("weekly_nation", """
SELECT CAST(date_trunc('week', date) AS DATE) AS date, ticker, arg_max(close_Price, bars_nation.date) AS close_Price
FROM bars_nation GROUP BY 1, 2""")
register("names", "SELECT DISTINCT ticker FROM weekly_nation")
register("common", """
WITH u AS (SELECT b.date, b.ticker, close_Price FROM weekly_nation b JOIN names USING (ticker)),
k AS (SELECT ticker FROM u GROUP BY 1 HAVING count(*) >= 100),
c AS (SELECT u.* FROM u JOIN k USING (ticker))
SELECT * FROM c WHERE date IN (SELECT date FROM c GROUP BY date HAVING count(*) = (SELECT count(*) FROM k))""")
register("name_returns", """
SELECT date, ticker, ln(close_Price / prev) AS r
FROM (SELECT *, lag(close_Price) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM common) WHERE prev IS NOT NULL""")
register("sigma", """
SELECT a.ticker, b.ticker AS other, covar_samp(a.r, b.r) * 252 AS covariance
FROM name_returns a JOIN name_returns b USING (date) GROUP BY 1, 2""")
register("mu", "SELECT ticker, avg(r) * 252 AS mu FROM name_returns GROUP BY 1")
register("weights", """
WITH k AS (SELECT ticker, row_number() OVER (ORDER BY ticker) - 1 AS pos FROM mu),
u AS (SELECT c_custkey AS portfolio_id, ticker, pos,
             (CAST('0x' || substr(md5(c_custkey || ':' || pos), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0 AS u FROM customer, k)
SELECT portfolio_id, ticker, pos, u / sum(u) OVER (PARTITION BY portfolio_id) AS w FROM u""")
register("candidates", """
WITH r AS (SELECT portfolio_id, sum(w * mu) AS ret, max(w) AS wmax FROM weights JOIN mu USING (ticker) GROUP BY 1),
v AS (SELECT a.portfolio_id, sqrt(sum(a.w * b.w * covariance)) AS vol
      FROM weights a JOIN weights b USING (portfolio_id) JOIN sigma s ON s.ticker = a.ticker AND s.other = b.ticker GROUP BY 1)
SELECT portfolio_id, ret, vol, (ret - 0.04e0) / vol AS sharpe, wmax FROM r JOIN v USING (portfolio_id)""")


def weekly(d):
    week = F.trunc("date", "week").alias("date")
    bars = d.bars_nation.select(week, "ticker", "close_Price", F.col("date").alias("day"))
    return bars.groupBy("date", "ticker").agg(F.max_by("close_Price", "day").alias("close_Price"))


def moments(d):
    """Moments of all nation tickers, derived once per session and folder."""
    prices = weekly(d)
    return d.stored("moments", lambda: pf.covariance(pf.return_matrix(prices, prices.select("ticker").distinct(), 100)))


def candidates(d):
    ids = d.raw("customer").select(F.col("c_custkey").alias("portfolio_id"))
    stats = moments(d)
    return pf.performance(pf.random_weights(ids, stats), stats)


@query("K05_covariance", "SELECT * FROM sigma", "covariance")
def _(d):
    return pf.covariance_long(moments(d))


@query("K05_mean_returns", "SELECT * FROM mu", "mu")
def _(d):
    return moments(d).select("ticker", "mu")


@query("A06_covariance_daily", "SELECT a.ticker, b.ticker AS other, covar_samp(a.r, b.r) * 252 AS covariance FROM name_returns a JOIN name_returns b USING (date) WHERE a.ticker <= b.ticker GROUP BY 1, 2", "covariance")
def _(d):
    return pf.covariance_long(moments(d)).where("ticker <= other")


@query("K06_portfolio_performance", "SELECT portfolio_id, ret, vol, sharpe FROM candidates", "ret vol sharpe")
def _(d):
    return candidates(d).select("portfolio_id", "ret", "vol", "sharpe")


@query("K07_random_weights", "SELECT portfolio_id, pos, w AS weight FROM weights WHERE (SELECT count(*) FROM mu) > 0", "weight")
def _(d):
    ids = d.raw("customer").select(F.col("c_custkey").alias("portfolio_id"))
    w = pf.random_weights(ids, moments(d))
    return w.select("portfolio_id", F.posexplode("w").alias("pos", "weight"))


_BEST = """
SELECT 'min_volatility' AS objective, * FROM (SELECT * FROM ok ORDER BY vol, portfolio_id LIMIT 1)
UNION ALL SELECT 'max_sharpe', * FROM (SELECT * FROM ok ORDER BY sharpe DESC, portfolio_id LIMIT 1)
UNION ALL SELECT 'max_return', * FROM (SELECT * FROM ok ORDER BY ret DESC, portfolio_id LIMIT 1)"""


@query("K08_best_candidates", f"""
WITH ok AS (SELECT portfolio_id, ret, vol, sharpe FROM candidates WHERE vol <= 0.4e0
            AND wmax <= greatest(least(0.25e0, 1e0 / greatest((SELECT count(*) FROM mu) * 0.5e0, 1e0)), 0.05e0))
{_BEST}""", "ret vol sharpe")
def _(d):
    c = candidates(d)
    return pf.best_candidates(c, 0.40, 0.0, pf.weight_cap(F.size("w"))).drop("w")


@query("K09_discrete_frontier", """
WITH b AS (SELECT round(vol, 3) AS vol_bucket, arg_max(portfolio_id, ret) AS portfolio_id, max(ret) AS ret FROM candidates GROUP BY 1)
SELECT * FROM (SELECT *, max(ret) OVER (ORDER BY vol_bucket ROWS UNBOUNDED PRECEDING) AS m FROM b) WHERE ret = m""".replace("SELECT * FROM (SELECT *, max", "SELECT vol_bucket, portfolio_id, ret FROM (SELECT *, max"), "vol_bucket ret")
def _(d):
    return pf.discrete_frontier(candidates(d))


_HOLD = ("weight expected_return volatility sharpe_ratio correlation_to_portfolio marginal_contribution_to_risk")
register("run_holdings", """
WITH s AS (SELECT a.portfolio_id AS run_id, a.ticker, a.w, sum(b.w * covariance) AS si, any_value(mu) AS mu
           FROM weights a JOIN weights b USING (portfolio_id)
           JOIN sigma x ON x.ticker = a.ticker AND x.other = b.ticker JOIN mu m ON m.ticker = a.ticker GROUP BY 1, 2, 3),
t AS (SELECT s.*, sqrt(sum(w * si) OVER (PARTITION BY run_id)) AS vol, sqrt(v.covariance) AS sd
      FROM s JOIN sigma v ON v.ticker = s.ticker AND v.other = s.ticker)
SELECT run_id, ticker, w AS weight, mu AS expected_return, sd AS volatility, (mu - 0.04e0) / sd AS sharpe_ratio,
       si / (sd * vol) AS correlation_to_portfolio, w * si / vol AS marginal_contribution_to_risk,
       row_number() OVER (PARTITION BY run_id ORDER BY w DESC, ticker) AS rank
FROM t WHERE w > 0.001e0""")


def run_holdings(d):
    stats = moments(d)
    ids = d.raw("customer").select(F.col("c_custkey").alias("run_id"))
    return pf.holdings(pf.random_weights(ids, stats, "run_id"), stats)


@query("K10_holdings", "SELECT run_id, ticker, weight, expected_return, volatility, sharpe_ratio, rank FROM run_holdings",
       "weight expected_return volatility sharpe_ratio")
def _(d):
    return run_holdings(d).drop("correlation_to_portfolio", "marginal_contribution_to_risk")


@query("K11_risk_contribution", "SELECT run_id, ticker, correlation_to_portfolio, marginal_contribution_to_risk FROM run_holdings",
       "correlation_to_portfolio marginal_contribution_to_risk")
def _(d):
    return run_holdings(d).select("run_id", "ticker", "correlation_to_portfolio", "marginal_contribution_to_risk")


@query("K12_run_registry", "SELECT o_orderkey AS run_id, o_orderdate AS run_date, 'completed' AS status, o_totalprice AS value FROM orders WHERE o_orderstatus = 'F' ORDER BY 2 DESC, 1", "value")
def _(d):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    runs = d.raw("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("run_date"),
                                  status.alias("status"), F.col("o_totalprice").alias("value"))
    return pf.completed_runs(runs)


# ---- risk ------------------------------------------------------------------------------
register("stock_returns", """
SELECT date, ticker, ln(close_Price / prev) AS r
FROM (SELECT *, lag(close_Price) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM bars) WHERE prev > 0""")
register("gbm", """
WITH c AS (SELECT ticker, r, r - avg(r) OVER (PARTITION BY ticker) AS x FROM stock_returns),
m AS (SELECT ticker, count(*) AS n, avg(r) AS mean_r, median(r) AS median_r, stddev_samp(r) AS std_r,
             avg(x * x) AS m2, avg(x * x * x) AS m3, avg(x * x * x * x) AS m4 FROM c GROUP BY 1),
j AS (SELECT *, CASE WHEN m2 > 0 THEN n / 6e0 * ((m3 / pow(m2, 1.5e0)) ^ 2 + (m4 / (m2 * m2) - 3) ^ 2 / 4) END AS jarque_bera FROM m),
z AS (SELECT *, coalesce(jarque_bera <= 5.991e0, true) AS is_normal FROM j)
SELECT z.ticker, n, mean_r, median_r, std_r, jarque_bera, is_normal,
       252 * CASE WHEN is_normal THEN mean_r ELSE median_r END AS mu, sqrt(252e0) * std_r AS sigma, close_Price AS starting_price
FROM z JOIN (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1) b ON b.ticker = z.ticker""")


def gbm(d):
    return risk.gbm_parameters(d.bars)


query("R01_gbm_parameters", "SELECT * FROM gbm", "mean_r median_r std_r jarque_bera mu sigma starting_price")(gbm)
query("R02_normality_gate", "SELECT ticker, jarque_bera, is_normal FROM gbm", "jarque_bera")(
    lambda d: gbm(d).select("ticker", "jarque_bera", "is_normal"))


def _band_sql(start: str, mu: str, sigma: str) -> str:
    q = ", ".join(
        f"{start} * exp(({mu} - {sigma} * {sigma} / 2) * t + {sigma} * sqrt(t) * ({z}e0)) AS {n}" for n, z in risk.Z.items())
    return f"{q}, {start} * exp({mu} * t) AS mean_price"


register("bands", f"""
SELECT ticker, t AS simulation_year, starting_price, {_band_sql('starting_price', 'mu', 'sigma')}
FROM gbm, (SELECT unnest(range(0, 11)) AS t)""")
_BANDS = "percentile_5 percentile_16 percentile_84 percentile_95 mean_price"
query("R03_yearly_bands", "SELECT * FROM bands", f"starting_price {_BANDS}")(lambda d: risk.yearly_bands(gbm(d)))


def _cagr(x: str) -> str:
    return f"CASE WHEN simulation_year > 0 THEN pow({x} / starting_price, 1e0 / simulation_year) - 1 END"


query("R04_band_returns", f"""
SELECT ticker, simulation_year, {_cagr('percentile_5')} AS return_percentile_5, {_cagr('mean_price')} AS return_mean,
       {_cagr('percentile_95')} AS return_percentile_95 FROM bands""",
      "return_percentile_5 return_mean return_percentile_95")(
    lambda d: risk.band_returns(risk.yearly_bands(gbm(d))))


@query("R05_portfolio_bands", f"""
SELECT run_id, simulation_year, {_band_sql('1e0', '(ret + vol * vol / 2)', 'vol').replace(' t', ' simulation_year').replace('(t)', '(simulation_year)')}
FROM (SELECT portfolio_id AS run_id, ret, vol FROM candidates), (SELECT unnest(range(0, 6)) AS simulation_year)""", _BANDS)
def _(d):
    stats = moments(d)
    ids = d.raw("customer").select(F.col("c_custkey").alias("run_id"))
    return risk.portfolio_bands(pf.random_weights(ids, stats, "run_id"), stats)


def _paths(d):
    from pyspark.sql import Window

    day = F.row_number().over(Window.partitionBy("ticker").orderBy("date"))
    return d.bars.select(F.col("ticker").alias("path_id"), day.alias("day"), F.col("close_Price").alias("value"))


@query("R06_path_summary", """
SELECT (rn - 1) // 252 AS year, quantile_cont(close_Price, 0.05e0) AS percentile_5, quantile_cont(close_Price, 0.16e0) AS percentile_16,
       quantile_cont(close_Price, 0.84e0) AS percentile_84, quantile_cont(close_Price, 0.95e0) AS percentile_95, avg(close_Price) AS mean_price
FROM numbered GROUP BY 1""", _BANDS)
def _(d):
    return risk.path_summary(_paths(d))


@query("R07_final_returns", """
SELECT avg(r) AS return_mean, quantile_cont(r, 0.05e0) AS return_percentile_5, quantile_cont(r, 0.95e0) AS return_percentile_95
FROM (SELECT arg_max(close_Price, date) / arg_min(close_Price, date) - 1 AS r FROM bars GROUP BY ticker)""",
       "return_mean return_percentile_5 return_percentile_95")
def _(d):
    return risk.final_returns(_paths(d))


@query("R08_historical_tail", """
SELECT ticker, any_value(v) AS var_95, avg(r) AS cvar_95, count(*) AS tail_days
FROM stock_returns JOIN (SELECT ticker, quantile_cont(r, 0.05e0) AS v FROM stock_returns GROUP BY 1) USING (ticker)
WHERE r <= v GROUP BY 1""", "var_95 cvar_95")
def _(d):
    return risk.historical_tail(d.bars)


@query("R09_latest_run", "SELECT prediction_date AS simulation_date, ticker, prediction_horizon_days, predicted_price FROM predictions QUALIFY rank() OVER (PARTITION BY ticker ORDER BY prediction_date DESC) = 1", "predicted_price")
def _(d):
    return risk.latest_runs(d.predictions.select(
        F.col("prediction_date").alias("simulation_date"), "ticker", "prediction_horizon_days", "predicted_price"))


# ---- predictions -----------------------------------------------------------------------
register("starts", "SELECT ticker, min(date) AS prediction_date, arg_min(close_Price, date) AS current_price FROM bars WHERE date >= DATE '2000-01-01' GROUP BY 1")


@query("E01_horizon_records", """
SELECT prediction_date, ticker, h AS prediction_horizon_days, prediction_date + CAST(floor(h * 365 / 252) AS INTEGER) AS target_date,
       close_Price AS predicted_price, current_price, (close_Price - current_price) / current_price AS predicted_return
FROM (SELECT b.ticker, close_Price, s.*EXCLUDE (ticker), row_number() OVER (PARTITION BY b.ticker ORDER BY date) AS h
      FROM bars b JOIN starts s ON b.ticker = s.ticker WHERE b.date > s.prediction_date) WHERE h IN (30, 60, 90, 252)""",
       "predicted_price current_price predicted_return")
def _(d):
    current = d.bars.where("date >= DATE '2000-01-01'").groupBy("ticker").agg(
        F.min("date").alias("prediction_date"), F.min_by("close_Price", "date").alias("current_price"))
    return pr.horizon_records(current, d.bars)


_ACC = ["price_error_pct", "actual_return", "abs_error_pct", "return_error"]
register("accuracy", """
SELECT p.ticker, p.target_date, prediction_date, prediction_horizon_days, predicted_return, close_Price AS actual_price,
       (predicted_price - close_Price) * 1e2 / close_Price AS price_error_pct, (close_Price - current_price) / current_price AS actual_return,
       abs((predicted_price - close_Price) * 1e2 / close_Price) AS abs_error_pct,
       predicted_return - (close_Price - current_price) / current_price AS return_error,
       CAST((predicted_return > 0) = (close_Price > current_price) AS INTEGER) AS direction_correct,
       CAST(close_Price BETWEEN confidence_lower_5 AND confidence_upper_95 AS INTEGER) AS in_confidence
FROM predictions p JOIN bars b ON b.ticker = p.ticker AND b.date = p.target_date""")


def acc(d):
    return pr.accuracy(d.predictions, d.bars)


@query("E02_accuracy", "SELECT * FROM accuracy", "predicted_return actual_price " + " ".join(_ACC))
def _(d):
    return acc(d).select("ticker", "target_date", "prediction_date", "prediction_horizon_days", "predicted_return",
                         "actual_price", *_ACC, "direction_correct", "in_confidence")


_HM = ("mean_error_pct mae_pct direction_accuracy confidence_coverage mean_predicted_return mean_actual_return")


@query("E03_horizon_metrics", """
SELECT prediction_horizon_days, count(*) AS n_predictions, count(DISTINCT ticker) AS n_tickers, avg(price_error_pct) AS mean_error_pct,
       median(price_error_pct) AS median_error_pct, avg(abs_error_pct) AS mae_pct, sqrt(avg(abs_error_pct * abs_error_pct)) AS rmse_pct,
       avg(direction_correct) AS direction_accuracy, avg(in_confidence) AS confidence_coverage, avg(predicted_return) AS mean_predicted_return,
       avg(actual_return) AS mean_actual_return, stddev_samp(actual_return) AS std_actual_return FROM accuracy GROUP BY 1""",
       f"{_HM} median_error_pct rmse_pct std_actual_return")
def _(d):
    return pr.horizon_metrics(acc(d))


query("A05_group_statistics", """
SELECT prediction_horizon_days, avg(actual_return) AS mean, median(actual_return) AS median, stddev_samp(actual_return) AS std,
       count(DISTINCT ticker) AS tickers, count(*) AS n FROM accuracy GROUP BY 1""", "mean median std")(
    lambda d: acc(d).groupBy("prediction_horizon_days").agg(
        F.avg("actual_return").alias("mean"), F.stddev_samp("actual_return").alias("std"),
        F.countDistinct("ticker").alias("tickers"), F.count("*").alias("n")).join(
        pr.exact_percentiles(acc(d), ["prediction_horizon_days"], "actual_return", {"median": 0.5}), "prediction_horizon_days"))

register("ticker_metrics", """
SELECT ticker, prediction_horizon_days, count(*) AS n_predictions, avg(price_error_pct) AS mean_error_pct, avg(abs_error_pct) AS mae_pct,
       avg(direction_correct) AS direction_accuracy, avg(in_confidence) AS confidence_coverage,
       avg(predicted_return) AS mean_predicted_return, avg(actual_return) AS mean_actual_return FROM accuracy GROUP BY 1, 2""")
query("E04_ticker_metrics", "SELECT * FROM ticker_metrics", _HM)(lambda d: pr.ticker_metrics(acc(d)))


@query("L04_best_and_worst", " UNION ALL ".join(
    f"SELECT '{n}' AS list, * FROM (SELECT ticker, prediction_horizon_days, mae_pct, direction_accuracy FROM ticker_metrics ORDER BY {o}, ticker, prediction_horizon_days LIMIT 10)"
    for n, o in (("lowest_error", "mae_pct"), ("highest_error", "mae_pct DESC"), ("best_direction", "direction_accuracy DESC"))),
       "mae_pct direction_accuracy")
def _(d):
    return pr.best_and_worst(pr.ticker_metrics(acc(d)))


@query("E05_bias_findings", """
WITH p AS (SELECT predicted_price * 1.05e0 AS pp, p.*, close_Price AS ap FROM predictions p
           JOIN bars b ON b.ticker = p.ticker AND b.date = p.target_date),
a AS (SELECT avg((pp - ap) * 1e2 / ap) AS err, avg(CAST(ap BETWEEN confidence_lower_5 AND confidence_upper_95 AS INTEGER)) AS cov,
             avg(predicted_return) - avg((ap - current_price) / current_price) AS gap FROM p)
SELECT 'upward_bias' AS finding, err AS value FROM a WHERE err > 2 UNION ALL SELECT 'downward_bias', err FROM a WHERE err < -2
UNION ALL SELECT 'intervals_too_narrow', cov FROM a WHERE cov < 0.8e0 UNION ALL SELECT 'intervals_too_wide', cov FROM a WHERE cov > 0.98e0
UNION ALL SELECT 'return_level_mismatch', gap FROM a WHERE abs(gap) > 0.05e0""", "value")
def _(d):
    high = d.predictions.withColumn("predicted_price", F.col("predicted_price") * F.lit(1.05))
    return pr.bias_findings(pr.accuracy(high, d.bars))


@query("E06_prediction_summary", """
SELECT ticker, max(prediction_date) AS prediction_date, arg_max(current_price, prediction_date) AS current_price, count(*) AS n_horizons,
       min(predicted_return) AS min_return, max(predicted_return) AS max_return, max(prediction_horizon_days) AS longest_horizon,
       arg_max(predicted_return, prediction_horizon_days * 100000 + datediff('day', DATE '1990-01-01', prediction_date)) AS longest_return
FROM predictions WHERE (SELECT as_of FROM as_of) - prediction_date <= 60 GROUP BY 1""",
       "current_price min_return max_return longest_return")
def _(d):
    return pr.prediction_summary(d.predictions, d.last_bar_date, 60)


@query("E07_predicted_profit", """
SELECT ticker, (arg_max(close_Price, date) / arg_min(close_Price, date) - 1) * 1e2 AS profit_pct
FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 60) GROUP BY 1""", "profit_pct")
def _(d):
    return pr.predicted_profit(d.bars, 60)


_HC = "mae std_error max_error direction_pct mean_price_error price_error_pct"


@query("E08_historical_comparison", """
WITH c AS (SELECT ticker, date, open_Price AS p, close_Price AS a, open_Price / nullif(lag(open_Price) OVER w, 0) - 1 AS pc,
                  close_Price / nullif(lag(close_Price) OVER w, 0) - 1 AS ac FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date))
SELECT ticker, count(*) AS n, avg(abs(pc - ac)) AS mae, stddev_pop(pc - ac) AS std_error, max(abs(pc - ac)) AS max_error,
       avg(CAST(sign(pc) = sign(ac) AS INTEGER)) * 1e2 AS direction_pct, avg(abs(p - a)) AS mean_price_error,
       avg(abs((p - a) / a)) * 1e2 AS price_error_pct FROM c GROUP BY 1""", _HC)
def _(d):
    return pr.historical_comparison(d.bars.select("ticker", "date", F.col("open_Price").alias("close_Price")), d.bars)


register("model_status", """
SELECT ticker, model_type, tuning_date, (SELECT as_of FROM as_of) - tuning_date AS age_days,
       (SELECT as_of FROM as_of) - tuning_date <= 30 AS is_fresh FROM model_registry WHERE is_valid""")


def _stocks(d):
    return d.stock_info.where("industry <> 'Index'")


@query("E09_model_status", "SELECT * FROM model_status")
def _(d):
    return pr.model_status(d.model_registry, d.last_bar_date)


@query("E09_training_needs", """
SELECT s.ticker, CASE WHEN m.ticker IS NULL THEN 'untrained' WHEN ok THEN 'fresh' ELSE 'stale' END AS status
FROM stock_info s LEFT JOIN (SELECT ticker, count(DISTINCT model_type) = 3 AND bool_and(is_fresh) AS ok FROM model_status GROUP BY 1) m
ON s.ticker = m.ticker WHERE industry <> 'Index'""")
def _(d):
    return pr.training_needs(_stocks(d), pr.model_status(d.model_registry, d.last_bar_date))


@query("E10_prediction_needs", """
SELECT ticker, CASE WHEN ticker IN (SELECT ticker FROM predictions WHERE (SELECT as_of FROM as_of) - prediction_date <= 5)
       THEN 'recent' ELSE 'needs_prediction' END AS status FROM stock_info WHERE industry <> 'Index'""")
def _(d):
    return pr.prediction_needs(_stocks(d), d.predictions, d.last_bar_date, 5)


@query("E11_usable_parameters", """
SELECT ticker, model_type, CAST(hyperparameters->>'max_depth' AS BIGINT) AS max_depth, CAST(hyperparameters->>'n_estimators' AS BIGINT) AS n_estimators
FROM model_registry WHERE is_valid AND (SELECT as_of FROM as_of) - tuning_date <= 30
AND feature_hash = sha256('p_e,rsi_14,sma_20,volatility_20d')""")
def _(d):
    features = F.array(*[F.lit(x) for x in ("sma_20", "rsi_14", "p_e", "volatility_20d")])
    return pr.usable_parameters(d.model_registry, features, d.last_bar_date)
