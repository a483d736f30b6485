"""Q: data quality, over the dirty bars and the derived tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickerloom.operators import indicators as ind
from tickerloom.operators import joins, quality as dq, tables
from tickerloom.operators.rule_pass import Rule, Source, findings, measure
from tickerloom.operators import statements as st
from tickerloom.plans import q_fundamentals as fu
from tickerloom.plans.domain_sql import register
from tickerloom.plans.registry import query
from tickerloom.session import dealt

Q, Y = st.QUARTER, st.YEAR
RATIOS = ("p_s", "p_e", "p_b", "p_fcf")
_W = "(PARTITION BY ticker ORDER BY date)"


def _issue(name: str, source: str, table: str, issue: str, severity: str, value: str, where: str = "true") -> str:
    return (f"SELECT ticker, {table} AS \"table\", '{issue}' AS issue, {severity} AS severity, "
            f"CAST({value} AS DOUBLE) AS value FROM {source} WHERE {where}")


def _rules(source: str, table: str, rules) -> str:
    return " UNION ALL ".join(
        _issue("", source, f"'{table}'", i, f"'{s}'", v, w) for i, s, v, w in rules)


SQL: dict[str, str] = {}
SQL["Q01_missing_info"] = _rules("stock_info", "stock_info_data", [
    ("missing_company_name", "LOW", "1", "company_Name IS NULL OR company_Name = ''"),
    ("missing_industry", "LOW", "1", "industry IS NULL OR industry = ''")])
_TABLES = {dq.PRICES: "bars_dirty", dq.INCOME: "income_metrics", dq.BALANCE: "balance_metrics", dq.CASH: "cash_metrics",
           dq.RATIO: "stock_ratio_data", dq.INCOME_Q: "income_tolerant", dq.BALANCE_Q: "balance_quarterly", dq.CASH_Q: "cashflow_quarterly"}
SQL["Q02_absent_tickers"] = " UNION ALL ".join(
    _issue("", "stock_info", f"'{n}'", "no_data", f"'{dq.PRESENCE_SEVERITY[n]}'", "1",
           f"industry <> 'Index' AND ticker NOT IN (SELECT ticker FROM {t})") for n, t in _TABLES.items())
register("price_stats", "SELECT ticker, count(*) AS n, max(date) AS last, min(close_Price) AS low, (SELECT as_of FROM as_of) - max(date) AS days FROM bars_dirty GROUP BY 1")
SQL["Q03_price_basics"] = _rules("price_stats", dq.PRICES, [
    ("stale_price", "HIGH", "days", "days > 7"), ("few_rows", "MEDIUM", "n", "n < 100"),
    ("close_not_positive", "CRITICAL", "low", "low <= 0")])
register("null_counts", "SELECT ticker, sum((close_Price IS NULL)::INT + (open_Price IS NULL)::INT + (high_Price IS NULL)::INT + (low_Price IS NULL)::INT) AS n FROM bars_dirty GROUP BY 1")
SQL["Q04_null_prices"] = _rules("null_counts", dq.PRICES, [("null_ohlc", "HIGH", "n", "n > 0")])
register("inverted", "SELECT ticker, count(*) AS n FROM bars_dirty WHERE high_Price < low_Price GROUP BY 1")
SQL["Q05_inverted_range"] = _rules("inverted", dq.PRICES, [("high_below_low", "CRITICAL", "n", "true")])
register("zero_share", "SELECT ticker, avg((trade_Volume IS NULL OR trade_Volume = 0)::INT) AS p FROM bars_dirty GROUP BY 1")
SQL["Q06_zero_volume"] = _rules("zero_share", dq.PRICES, [("zero_volume", "MEDIUM", "p * 100", "p > 0.2e0")])
register("shown_nulls", f"""
SELECT ticker, count(*) AS n, count(*) FILTER (sma IS NULL) AS s, count(*) FILTER (rn < 16) AS r
FROM (SELECT ticker, row_number() OVER {_W} AS rn, lag(full200) OVER {_W} AS sma
      FROM (SELECT *, CASE WHEN count(close_Price) OVER (PARTITION BY ticker ORDER BY date ROWS 199 PRECEDING) = 200 THEN 1 END AS full200 FROM bars_dirty))
GROUP BY 1""")
SQL["Q07_indicator_nulls"] = _rules("shown_nulls", dq.PRICES, [
    ("excess_null_sma_200", "MEDIUM", "s - least(200, n)", "s - least(200, n) > 10"),
    ("excess_null_rsi_14", "MEDIUM", "r - least(34, n)", "r - least(34, n) > 10")])
register("moves", f"SELECT *, lag(close_Price) OVER {_W} AS prev, lag(date) OVER {_W} AS prev_date FROM bars_dirty")
_P = "abs(close_Price - prev) / prev"
SQL["Q08_price_spikes"] = _rules("moves", dq.PRICES, [("price_spike", "CRITICAL", f"{_P} * 100", f"prev > 0 AND {_P} > 0.4e0")])
SQL["Q09_date_gaps"] = _rules("moves", dq.PRICES, [("date_gap", "MEDIUM", "date - prev_date", "date - prev_date > 10")])


def _null_stats(name, source, cols):
    register(name, f"SELECT ticker, count(*) AS n, {', '.join(f'count(*) FILTER ({c} IS NULL) AS {c}' for c in cols)} FROM {source} GROUP BY 1")


_null_stats("income_nulls", "income_metrics", ["revenue", "eps", "average_shares"])
_null_stats("balance_nulls", "balance_metrics", ["total_Assets", "book_Value_Per_Share"])
_null_stats("cash_nulls", "cash_metrics", ["free_Cash_Flow", "free_Cash_Flow_Per_Share"])
SQL["Q10_statement_nulls"] = " UNION ALL ".join([
    _rules("income_nulls", dq.INCOME, [("null_revenue", "HIGH", "revenue", "revenue > 0"), ("null_eps", "MEDIUM", "eps", "eps > 0"),
                                       ("null_average_shares", "MEDIUM", "average_shares", "average_shares > 0"), ("few_records", "LOW", "n", "n < 3")]),
    _rules("balance_nulls", dq.BALANCE, [("null_total_Assets", "HIGH", "total_Assets", "total_Assets > 0"),
                                         ("null_book_Value_Per_Share", "MEDIUM", "book_Value_Per_Share", "book_Value_Per_Share > 0")]),
    _rules("cash_nulls", dq.CASH, [("null_free_Cash_Flow", "MEDIUM", "free_Cash_Flow", "free_Cash_Flow > 0"),
                                   ("null_free_Cash_Flow_Per_Share", "MEDIUM", "free_Cash_Flow_Per_Share", "free_Cash_Flow_Per_Share > 0")])])
# the undropped ratio table, so that empty tickers show up
register("ratio_stats", "SELECT ticker, count(*) AS n, count(*) FILTER (financial_date_used IS NULL) AS nd, " + ", ".join(
    f"count(*) FILTER ({r} IS NULL) AS n_{r}, min({r}) AS lo_{r}, max({r}) AS hi_{r}" for r in RATIOS) + " FROM ratio_ttm GROUP BY 1")
_EVERY = " AND ".join(f"n_{r} = n" for r in RATIOS)
SQL["Q11_ratio_issues"] = _rules("ratio_stats", dq.RATIO, [("all_ratios_null", "CRITICAL", "n", _EVERY)] + [
    x for r in RATIOS for x in (
        (f"mostly_null_{r}", "HIGH", f"n_{r} * 1e2 / n", f"NOT ({_EVERY}) AND n_{r} * 1e2 / n > 50"),
        (f"extreme_high_{r}", "MEDIUM", f"hi_{r}", f"hi_{r} > 10000"), (f"extreme_low_{r}", "MEDIUM", f"lo_{r}", f"lo_{r} < -1000"))]
    + [("null_financial_date", "MEDIUM", "nd", "nd > 0")])
# a seventh of the tickers has only its first three quarters, another its revenues lost
_SHORT = f"SELECT * FROM {{}} QUALIFY CAST(substr(ticker, 2) AS BIGINT) % 7 <> 2 OR row_number() OVER (PARTITION BY ticker ORDER BY {Q}) <= 3"
register("short_income", "SELECT ticker, CASE WHEN CAST(substr(ticker, 2) AS BIGINT) % 7 <> 4 THEN revenue_ttm END AS revenue_ttm FROM ("
         + _SHORT.format("income_tolerant") + ")")
register("short_cash", _SHORT.format("cashflow_quarterly"))
register("ttm_nulls", "SELECT ticker, count(*) AS n, greatest(0, count(*) FILTER (revenue_ttm IS NULL) - least(3, count(*))) AS x FROM short_income GROUP BY 1")
register("cash_quarters", "SELECT ticker, count(*) AS n FROM short_cash GROUP BY 1")
SQL["Q12_quarterly_issues"] = _rules("ttm_nulls", dq.INCOME_Q, [("few_quarters", "MEDIUM", "n", "n < 4"), ("unexpected_null_revenue_ttm", "HIGH", "x", "x > 0")]) + \
    " UNION ALL " + _rules("cash_quarters", dq.CASH_Q, [("few_quarters", "MEDIUM", "n", "n < 4")])
# ratios that stop when a ticker is no longer followed
register("lagging_ratios", "SELECT * FROM stock_ratio_data WHERE ticker NOT IN (SELECT ticker FROM blacklist) OR date < (SELECT as_of FROM as_of) - 90")
register("lags", "SELECT r.ticker, p - r AS g FROM (SELECT ticker, max(date) AS r FROM lagging_ratios GROUP BY 1) r JOIN (SELECT ticker, max(date) AS p FROM bars_dirty GROUP BY 1) p USING (ticker)")
SQL["Q13_ratio_lag"] = _rules("lags", "cross-table", [("ratios_lag_prices", "HIGH", "g", "g > 30")])
register("periods", f"""
SELECT i.ticker, i.n AS i, coalesce(b.n, 0) AS b, coalesce(c.n, 0) AS c FROM (SELECT ticker, count(DISTINCT {Q}) AS n FROM income_quarterly GROUP BY 1) i
LEFT JOIN (SELECT ticker, count(DISTINCT {Q}) AS n FROM balance_quarterly GROUP BY 1) b ON i.ticker = b.ticker
LEFT JOIN (SELECT ticker, count(DISTINCT {Q}) AS n FROM cashflow_quarterly GROUP BY 1) c ON i.ticker = c.ticker""")
SQL["Q14_period_mismatch"] = _rules("periods", "cross-table", [("period_mismatch", "MEDIUM", "i", "i <> b OR b <> c")])


def _lagging(d):
    r = fu.stock_ratio_data(d)
    cut = F.date_sub(d.last_bar_date, 90)
    listed = tables.split_by_membership(r, d.blacklist, "ticker", "_b")
    return listed.where(~F.col("_b") | (F.col("date") < cut)).drop("_b")


def _absent(d):
    named = {dq.PRICES: d.bars_dirty, dq.INCOME: d.income_annual, dq.BALANCE: d.balance_annual, dq.CASH: d.cash_flow_annual,
             dq.RATIO: fu.stock_ratio_data(d), dq.INCOME_Q: d.income_quarterly, dq.BALANCE_Q: d.balance_quarterly, dq.CASH_Q: d.cashflow_quarterly}
    return dq.absent_tickers(d.stock_info.where("industry <> 'Index'"), named)


def _number():
    return F.substring("ticker", 2, 12).cast("bigint")


def _short(rows):
    w = Window.partitionBy("ticker").orderBy(Q)
    return rows.withColumn("_r", F.row_number().over(w)).where((_number() % 7 != 2) | (F.col("_r") <= 3)).drop("_r")


def _lost(rows):
    return rows.withColumn("revenue_ttm", F.when(_number() % 7 != 4, F.col("revenue_ttm")))


CHECKS = {
    "Q01_missing_info": lambda d: dq.missing_info(d.stock_info),
    "Q02_absent_tickers": _absent,
    "Q03_price_basics": lambda d: dq.price_basics(d.bars_dirty, d.last_bar_date),
    "Q04_null_prices": lambda d: dq.null_prices(d.bars_dirty),
    "Q05_inverted_range": lambda d: dq.inverted_range(d.bars_dirty),
    "Q06_zero_volume": lambda d: dq.zero_volume(d.bars_dirty),
    "Q07_indicator_nulls": lambda d: dq.indicator_nulls(ind.indicators(d.bars_dirty, ["sma", "rsi"])),
    "Q08_price_spikes": lambda d: dq.price_spikes(d.bars_dirty),
    "Q09_date_gaps": lambda d: dq.date_gaps(d.bars_dirty),
    "Q10_statement_nulls": lambda d: dq.statement_nulls(fu.income_metrics(d), fu.balance_metrics(d), fu.cash_metrics(d)),
    "Q11_ratio_issues": lambda d: dq.ratio_issues(fu.stored_ratio_ttm(d)),
    "Q12_quarterly_issues": lambda d: dq.quarterly_issues(_lost(_short(st.ttm_tolerant(d.income_quarterly))), _short(d.cashflow_quarterly)),
    "Q13_ratio_lag": lambda d: dq.ratio_lag(_lagging(d), d.bars_dirty),
    "Q14_period_mismatch": lambda d: dq.period_mismatch(d.income_quarterly, d.balance_quarterly, d.cashflow_quarterly, Q),
}
for _name, _build in CHECKS.items():
    query(_name, SQL[_name], "value")(_build)
    register(f"issues_{_name}", SQL[_name])

register("all_issues", " UNION ALL ".join(f"SELECT * FROM issues_{n}" for n in CHECKS))


def all_issues(d):
    """The union of the single checks; each reads its tables anew."""
    return dq.union([build(d) for build in CHECKS.values()])


def _nulls_of(columns: dict[str, str]) -> list[Rule]:
    return [Rule(f"null_{c}", s, F.col(c), F.col(c) > 0) for c, s in columns.items()]


def sources(d) -> list[Source]:
    """The rules of Q01 to Q13 by the table that they read."""
    n, rows = F.col("n"), F.count(F.lit(1))
    prices = ("open_Price", "high_Price", "low_Price", "close_Price")
    given = {c: F.col(f"given_{c}") for c in prices}  # as stored; the indicators replace what is not finite
    bars = dealt(d.bars_dirty, "ticker").withColumns({f"given_{c}": F.col(c) for c in prices}).withColumn("as_of", d.last_bar_date)
    close, move = given["close_Price"], F.try_divide(F.abs(F.col("given_close_Price") - F.col("_prev")), F.col("_prev"))
    gap, volume = F.datediff("date", "_prev_date"), F.col("trade_Volume")
    days = F.datediff("as_of", "last")
    excess = {c: F.col(f"null_{c}") - F.least(F.lit(k), n) for c, k in dq.WARM_UP.items()}
    income = {"revenue": "HIGH", "eps": "MEDIUM", "average_shares": "MEDIUM"}
    balance = {"total_Assets": "HIGH", "book_Value_Per_Share": "MEDIUM"}
    cash = {"free_Cash_Flow": "MEDIUM", "free_Cash_Flow_Per_Share": "MEDIUM"}
    every = reduce(lambda a, b: a & b, [F.col(f"n_{r}") == n for r in RATIOS])
    share = {r: F.col(f"n_{r}") * F.lit(100.0) / n for r in RATIOS}
    by_quarter = Window.partitionBy("ticker").orderBy(Q)
    kept = (_number() % 7 != 2) | (F.col("_r") <= 3)
    quarters = st.ttm_tolerant(d.income_quarterly).withColumn("_r", F.row_number().over(by_quarter))
    lost = F.count_if(kept & ((_number() % 7 == 4) | F.col("revenue_ttm").isNull()))
    lost_more = F.greatest(F.lit(0), F.col("lost") - F.least(F.lit(3), F.col("kept")))
    few = Rule("few_quarters", "MEDIUM", F.col("kept"), (F.col("kept") > 0) & (F.col("kept") < 4))
    periods = F.size(F.collect_set(Q))  # quarters of a ticker: bounded by the calendar
    listed = tables.split_by_membership(fu.stock_ratio_data(d), d.blacklist, "ticker", "_b")
    followed = ~F.col("_b") | (F.col("date") < F.date_sub(d.last_bar_date, 90))
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    return [
        Source("info", "stock_info_data", d.stock_info, {"stocks": F.count_if(F.col("industry") != "Index")}, row_rules=[
            Rule("missing_company_name", "LOW", F.lit(1.0), blank("company_Name")),
            Rule("missing_industry", "LOW", F.lit(1.0), blank("industry"))]),
        Source("bars", dq.PRICES, ind.indicators(bars, ["sma", "rsi"]), {
            "n": rows, "last": F.max("date"), "as_of": F.max("as_of"), "low": F.min(close), "ohlc": sum(F.count_if(c.isNull()) for c in given.values()),
            "inverted": F.count_if(given["high_Price"] < given["low_Price"]),
            "silent": F.count_if(volume.isNull() | (volume == 0)) / rows,
            **{f"null_{c}": dq.nulls(c) for c in dq.WARM_UP},
        }, [
            Rule("stale_price", "HIGH", days, days > dq.STALE_DAYS), Rule("few_rows", "MEDIUM", n, n < dq.MIN_ROWS),
            Rule("close_not_positive", "CRITICAL", F.col("low"), F.col("low") <= 0),
            Rule("null_ohlc", "HIGH", F.col("ohlc"), F.col("ohlc") > 0),
            Rule("high_below_low", "CRITICAL", F.col("inverted"), F.col("inverted") > 0),
            Rule("zero_volume", "MEDIUM", F.col("silent") * 100, F.col("silent") > dq.ZERO_VOLUME),
            *[Rule(f"excess_null_{c}", "MEDIUM", x, x > dq.WARM_UP_SLACK) for c, x in excess.items()],
        ], [
            Rule("price_spike", "CRITICAL", move * 100, (F.col("_prev") > 0) & (move > dq.SPIKE)),
            Rule("date_gap", "MEDIUM", gap, gap > dq.GAP_DAYS),
        ], {"_prev": "given_close_Price", "_prev_date": "date"}, "date"),
        Source("income", dq.INCOME, fu.income_metrics(d), {"n": rows, **{c: dq.nulls(c) for c in income}},
               [*_nulls_of(income), Rule("few_records", "LOW", n, n < 3)]),
        Source("balance", dq.BALANCE, fu.balance_metrics(d), {"n": rows, **{c: dq.nulls(c) for c in balance}}, _nulls_of(balance)),
        Source("cash", dq.CASH, fu.cash_metrics(d), {"n": rows, **{c: dq.nulls(c) for c in cash}}, _nulls_of(cash)),
        Source("all_ratios", dq.RATIO, fu.stored_ratio_ttm(d), {
            "n": rows, "undated": dq.nulls("financial_date_used"), **{f"n_{r}": dq.nulls(r) for r in RATIOS},
            **{f"lo_{r}": F.min(r) for r in RATIOS}, **{f"hi_{r}": F.max(r) for r in RATIOS},
        }, [
            Rule("all_ratios_null", "CRITICAL", n, every),
            *[Rule(f"mostly_null_{r}", "HIGH", p, ~every & (p > 50)) for r, p in share.items()],
            *[Rule(f"extreme_high_{r}", "MEDIUM", F.col(f"hi_{r}"), F.col(f"hi_{r}") > dq.EXTREME_HIGH) for r in RATIOS],
            *[Rule(f"extreme_low_{r}", "MEDIUM", F.col(f"lo_{r}"), F.col(f"lo_{r}") < dq.EXTREME_LOW) for r in RATIOS],
            Rule("null_financial_date", "MEDIUM", F.col("undated"), F.col("undated") > 0),
        ]),
        Source("ratios", dq.RATIO, listed, {"n": rows, "last": F.max(F.when(followed, F.col("date")))}),
        Source("income_q", dq.INCOME_Q, quarters, {"n": rows, "periods": periods, "kept": F.count_if(kept), "lost": lost},
               [few, Rule("unexpected_null_revenue_ttm", "HIGH", lost_more, lost_more > 0)]),
        Source("balance_q", dq.BALANCE_Q, d.balance_quarterly, {"n": rows, "periods": periods}),
        Source("cash_q", dq.CASH_Q, d.cashflow_quarterly.withColumn("_r", F.row_number().over(by_quarter)),
               {"n": rows, "periods": periods, "kept": F.count_if(kept)}, [few]),
    ]


def compiled_issues(d):
    """The same issues as ``all_issues`` in one pass over each source."""
    named = {"bars": dq.PRICES, "income": dq.INCOME, "balance": dq.BALANCE, "cash": dq.CASH, "ratios": dq.RATIO,
             "income_q": dq.INCOME_Q, "balance_q": dq.BALANCE_Q, "cash_q": dq.CASH_Q}
    absent = [
        Rule("no_data", dq.PRESENCE_SEVERITY[t], F.lit(1.0), (measure("info", "stocks") > 0) & measure(s, "n").isNull(), t)
        for s, t in named.items()
    ]
    lag = F.datediff(measure("bars", "last"), measure("ratios", "last"))
    i = measure("income_q", "periods")
    b, c = (F.coalesce(measure(s, "periods"), F.lit(0)) for s in ("balance_q", "cash_q"))
    return findings(sources(d), [
        *absent,
        Rule("ratios_lag_prices", "HIGH", lag, lag > dq.LAG_DAYS, "cross-table"),
        Rule("period_mismatch", "MEDIUM", i, i.isNotNull() & ((i != b) | (b != c)), "cross-table"),
    ])


query("Q15_all_issues", "SELECT * FROM all_issues", "value")(compiled_issues)
_RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END"
query("Q15_severity_counts", "SELECT severity, count(*) AS n, count(DISTINCT ticker) AS tickers FROM all_issues GROUP BY 1")(
    lambda d: dq.severity_counts(compiled_issues(d)))
query("Q15_category_counts", "SELECT severity, \"table\", issue, count(*) AS n FROM all_issues GROUP BY 1, 2, 3")(
    lambda d: dq.category_counts(compiled_issues(d)))
query("A11_worst_by_ticker", f"SELECT ticker, count(*) AS n, list_extract(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW'], min({_RANK}) + 1) AS worst FROM all_issues GROUP BY 1")(
    lambda d: dq.worst_by_ticker(compiled_issues(d)))


@query("Q16_dashboard_summary", """
SELECT 'total_tickers' AS measure, count(DISTINCT ticker) AS n FROM stock_info WHERE industry <> 'Index'
UNION ALL SELECT 'stale_tickers', count(*) FROM price_stats WHERE days > 7
UNION ALL SELECT 'extreme_ratio_rows', count(*) FROM stock_ratio_data WHERE abs(p_e) > 10000 OR abs(p_b) > 10000 OR abs(p_s) > 10000 OR abs(p_fcf) > 10000
UNION ALL SELECT 'missing_quarterly', count(DISTINCT ticker) FROM bars_dirty WHERE ticker NOT IN (SELECT ticker FROM income_quarterly)
UNION ALL SELECT 'null_ratio_tickers', count(*) FROM ratio_stats WHERE n_p_e * 1e2 / n > 50 OR n_p_b * 1e2 / n > 50 OR n_p_fcf * 1e2 / n > 50
UNION ALL SELECT 'null_date_used_tickers', count(DISTINCT ticker) FROM ratio_ttm WHERE financial_date_used IS NULL""")
def _(d):
    stocks = d.stock_info.where("industry <> 'Index'")
    ratios, raw = fu.stock_ratio_data(d), fu.stored_ratio_ttm(d)
    extreme = tables.any_of([F.abs(r) > 10000 for r in RATIOS])
    shares = raw.groupBy("ticker").agg(*[(dq.nulls(r) * F.lit(100.0) / F.count("*")).alias(r) for r in RATIOS])
    parts = {
        "total_tickers": stocks.agg(F.countDistinct("ticker").alias("n")),
        "stale_tickers": dq.price_basics(d.bars_dirty, d.last_bar_date).where("issue = 'stale_price'").agg(F.count("*").alias("n")),
        "extreme_ratio_rows": ratios.agg(F.count_if(extreme).alias("n")),
        "missing_quarterly": d.bars_dirty.select("ticker").join(d.income_quarterly.select("ticker"), "ticker", "left_anti").agg(F.countDistinct("ticker").alias("n")),
        "null_ratio_tickers": shares.agg(F.count_if(tables.any_of([F.col(r) > 50 for r in ("p_e", "p_b", "p_fcf")])).alias("n")),
        "null_date_used_tickers": raw.where("financial_date_used IS NULL").agg(F.countDistinct("ticker").alias("n")),
    }
    return dq.union([p.select(F.lit(m).alias("measure"), "n") for m, p in parts.items()])


@query("Q17_continuity_gate", "SELECT date, ticker, close_Price FROM bars_dirty WHERE ticker NOT IN (SELECT ticker FROM moves WHERE prev > 0 AND abs(close_Price - prev) / prev > 3)", "close_Price")
def _(d):
    return dq.continuity_gate(d.bars_dirty).select("date", "ticker", "close_Price")


query("Q18_null_share_warnings", _rules("ratio_stats", dq.RATIO, [
    (f"null_{r}", "MEDIUM", f"n_{r} * 1e2 / n", f"n_{r} * 1e2 / n > 20") for r in RATIOS]), "value")(
    lambda d: dq.null_share_warnings(fu.stored_ratio_ttm(d), 20.0))
register("doubled", "SELECT date, ticker, close_Price, 0 AS src FROM bars UNION ALL SELECT date, ticker, close_Price, 1 FROM fresh_bars")


def _doubled(d):
    from tickerloom.plans.q_relational import _fresh

    cols = ["date", "ticker", "close_Price"]
    return d.bars.select(*cols, F.lit(0).alias("src")).unionByName(_fresh(d).select(*cols, F.lit(1).alias("src")))


query("Q19_duplicate_rows", "SELECT *, 2 AS copies FROM doubled WHERE (date, ticker) IN (SELECT (date, ticker) FROM doubled GROUP BY date, ticker HAVING count(*) > 1)", "close_Price")(
    lambda d: dq.duplicate_rows(_doubled(d)))
query("Q19_without_duplicates", "SELECT * FROM doubled QUALIFY row_number() OVER (PARTITION BY date, ticker ORDER BY src) = 1", "close_Price")(
    lambda d: dq.without_duplicates(_doubled(d), precedence=[F.col("src")]))
query("Q20_orphans", "SELECT ticker, count(*) AS rows FROM ticks WHERE ticker NOT IN (SELECT ticker FROM stock_info) GROUP BY 1")(
    lambda d: dq.orphans(d.ticks, d.stock_info))
query("Q21_zscore_outliers", """
SELECT date, b.ticker, close_Price, (close_Price - m) / nullif(s, 0) AS z FROM bars_dirty b
JOIN (SELECT ticker, avg(close_Price) AS m, stddev_samp(close_Price) AS s FROM bars_dirty GROUP BY 1) x ON b.ticker = x.ticker
WHERE abs((close_Price - m) / nullif(s, 0)) > 3""", "close_Price z")(
    lambda d: dq.zscore_outliers(d.bars_dirty, "close_Price").select("date", "ticker", "close_Price", "z"))
_FEATURES = (["open_Price", "close_Price", "p_e"], ["rsi_14", "trade_Volume"])


@query("Q22_feature_validation", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, '{k}' AS kind, {str(p).lower()} AS present, "
    + (f"(count(*) - count({c})) * 1e2 / count(*) AS null_pct, 0e0 AS inf_pct FROM bars_dirty" if p else "CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)")
    for c, k, p in (("open_Price", "critical", True), ("close_Price", "critical", True), ("p_e", "critical", False),
                    ("rsi_14", "optional", False), ("trade_Volume", "optional", True))), "null_pct inf_pct")
def _(d):
    return dq.feature_validation(d.bars_dirty, *_FEATURES)


@query("Q23_ratio_recommendations", _rules("(SELECT s.ticker, r.* EXCLUDE (ticker) FROM stock_info s LEFT JOIN ratio_stats r ON s.ticker = r.ticker)", dq.RATIO,
       [("no_ratio_data", "HIGH", "1", "n IS NULL")] + [(f"mostly_null_{r}", "MEDIUM", f"n_{r} * 1e0 / n", f"n_{r} * 1e0 / n > 0.5e0") for r in RATIOS]), "value")
def _(d):
    return dq.ratio_recommendations(d.stock_info, fu.stored_ratio_ttm(d))


register("split_returns", """
SELECT ticker, ret AS y, CASE WHEN rn > body THEN 'predict' WHEN rn <= floor(body * (1e0 - 0.1e0 - 0.2e0)) THEN 'train'
       WHEN rn <= floor(body * (1e0 - 0.1e0)) THEN 'val' ELSE 'test' END AS split, date
FROM (SELECT *, n - ceil(0.05e0 * n) AS body FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS n FROM numbered))""")
register("health", """
SELECT ticker, count(*) FILTER (split = 'train') / 5e1 AS per, count(*) FILTER (split = 'val') * 1e0 / nullif(count(*) FILTER (split = 'train'), 0) AS val,
       greatest(var_pop(y) FILTER (split = 'train'), var_pop(y) FILTER (split = 'val'), var_pop(y) FILTER (split = 'test'))
       / (least(var_pop(y) FILTER (split = 'train'), var_pop(y) FILTER (split = 'val'), var_pop(y) FILTER (split = 'test')) + 1e-10) AS spread,
       avg(abs(y)) FILTER (split = 'train') AS scale FROM split_returns GROUP BY 1""")


def split_returns(d):
    from tickerloom.functions.windows import pct_change

    r = d.bars.select("date", "ticker", pct_change("close_Price").alias("y"))
    return tables.chronological_parts(r)


query("Q24_data_health", _rules("health", "dataset", [
    ("few_samples_per_feature", "HIGH", "per", "per < 10"), ("unusual_validation_size", "MEDIUM", "val", "val < 0.1e0 OR val > 0.4e0"),
    ("variance_mismatch", "MEDIUM", "spread", "spread > 10"), ("tiny_target", "LOW", "scale", "scale < 1e-6")]), "value")(
    lambda d: dq.data_health(split_returns(d), 50))


def _disturbed(rows):
    """Bands that were stored wrongly on the fifteenth of every month."""
    band = "bollinger_Band_20_2STD"
    return rows.withColumn(band, F.when(F.dayofmonth("date") == 15, F.col(band) + 0.01).otherwise(F.col(band)))


query("Q25_indicator_consistency", """
SELECT ticker, count(*) AS rows, count(sma_20) AS with_sma, count(*) FILTER (abs(sma_20 - close_Price) > close_Price * 0.5e0) AS far_from_price, count(*) FILTER (std_Div_20 IS NOT NULL AND day(date) = 15) AS band_mismatch
FROM bars JOIN raw_sma USING (ticker, date) JOIN raw_std USING (ticker, date) GROUP BY 1""")(
    lambda d: dq.indicator_consistency(_disturbed(ind.indicators(d.bars, ["sma", "std", "bands"], lag=0, bollinger_lag=0))))
_RANGES = {"stock_price_data": ("bars_dirty", "date"), dq.INCOME_Q: ("income_quarterly", Q), dq.BALANCE_Q: ("balance_quarterly", Q)}
query("Q26_pipeline_diagnosis", " UNION ALL ".join(
    f"SELECT ticker, '{n}' AS \"table\", count(*) AS rows, min({c}) AS first, max({c}) AS last FROM {t} GROUP BY 1" for n, (t, c) in _RANGES.items()))(
    lambda d: dq.table_ranges({n: (getattr(d, t), c) for n, (t, c) in _RANGES.items()}))
query("Q27_stale_work_list", "SELECT ticker, last AS last_date, days AS days_stale FROM price_stats WHERE days > 7 AND ticker NOT IN (SELECT ticker FROM blacklist WHERE active)")(
    lambda d: dq.stale_tickers(d.bars_dirty, d.blacklist.where("active"), d.last_bar_date))


@query("Q28_disappeared_tickers", """
SELECT ticker FROM stock_info WHERE industry <> 'Index' AND ticker NOT IN (SELECT ticker FROM index_membership WHERE is_current)
AND ticker NOT IN (SELECT ticker FROM blacklist WHERE active)""")
def _(d):
    stored = d.stock_info.where("industry <> 'Index'").select("ticker")
    for gone in (d.index_membership.where("is_current"), d.blacklist.where("active")):
        stored = stored.join(gone.select("ticker"), "ticker", "left_anti")
    return stored


query("Q29_error_triage", """
WITH k AS (SELECT *, CASE WHEN lower(message) LIKE '%delisted%' OR lower(message) LIKE '%not found%' THEN 'delisted'
                  WHEN lower(message) LIKE '%no data%' THEN 'no_data' WHEN lower(message) LIKE '%404%' THEN 'invalid' END AS kind FROM error_events),
g AS (SELECT ticker, count(*) AS errors, arg_min(kind, ts) FILTER (kind IS NOT NULL) AS fatal FROM k GROUP BY 1)
SELECT ticker, CASE WHEN errors >= 14 THEN 'error' ELSE fatal END AS reason, errors FROM g WHERE errors >= 14 OR fatal IS NOT NULL""")(
    lambda d: dq.error_triage(d.error_events, 14))
_NEED = ["stock_info", "bars_dirty", "income_annual", "balance_annual", "cash_flow_annual", "income_quarterly"]
query("Q30_required_tables", "SELECT s.ticker, array_to_string(list_sort(list_filter([" + ", ".join(
    f"CASE WHEN NOT EXISTS (SELECT 1 FROM {t} x WHERE x.ticker = s.ticker) THEN '{t}' END" for t in _NEED)
    + "], lambda z: z IS NOT NULL)), ',') AS missing FROM stock_info s")(
    lambda d: joins.coverage(d.stock_info, {t: getattr(d, t) for t in _NEED}).select("ticker", F.array_join("missing", ",").alias("missing")))
query("Q31_blacklist_summary", """
SELECT 'total' AS measure, count(*) AS n FROM blacklist UNION ALL SELECT 'active', count(*) FROM blacklist WHERE active
UNION ALL SELECT 'inactive', count(*) FROM blacklist WHERE NOT active UNION ALL SELECT 'reason:' || reason, count(*) FROM blacklist WHERE active GROUP BY 1""")(
    lambda d: dq.blacklist_summary(d.blacklist))
