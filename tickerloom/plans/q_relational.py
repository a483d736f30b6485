"""S: scans and table maintenance; P: filters; J: joins; A: aggregates; L, U, W: the rest."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.functions import scalar as sc
from tickerloom.functions import windows as win
from tickerloom.operators import joins, merges, moments, tables
from tickerloom.operators.percentiles import exact_percentiles
from tickerloom.plans.domain_sql import register
from tickerloom.plans.registry import query
from tickerloom.session import shared_folder
from tickerloom.sources import readers, writers

OHLC = "open_Price high_Price low_Price close_Price"
BAR = ["date", "ticker", *OHLC.split(), "trade_Volume"]
Q, Y = "fiscal_quarter_end", "financial_Statement_Date"


# ---- scans -----------------------------------------------------------------------------
@query("S01_scan_equal", "SELECT * FROM lineitem WHERE l_suppkey = 3",
       "l_quantity l_extendedprice l_discount l_tax")
def _(d):
    return readers.read_table(d.spark, f"{d.sf_dir}/lineitem.parquet", l_suppkey=3)


@query("S02_last_rows_per_ticker", """
SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 30""", OHLC)
def _(d):
    return joins.last_rows(d.bars, 30)


@query("S02_newest_rows_global", "SELECT * FROM bars ORDER BY date DESC, ticker LIMIT 100", OHLC)
def _(d):
    return tables.newest_rows(d.bars, 100)


register("statements_joined", f"""
SELECT i.ticker, i.{Y}, revenue, net_Income, total_Assets, equity, free_Cash_Flow
FROM income_annual i JOIN balance_annual b ON i.ticker = b.ticker AND i.{Y} = b.{Y}
JOIN cash_flow_annual c ON i.ticker = c.ticker AND i.{Y} = c.{Y}
""")
_SJ = "revenue net_Income total_Assets equity free_Cash_Flow"


def _statements(d):
    keys = ["ticker", Y]
    return (
        d.income_annual.select(*keys, "revenue", "net_Income")
        .join(d.balance_annual.select(*keys, "total_Assets", "equity"), keys)
        .join(d.cash_flow_annual, keys)
    )


@query("S03_statements_last_rows", f"""
SELECT * FROM statements_joined
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY {Y} DESC) <= 3""", _SJ)
def _(d):
    return joins.last_rows(_statements(d), 3, order=Y)


@query("S04_quarterly_newest_first", f"SELECT * FROM balance_quarterly ORDER BY ticker, {Q} DESC",
       "total_assets total_liabilities total_equity current_assets current_liabilities inventory "
       "cash_and_equivalents total_debt")
def _(d):
    return d.balance_quarterly.orderBy("ticker", F.col(Q).desc())


_PRED = ("predicted_price current_price predicted_return confidence_lower_5 confidence_lower_16 "
         "confidence_upper_84 confidence_upper_95")


@query("S05_optional_filters", """
SELECT * FROM predictions WHERE prediction_horizon_days IN (30, 252)
AND target_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'""", _PRED)
def _(d):
    import datetime as dt

    return tables.where_all(
        d.predictions, ticker=None, prediction_horizon_days=[30, 252],
        between__target_date=(dt.date(1997, 1, 1), dt.date(1998, 12, 31)),
    )


@query("S06_csv_symbols", "SELECT ticker AS Symbol, index_code AS Index, exchange AS Exchange FROM index_membership")
def _(d):
    path = shared_folder(d.spark, "symbols")
    out = d.index_membership.select(
        F.col("ticker").alias("Symbol"), F.col("index_code").alias("Index"),
        F.col("exchange").alias("Exchange"))
    writers.write_csv(out, path)
    return readers.read_symbols(d.spark, path)


@query("S07_csv_sink", "SELECT date, ticker, close_Price, trade_Volume FROM bars", "close_Price")
def _(d):
    path = shared_folder(d.spark, "csv")
    cols = ["date", "ticker", "close_Price", "trade_Volume"]
    writers.write_csv(d.bars.select(*cols), path)
    return d.spark.read.schema("date date, ticker string, close_Price double, trade_Volume bigint").csv(
        path, header=True)


@query("S08_json_map_source", """
SELECT ticker, reason, 'seen at ' || ticker AS details, '2024-01-' || lpad(CAST(length(reason) AS VARCHAR), 2, '0') AS date_added, active
FROM blacklist""")
def _(d):
    path = shared_folder(d.spark, "blacklist")
    day = F.concat(F.lit("2024-01-"), F.lpad(F.length("reason").cast("string"), 2, "0"))
    rows = d.blacklist.withColumns({"details": F.concat(F.lit("seen at "), F.col("ticker")), "date_added": day})
    readers.blacklist_object(rows).write.text(path)
    return readers.read_blacklist(d.spark, path)


@query("S09_json_sink", "SELECT reason, count(*) AS n FROM blacklist WHERE active GROUP BY reason")
def _(d):
    path = shared_folder(d.spark, "json")
    writers.write_json(d.blacklist.where("active").groupBy("reason").agg(F.count("*").alias("n")), path)
    return d.spark.read.schema("reason string, n bigint").json(path)


# ---- table maintenance -----------------------------------------------------------------
register("fresh_bars", """
SELECT date, ticker, open_Price, high_Price, low_Price, close_Price + 1 AS close_Price, trade_Volume
FROM bars WHERE date >= (SELECT as_of FROM as_of) - 60
""")
register("stored_bars", "SELECT * FROM bars WHERE date < (SELECT as_of FROM as_of) - 20")


def _fresh(d):
    return d.bars.where(F.col("date") >= F.date_sub(d.last_bar_date, 60)).withColumn(
        "close_Price", F.col("close_Price") + F.lit(1.0))


def _stored(d):
    return d.bars.where(F.col("date") < F.date_sub(d.last_bar_date, 20))


@query("S10_replace_range", """
WITH span AS (SELECT ticker, min(date) AS lo, max(date) AS hi FROM fresh_bars GROUP BY 1)
SELECT s.* FROM stored_bars s LEFT JOIN span USING (ticker) WHERE lo IS NULL OR NOT s.date BETWEEN lo AND hi
UNION ALL SELECT * FROM fresh_bars""", OHLC)
def _(d):
    return merges.replace_range(_stored(d), _fresh(d))


register("bench_bars", "SELECT b.date, b.ticker, index_code, b.close_Price FROM bars b JOIN index_membership USING (ticker)")


@query("S11_replace_range_two_keys", """
WITH n AS (SELECT date, ticker, index_code, close_Price * 2 AS close_Price FROM bench_bars
           WHERE date BETWEEN DATE '1999-01-01' AND DATE '1999-06-30'),
span AS (SELECT ticker, index_code, min(date) AS lo, max(date) AS hi FROM n GROUP BY 1, 2)
SELECT b.* FROM bench_bars b LEFT JOIN span USING (ticker, index_code)
WHERE lo IS NULL OR NOT b.date BETWEEN lo AND hi UNION ALL SELECT * FROM n""", "close_Price")
def _(d):
    base = d.bars.select("date", "ticker", "close_Price").join(
        d.index_membership.select("ticker", "index_code"), "ticker").select(
        "date", "ticker", "index_code", "close_Price")
    new = base.where("date BETWEEN DATE '1999-01-01' AND DATE '1999-06-30'").withColumn(
        "close_Price", F.col("close_Price") * 2)
    return merges.replace_range(base, new, ["ticker", "index_code"])


@query("S12_replace_by_key", f"""
WITH n AS (SELECT ticker, {Q}, -net_income_q AS net_income_q FROM income_quarterly WHERE {Q} >= DATE '2000-01-01')
SELECT ticker, {Q}, net_income_q FROM income_quarterly WHERE ticker NOT IN (SELECT ticker FROM n)
UNION ALL SELECT * FROM n""", "net_income_q")
def _(d):
    base = d.income_quarterly.select("ticker", Q, "net_income_q")
    new = base.where(F.col(Q) >= "2000-01-01").withColumn("net_income_q", -F.col("net_income_q"))
    return merges.replace_by_key(base, new, ["ticker"])


@query("S12_replace_by_date_key", """
WITH n AS (SELECT prediction_date, ticker, prediction_horizon_days, predicted_price + 1 AS predicted_price
           FROM predictions WHERE prediction_horizon_days = 30 AND month(prediction_date) = 6)
SELECT prediction_date, ticker, prediction_horizon_days, predicted_price FROM predictions p
WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.ticker = p.ticker AND n.prediction_date = p.prediction_date)
UNION ALL SELECT * FROM n""", "predicted_price")
def _(d):
    base = d.predictions.select("prediction_date", "ticker", "prediction_horizon_days", "predicted_price")
    new = base.where((F.col("prediction_horizon_days") == 30) & (F.month("prediction_date") == 6))
    new = new.withColumn("predicted_price", F.col("predicted_price") + 1)
    return merges.replace_by_key(base, new, ["prediction_date", "ticker"])


@query("S13_insert_only_new", """
WITH n AS (SELECT * FROM (SELECT *, 0 AS v FROM fresh_bars UNION ALL
           SELECT * REPLACE (close_Price + 5 AS close_Price), 1 FROM fresh_bars)
           QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY v DESC) = 1)
SELECT * FROM stored_bars UNION ALL
SELECT * EXCLUDE (v) FROM n WHERE (ticker, date) NOT IN (SELECT (ticker, date) FROM stored_bars)""", OHLC)
def _(d):
    fresh = _fresh(d)
    batch = fresh.withColumn("v", F.lit(0)).unionByName(
        fresh.withColumn("close_Price", F.col("close_Price") + 5).withColumn("v", F.lit(1)))
    return merges.insert_only_new(_stored(d), batch, ["ticker", "date"], [F.col("v")])


@query("S14_key_upsert", """
SELECT ticker, last_fetch_date, quarters_count FROM quarterly_metadata
WHERE ticker NOT IN (SELECT ticker FROM blacklist)
UNION ALL SELECT ticker, (SELECT as_of FROM as_of), 99 FROM blacklist""")
def _(d):
    base = d.quarterly_metadata.select("ticker", "last_fetch_date", "quarters_count")
    new = d.blacklist.select("ticker", d.last_bar_date.alias("last_fetch_date"),
                             F.lit(99).cast("bigint").alias("quarters_count"))
    return merges.upsert(base, new, ["ticker"])


@query("S15_append", "SELECT ticker, reason, active FROM blacklist UNION ALL SELECT ticker, 'manual', true FROM stock_info WHERE industry = 'Index'")
def _(d):
    new = d.stock_info.where("industry = 'Index'").select(
        "ticker", F.lit("manual").alias("reason"), F.lit(True).alias("active"))
    return merges.append(d.blacklist, new)


# cut dates inside the history: ninety days before a ticker's newest bar
register("cut_dates", """
SELECT ticker, max(date) - 90 AS from_date FROM bars
WHERE ticker IN (SELECT ticker FROM quarterly_metadata WHERE last_quarter_end IS NOT NULL) GROUP BY 1""")


def _cuts(d):
    known = d.quarterly_metadata.where("last_quarter_end IS NOT NULL").select("ticker")
    newest = d.bars.join(known, "ticker", "left_semi").groupBy("ticker").agg(F.max("date").alias("_last"))
    return newest.select("ticker", F.date_sub("_last", 90).alias("from_date"))


@query("S16_delete_suffix", "SELECT b.* FROM bars b LEFT JOIN cut_dates c USING (ticker) WHERE from_date IS NULL OR date < from_date", OHLC)
def _(d):
    return merges.delete_from(d.bars, _cuts(d))[0]


@query("S16_delete_suffix_counts", "SELECT ticker, count(*) AS deleted FROM bars JOIN cut_dates USING (ticker) WHERE date >= from_date GROUP BY 1")
def _(d):
    return merges.delete_from(d.bars, _cuts(d))[1]


_CASCADE = ("bars", "income_quarterly", "balance_quarterly", "cashflow_quarterly", "predictions", "stock_info",
            "index_membership")


@query("S17_cascade_delete", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) AS deleted FROM {t} WHERE ticker IN (SELECT ticker FROM blacklist)" for t in _CASCADE))
def _(d):
    named = {n: getattr(d, n) for n in _CASCADE}
    return merges.cascade_delete(named, d.blacklist)[1]


@query("S18_conditional_update", """
SELECT ticker, model_type, CASE WHEN tuning_date < (SELECT as_of FROM as_of) - 30 THEN false ELSE is_valid END AS is_valid
FROM model_registry""")
def _(d):
    old = F.col("tuning_date") < F.date_sub(d.last_bar_date, 30)
    return merges.set_where(d.model_registry, old, is_valid=False).select("ticker", "model_type", "is_valid")


@query("S18_patch_non_null", """
SELECT s.ticker, coalesce(p.company_Name, s.company_Name) AS company_Name, industry
FROM stock_info s LEFT JOIN (SELECT ticker, reason AS company_Name FROM blacklist WHERE active) p ON s.ticker = p.ticker""")
def _(d):
    patch = d.blacklist.select("ticker", F.when(F.col("active"), F.col("reason")).alias("company_Name"))
    return merges.patch_non_null(d.stock_info, patch, ["ticker"]).select("ticker", "company_Name", "industry")


# ---- filters and projections -----------------------------------------------------------
@query("P01_inequality", "SELECT ticker FROM stock_info WHERE industry <> 'Index'")
def _(d):
    return d.stock_info.where(F.col("industry") != "Index").select("ticker")


@query("P02_in_between", """
SELECT date, ticker, close_Price FROM bars WHERE ticker IN (SELECT ticker FROM blacklist)
AND date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'""", "close_Price")
def _(d):
    return (
        d.bars.select("date", "ticker", "close_Price")
        .where("date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'")
        .join(d.blacklist.select("ticker"), "ticker", "left_semi")
    )


@query("P03_drop_critical_nulls", "SELECT * FROM bars_dirty WHERE date IS NOT NULL AND ticker IS NOT NULL AND close_Price IS NOT NULL", OHLC)
def _(d):
    return d.bars_dirty.na.drop(subset=["date", "ticker", "close_Price"])


@query("P04_schema_completion", "SELECT date, ticker, CAST(NULL AS VARCHAR) AS currency, trade_Volume, close_Price, CAST(NULL AS DOUBLE) AS rsi_14 FROM bars", "close_Price rsi_14")
def _(d):
    schema = T._parse_datatype_string(
        "date date, ticker string, currency string, trade_Volume bigint, close_Price double, rsi_14 double")
    return tables.complete_schema(d.bars, schema)


@query("P05_allowed_columns", f"SELECT ticker, {Q}, revenue_q FROM income_quarterly", "revenue_q")
def _(d):
    return tables.allowed_columns(d.income_quarterly, ["ticker", Q, "revenue_q", "ebitda_q"])


@query("P06_rename_first_wins", f"""
SELECT ticker, {Q}, coalesce(revenue_q, operating_income_q) AS revenue, net_income_q AS net_income,
       CAST(NULL AS DOUBLE) AS ebitda FROM income_quarterly""", "revenue net_income ebitda")
def _(d):
    names = {"revenue": ["total_revenue", "revenue_q", "operating_income_q"],
             "net_income": ["net_income_q", "net_income_common"], "ebitda": ["ebitda_q"]}
    return tables.rename_first_wins(d.income_quarterly, names, ["ticker", Q])


@query("P07_quarterly_as_annual", f"""
SELECT ticker, {Q} AS {Y}, revenue_q AS revenue, gross_profit_q AS gross_Profit,
       operating_income_q AS operating_Earning, net_income_q AS net_Income, shares_diluted AS average_shares
FROM income_quarterly""", "revenue gross_Profit operating_Earning net_Income average_shares")
def _(d):
    pairs = {Y: Q, "revenue": "revenue_q", "gross_Profit": "gross_profit_q",
             "operating_Earning": "operating_income_q", "net_Income": "net_income_q",
             "average_shares": "shares_diluted"}
    return d.income_quarterly.select("ticker", *[F.col(v).alias(k) for k, v in pairs.items()])


@query("P08_drop_null_columns", f"SELECT ticker, {Q}, net_income_q FROM income_quarterly", "net_income_q")
def _(d):
    wide = d.income_quarterly.select("ticker", Q, "revenue_q", "net_income_q").withColumn(
        "ebitda_q", F.lit(None).cast("double"))
    return tables.drop_null_columns(tables.drop_null_columns(wide, "all"), "any")


register("texts", "SELECT event_id, CASE WHEN event_id % 5 = 2 THEN 'N/A' ELSE CAST(value AS VARCHAR) END AS txt, value, event_type FROM events")


def _texts(d):
    e = d.raw("events")
    return e.select("event_id", F.when(F.col("event_id") % 5 == 2, "N/A").otherwise(
        F.col("value").cast("string")).alias("txt"), "value")


@query("P09_to_number", "SELECT event_id, TRY_CAST(txt AS DOUBLE) AS num FROM texts", "num")
def _(d):
    return _texts(d).select("event_id", sc.to_number("txt").alias("num"))


@query("P10_infinite_to_null", "SELECT event_id, CASE WHEN event_id % 7 NOT IN (0, 1) THEN value END AS value FROM events", "value")
def _(d):
    e = d.raw("events")
    dirty = F.when(F.col("event_id") % 7 == 0, F.lit(float("inf"))).when(
        F.col("event_id") % 7 == 1, F.lit(float("nan"))).otherwise(F.col("value"))
    return e.select("event_id", sc.finite(dirty).alias("value"))


@query("P11_index_predicate", "SELECT ticker, industry = 'Index' OR starts_with(ticker, '^') AS is_index FROM stock_info")
def _(d):
    return d.stock_info.select("ticker", sc.is_index("ticker", "industry").alias("is_index"))


@query("P13_freshness_case", """
SELECT ticker, model_type, (SELECT as_of FROM as_of) - tuning_date AS age_days,
       is_valid AND (SELECT as_of FROM as_of) - tuning_date <= 30 AS is_fresh FROM model_registry""")
def _(d):
    age = F.datediff(d.last_bar_date, F.col("tuning_date"))
    return d.model_registry.select("ticker", "model_type", age.alias("age_days"),
                                   (F.col("is_valid") & (age <= 30)).alias("is_fresh"))


@query("P14_year_to_date", "SELECT date, ticker, close_Price FROM bars WHERE date >= date_trunc('year', (SELECT as_of FROM as_of))", "close_Price")
def _(d):
    return tables.year_to_date(d.bars.select("date", "ticker", "close_Price"), d.last_bar_date)


# ---- joins -----------------------------------------------------------------------------
@query("J01_inner_benchmark", """
SELECT b.date, b.ticker, b.close_Price, m.close_Price AS index_close FROM bars b
JOIN index_membership x ON b.ticker = x.ticker
JOIN benchmarks m ON m.index_code = x.index_code AND m.date = b.date""", "close_Price index_close")
def _(d):
    own = d.bars.select("date", "ticker", "close_Price").join(
        d.index_membership.select("ticker", "index_code"), "ticker")
    m = d.benchmarks.withColumnRenamed("close_Price", "index_close")
    return own.join(m, ["index_code", "date"]).select("date", "ticker", "close_Price", "index_close")


query("J02_three_way_inner", "SELECT * FROM statements_joined", _SJ)(_statements)


@query("J03_left_join", """
SELECT p.ticker, p.prediction_date, p.prediction_horizon_days, p.target_date, b.close_Price AS actual_price
FROM predictions p LEFT JOIN bars b ON p.ticker = b.ticker AND p.target_date = b.date""", "actual_price")
def _(d):
    actual = d.bars.select("ticker", F.col("date").alias("target_date"), F.col("close_Price").alias("actual_price"))
    return d.predictions.select("ticker", "prediction_date", "prediction_horizon_days", "target_date").join(
        actual, ["ticker", "target_date"], "left")


@query("J04_anti_join", """
SELECT DISTINCT b.ticker FROM bars b JOIN stock_info s ON b.ticker = s.ticker
WHERE s.industry <> 'Index' AND b.ticker NOT IN (SELECT ticker FROM income_quarterly)""")
def _(d):
    stocks = d.stock_info.where(F.col("industry") != "Index").select("ticker")
    return stocks.join(d.bars.select("ticker"), "ticker", "left_semi").join(
        d.income_quarterly.select("ticker"), "ticker", "left_anti")


@query("J08_latest_quarter_view", f"""
SELECT i.ticker, i.{Q}, revenue_q, net_income_q, total_assets, free_cash_flow_q
FROM income_quarterly i LEFT JOIN balance_quarterly b ON i.ticker = b.ticker AND i.{Q} = b.{Q}
LEFT JOIN cashflow_quarterly c ON i.ticker = c.ticker AND i.{Q} = c.{Q}
WHERE i.{Q} = (SELECT max({Q}) FROM income_quarterly x WHERE x.ticker = i.ticker)""",
       "revenue_q net_income_q total_assets free_cash_flow_q")
def _(d):
    keys = ["ticker", Q]
    latest = joins.keep_latest(d.income_quarterly, ["ticker"], [F.col(Q)]).select(
        *keys, "revenue_q", "net_income_q")
    return latest.join(d.balance_quarterly.select(*keys, "total_assets"), keys, "left").join(
        d.cashflow_quarterly.select(*keys, "free_cash_flow_q"), keys, "left")


@query("J08_latest_valuations_view", "SELECT * FROM stock_ratio_data QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1", "p_s p_e p_b p_fcf")
def _(d):
    from tickerloom.plans.q_fundamentals import stock_ratio_data

    return joins.keep_latest(stock_ratio_data(d), ["ticker"], [F.col("date")])


@query("J09_current_members_view", """
SELECT index_code, index_name, m.ticker, company_Name, industry, exchange
FROM index_membership m JOIN stock_info s ON m.ticker = s.ticker WHERE is_current""")
def _(d):
    return (
        d.index_membership.where("is_current")
        .join(d.stock_info.select("ticker", "company_Name", "industry"), "ticker")
        .select("index_code", "index_name", "ticker", "company_Name", "industry", "exchange")
        .orderBy("index_code", "company_Name")
    )


@query("J10_constant_columns", f"SELECT date, ticker, 'USD' AS currency, (SELECT as_of FROM as_of) AS loaded_to FROM bars")
def _(d):
    return d.bars.select("date", "ticker", sc.currency_of("ticker").alias("currency"),
                         d.last_bar_date.alias("loaded_to"))


_REQUIRED = ["bars", "income_quarterly", "cashflow_quarterly", "income_annual", "blacklist"]


@query("J11_existence", "SELECT s.ticker, array_to_string(list_sort(list_filter([" + ", ".join(
    f"CASE WHEN NOT EXISTS (SELECT 1 FROM {t} x WHERE x.ticker = s.ticker) THEN '{t}' END" for t in _REQUIRED)
    + "], lambda z: z IS NOT NULL)), ',') AS missing FROM stock_info s")
def _(d):
    found = joins.coverage(d.stock_info, {t: getattr(d, t) for t in _REQUIRED})
    return found.select("ticker", F.array_join("missing", ",").alias("missing"))


@query("J12_complete_dates", """
WITH u AS (SELECT CAST(date_trunc('week', date) AS DATE) AS date, ticker, arg_max(close_Price, bars_nation.date) AS close_Price
  FROM bars_nation GROUP BY 1, 2),
k AS (SELECT ticker FROM u GROUP BY 1 HAVING count(*) >= 100),
c AS (SELECT u.* FROM u JOIN k USING (ticker))
SELECT date, ticker, close_Price FROM c
WHERE date IN (SELECT date FROM c GROUP BY date HAVING count(*) = (SELECT count(*) FROM k))""", "close_Price")
def _(d):
    week = F.trunc("date", "week").alias("date")
    bars = d.bars_nation.select(week, "ticker", "close_Price", F.col("date").alias("day"))
    bars = bars.groupBy("date", "ticker").agg(F.max_by("close_Price", "day").alias("close_Price"))
    return joins.complete_dates(bars, bars.select("ticker").distinct(), 100)


@query("J13_aggregate_before_join", """
SELECT r.ticker, max(r.prediction_date) AS last_prediction, max(p.date) AS last_bar
FROM predictions r JOIN bars p ON r.ticker = p.ticker GROUP BY 1""")
def _(d):
    a = d.predictions.groupBy("ticker").agg(F.max("prediction_date").alias("last_prediction"))
    return a.join(d.bars.groupBy("ticker").agg(F.max("date").alias("last_bar")), "ticker")


@query("J14_scalar_counts", f"""
SELECT i.ticker, count(DISTINCT {Q}) AS inc_p,
       (SELECT count(DISTINCT {Q}) FROM balance_quarterly b WHERE b.ticker = i.ticker) AS bs_p,
       (SELECT count(DISTINCT {Q}) FROM cashflow_quarterly c WHERE c.ticker = i.ticker) AS cf_p
FROM income_quarterly i GROUP BY 1""")
def _(d):
    n = lambda t, name: t.groupBy("ticker").agg(F.countDistinct(Q).alias(name))
    j = n(d.income_quarterly, "inc_p").join(n(d.balance_quarterly, "bs_p"), "ticker", "left")
    return j.join(n(d.cashflow_quarterly, "cf_p"), "ticker", "left").na.fill(0, ["bs_p", "cf_p"])


@query("J15_exact_date_lookup", f"""
SELECT i.ticker, i.{Q}, net_income_q, total_equity, free_cash_flow_q
FROM income_quarterly i LEFT JOIN balance_quarterly b ON i.ticker = b.ticker AND i.{Q} = b.{Q}
LEFT JOIN cashflow_quarterly c ON i.ticker = c.ticker AND i.{Q} = c.{Q}""",
       "net_income_q total_equity free_cash_flow_q")
def _(d):
    keys = ["ticker", Q]
    return (
        d.income_quarterly.select(*keys, "net_income_q")
        .join(d.balance_quarterly.select(*keys, "total_equity"), keys, "left")
        .join(d.cashflow_quarterly.select(*keys, "free_cash_flow_q"), keys, "left")
    )


@query("J16_patch_null_columns", f"""
SELECT b.ticker, b.{Q}, CASE WHEN count(free_cash_flow_q) OVER (PARTITION BY b.ticker) = 0
       THEN cash_and_equivalents ELSE free_cash_flow_q END AS cash
FROM balance_quarterly b LEFT JOIN cashflow_quarterly c ON b.ticker = c.ticker AND b.{Q} = c.{Q}""", "cash")
def _(d):
    keys = ["ticker", Q]
    base = d.balance_quarterly.select(*keys).join(
        d.cashflow_quarterly.select(*keys, F.col("free_cash_flow_q").alias("cash")), keys, "left")
    patch = d.balance_quarterly.select(*keys, F.col("cash_and_equivalents").alias("cash"))
    return joins.patch_empty_columns(base, patch, keys, ["cash"])


# ---- aggregates ------------------------------------------------------------------------
@query("A01_group_stats", "SELECT ticker, count(*) AS cnt, min(date) AS earliest, max(date) AS latest, min(close_Price) AS min_close, max(close_Price) AS max_close FROM bars_dirty GROUP BY 1", "min_close max_close")
def _(d):
    return d.bars_dirty.groupBy("ticker").agg(
        F.count("*").alias("cnt"), F.min("date").alias("earliest"), F.max("date").alias("latest"),
        F.min("close_Price").alias("min_close"), F.max("close_Price").alias("max_close"))


@query("A02_conditional_count", "SELECT ticker, count(*) FILTER (close_Price IS NULL) AS null_close, count(*) FILTER (close_Price IS NULL) * 1e2 / count(*) AS pct FROM bars_dirty GROUP BY 1", "pct")
def _(d):
    nulls = F.count_if(F.col("close_Price").isNull())
    return d.bars_dirty.groupBy("ticker").agg(
        nulls.alias("null_close"), (nulls * F.lit(100.0) / F.count("*")).alias("pct"))


@query("A03_count_distinct", "SELECT count(DISTINCT ticker) AS tickers, count(DISTINCT date) AS days FROM bars")
def _(d):
    return d.bars.agg(F.countDistinct("ticker").alias("tickers"), F.countDistinct("date").alias("days"))


@query("A04_having", "SELECT ticker, count(*) AS bad FROM bars_dirty WHERE high_Price < low_Price GROUP BY 1 HAVING count(*) > 3")
def _(d):
    return d.bars_dirty.where("high_Price < low_Price").groupBy("ticker").agg(
        F.count("*").alias("bad")).where("bad > 3")


@query("A07_percentiles", "SELECT year(date) AS year, " + ", ".join(
    f"quantile_cont(close_Price, {p}e0) AS p{i}" for i, p in
    (("5", 0.05), ("10", 0.1), ("16", 0.16), ("25", 0.25), ("50", 0.5), ("75", 0.75), ("84", 0.84), ("90", 0.9), ("95", 0.95)))
    + ", avg(close_Price) AS mean_price FROM bars GROUP BY 1",
       "p5 p10 p16 p25 p50 p75 p84 p90 p95 mean_price")
def _(d):
    rows = d.bars.select(F.year("date").alias("year"), "close_Price")
    probs = {f"p{round(p * 100)}": p for p in (0.05, 0.1, 0.16, 0.25, 0.5, 0.75, 0.84, 0.9, 0.95)}
    means = rows.groupBy("year").agg(F.avg("close_Price").alias("mean_price"))
    return exact_percentiles(rows, ["year"], "close_Price", probs).join(means, "year")


@query("A08_report_count_gate", f"SELECT ticker, count(*) AS quarters, count(*) >= 4 AS has_ttm FROM cashflow_quarterly GROUP BY 1")
def _(d):
    n = F.count("*")
    return d.cashflow_quarterly.groupBy("ticker").agg(n.alias("quarters"), (n >= 4).alias("has_ttm"))


@query("A09_value_counts", "SELECT reason, count(*) AS n FROM blacklist WHERE active GROUP BY 1")
def _(d):
    return d.blacklist.where("active").groupBy("reason").agg(F.count("*").alias("n"))


@query("A10_all_any_of", """
SELECT ticker, bool_or(model_type = 'rf') AND bool_or(model_type = 'xgb') AND bool_or(model_type = 'tcn') AS has_all_required,
       bool_and(is_valid) AS all_valid FROM model_registry GROUP BY 1""")
def _(d):
    required = F.array(*[F.lit(m) for m in ("rf", "xgb", "tcn")])
    return d.model_registry.groupBy("ticker").agg(
        (F.size(F.array_except(required, F.collect_set("model_type"))) == 0).alias("has_all_required"),
        F.bool_and("is_valid").alias("all_valid"))


@query("A12_table_totals", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) AS rows, count(DISTINCT ticker) AS tickers FROM {t}"
    for t in ("bars", "income_quarterly", "balance_quarterly", "cashflow_quarterly", "predictions")))
def _(d):
    names = ("bars", "income_quarterly", "balance_quarterly", "cashflow_quarterly", "predictions")
    return tables.table_counts({n: getattr(d, n) for n in names})


@query("A12_column_coverage", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS non_null, count({c}) * 1e2 / count(*) AS pct FROM bars_dirty"
    for c in ("open_Price", "close_Price", "trade_Volume")), "pct")
def _(d):
    return tables.coverage_of_columns(d.bars_dirty, ["open_Price", "close_Price", "trade_Volume"])


# ---- windows ---------------------------------------------------------------------------
_W = "(PARTITION BY ticker ORDER BY date)"


def _per_bar(name, sql, doubles, **cols):
    query(name, f"SELECT date, ticker, {sql} FROM bars_dirty", doubles)(
        lambda d: d.bars_dirty.select("date", "ticker", *[c().alias(n) for n, c in cols.items()]))


_per_bar("W01_lag", f"lag(close_Price) OVER {_W} AS prev_close", "prev_close",
         prev_close=lambda: win.previous("close_Price"))
_per_bar("W02_date_gap", f"date - lag(date) OVER {_W} AS gap_days", "",
         gap_days=lambda: F.datediff("date", F.lag("date").over(win.series())))
_per_bar("W03_pct_change", f"close_Price / nullif(lag(close_Price, 5) OVER {_W}, 0) - 1 AS r5", "r5",
         r5=lambda: win.pct_change("close_Price", 5))
_TEN = "OVER (PARTITION BY ticker ORDER BY date ROWS 9 PRECEDING)"


@query("W05_rolling_mean", f"SELECT date, ticker, CASE WHEN count(close_Price) {_TEN} = 10 THEN avg(close_Price) {_TEN} END AS m10 FROM bars_dirty", "m10")
def _(d):
    return moments.rolling_means(d.bars_dirty.select("date", "ticker", "close_Price"), "close_Price", {"m10": 10}).drop("close_Price")


@query("W06_rolling_std", f"SELECT date, ticker, CASE WHEN count(close_Price) {_TEN} = 10 THEN stddev_samp(close_Price) {_TEN} END AS s10 FROM bars_dirty", "s10")
def _(d):
    return moments.rolling_stds(d.bars_dirty.select("date", "ticker", "close_Price"), "close_Price", {"s10": 10}).drop("close_Price")


_per_bar("W10_cumulative_sum", f"sum(trade_Volume) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS total", "",
         total=lambda: F.sum("trade_Volume").over(win.running()))
_per_bar("W15_forward_fill", f"last_value(close_Price IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS filled", "filled",
         filled=lambda: win.forward_fill("close_Price"))
_per_bar("W16_backward_fill", f"first_value(close_Price IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled", "filled",
         filled=lambda: win.backward_fill("close_Price"))


@query("W04_shift_computed", f"SELECT date, ticker, lag(close_Price - open_Price) OVER {_W} AS body FROM bars", "body")
def _(d):
    return d.bars.select("date", "ticker", win.previous(F.col("close_Price") - F.col("open_Price")).alias("body"))


@query("W07_scaled_sum", f"""
SELECT ticker, {Q}, CASE WHEN count(revenue_q) OVER w >= 3 THEN sum(revenue_q) OVER w * (4e0 / count(revenue_q) OVER w) END AS revenue_ttm
FROM income_quarterly WINDOW w AS (PARTITION BY ticker ORDER BY {Q} ROWS 3 PRECEDING)""", "revenue_ttm")
def _(d):
    w = win.trailing(4, win.series(order=(Q,)))
    n = F.count("revenue_q").over(w)
    return d.income_quarterly.select("ticker", Q, F.when(n >= 3, F.sum("revenue_q").over(w) * (F.lit(4.0) / n)).alias("revenue_ttm"))


@query("W08_strict_sum", f"""
SELECT ticker, {Q}, CASE WHEN row_number() OVER (PARTITION BY ticker ORDER BY {Q}) >= 4
  THEN sum(coalesce(revenue_q, 0)) OVER (PARTITION BY ticker ORDER BY {Q} ROWS 3 PRECEDING) END AS revenue_ttm
FROM income_quarterly""", "revenue_ttm")
def _(d):
    w = win.series(order=(Q,))
    total = F.sum(F.coalesce("revenue_q", F.lit(0.0))).over(win.trailing(4, w))
    return d.income_quarterly.select("ticker", Q, F.when(F.row_number().over(w) >= 4, total).alias("revenue_ttm"))


@query("W09_rolling_moments", """
SELECT b.date, b.ticker, covar_samp(b.close_Price, b.trade_Volume) OVER w AS cov, corr(b.close_Price, b.trade_Volume) OVER w AS corr,
       var_samp(b.close_Price) OVER w AS var
FROM bars b WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date) >= 20""", "cov corr var")
def _(d):
    bars = d.bars.select("date", "ticker", "close_Price", "trade_Volume")
    rows = moments.rolling_pairs(bars, "close_Price", "trade_Volume", 20)
    return rows.where("var IS NOT NULL").drop("close_Price", "trade_Volume")


@query("W12_latest_row", "SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1", OHLC)
def _(d):
    return joins.keep_latest(d.bars, ["ticker"], [F.col("date")])


@query("W13_deduplicate", """
SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1""", "value")
def _(d):
    e = d.raw("events").select("user_id", "event_type", "event_id", "value")
    return joins.keep_latest(e, ["user_id", "event_type"], [F.col("event_id")])


@query("W14_streaks", "SELECT date, ticker, momentum FROM raw_momentum", "momentum")
def _(d):
    from tickerloom.operators.indicators import momentum_streak

    return momentum_streak(d.bars, lag=0).select("date", "ticker", "momentum")


@query("W17_sliding_sequence", """
SELECT date, ticker, array_to_string(list_transform(list(close_Price) OVER w, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ',') AS seq
FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS 9 PRECEDING)
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date) >= 10""")
def _(d):
    seq = F.collect_list(F.col("close_Price").cast("bigint").cast("string")).over(win.trailing(10))
    return d.bars.select("date", "ticker", seq.alias("_s")).where(F.size("_s") == 10).select(
        "date", "ticker", F.array_join("_s", ",").alias("seq"))


@query("W18_rank", """
SELECT date, ticker, index_code, row_number() OVER (PARTITION BY date, index_code ORDER BY trade_Volume DESC, ticker) AS rank
FROM bars JOIN index_membership USING (ticker)""")
def _(d):
    j = d.bars.select("date", "ticker", "trade_Volume").join(
        d.index_membership.select("ticker", "index_code"), "ticker")
    return tables.rank_rows(j, "trade_Volume", ["date", "index_code"]).drop("trade_Volume")


@query("W19_running_maximum", """
SELECT date, ticker, close_Price FROM (SELECT *, max(close_Price) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS m FROM bars)
WHERE close_Price = m""", "close_Price")
def _(d):
    top = F.max("close_Price").over(win.running())
    return d.bars.select("date", "ticker", "close_Price", top.alias("_m")).where("close_Price = _m").drop("_m")


@query("W20_chronological_split", """
SELECT date, ticker, CASE WHEN rn > body THEN 'predict' WHEN rn <= floor(body * (1e0 - 0.1e0 - 0.2e0)) THEN 'train'
       WHEN rn <= floor(body * (1e0 - 0.1e0)) THEN 'val' ELSE 'test' END AS split
FROM (SELECT date, ticker, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn,
             n - ceil(0.05e0 * n) AS body FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS n FROM bars))""")
def _(d):
    return tables.chronological_parts(d.bars.select("date", "ticker"))


@query("W21_growth_lags", f"""
SELECT ticker, {Q}, total_assets / nullif(lag(total_assets) OVER w, 0) - 1 AS qoq,
       total_assets / nullif(lag(total_assets, 4) OVER w, 0) - 1 AS yoy
FROM balance_quarterly WINDOW w AS (PARTITION BY ticker ORDER BY {Q})""", "qoq yoy")
def _(d):
    w = win.series(order=(Q,))
    return d.balance_quarterly.select("ticker", Q, win.pct_change("total_assets", 1, w).alias("qoq"),
                                      win.pct_change("total_assets", 4, w).alias("yoy"))


# ---- sorts, limits, sets ---------------------------------------------------------------
@query("L01_order_by", "SELECT date, ticker, trade_Volume FROM bars ORDER BY trade_Volume DESC, date, ticker")
def _(d):
    return d.bars.select("date", "ticker", "trade_Volume").orderBy(F.col("trade_Volume").desc(), "date", "ticker")


@query("L02_top_then_resort", "SELECT * FROM (SELECT date, ticker, close_Price FROM bars ORDER BY date DESC, ticker LIMIT 50) ORDER BY date", "close_Price")
def _(d):
    return tables.newest_rows(d.bars.select("date", "ticker", "close_Price"), 50)


@query("L03_top_k", "SELECT ticker, sum(trade_Volume) AS volume FROM bars GROUP BY 1 ORDER BY volume DESC, ticker LIMIT 10")
def _(d):
    return tables.top_k(d.bars.groupBy("ticker").agg(F.sum("trade_Volume").cast("bigint").alias("volume")), F.col("volume"), 10)


@query("L06_argmax_preference", """
SELECT ticker, prediction_date, arg_max(prediction_horizon_days, CASE WHEN prediction_horizon_days = 252 THEN 100000 ELSE prediction_horizon_days END) AS horizon,
       arg_max(predicted_return, CASE WHEN prediction_horizon_days = 252 THEN 100000 ELSE prediction_horizon_days END) AS predicted_return
FROM predictions GROUP BY 1, 2""", "predicted_return")
def _(d):
    h = F.col("prediction_horizon_days")
    order = F.when(h == 252, 100000).otherwise(h)
    best = F.max_by(F.struct(h.alias("horizon"), "predicted_return"), order).alias("b")
    return d.predictions.groupBy("ticker", "prediction_date").agg(best).select(
        "ticker", "prediction_date", "b.horizon", "b.predicted_return")


@query("U01_union_new_wins", """
SELECT * EXCLUDE (src) FROM (SELECT *, 0 AS src FROM stored_bars UNION ALL SELECT *, 1 FROM fresh_bars)
QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY src DESC) = 1""", OHLC)
def _(d):
    both = _stored(d).withColumn("src", F.lit(0)).unionByName(_fresh(d).withColumn("src", F.lit(1)))
    return joins.keep_latest(both, ["ticker", "date"], [F.col("src")]).drop("src")


@query("U02_report_dates", f"""
SELECT ticker, date, min(source) AS source FROM (SELECT ticker, {Y} AS date, 'annual' AS source FROM income_annual
UNION ALL SELECT ticker, {Q}, 'quarterly' FROM income_quarterly) GROUP BY 1, 2""")
def _(d):
    from tickerloom.operators.ratios import report_dates

    return report_dates(d.income_annual, d.income_quarterly)


@query("U03_quarter_merge", f"""
WITH n AS (SELECT ticker, {Q}, net_income_q + 1 AS net_income_q FROM income_quarterly WHERE {Q} >= DATE '2000-06-30')
SELECT ticker, {Q}, net_income_q FROM income_quarterly i WHERE {Q} < DATE '2001-01-01'
AND NOT EXISTS (SELECT 1 FROM n WHERE n.ticker = i.ticker AND n.{Q} = i.{Q}) UNION ALL SELECT * FROM n""", "net_income_q")
def _(d):
    q = d.income_quarterly.select("ticker", Q, "net_income_q")
    new = q.where(F.col(Q) >= "2000-06-30").withColumn("net_income_q", F.col("net_income_q") + 1)
    return merges.upsert(q.where(F.col(Q) < "2001-01-01"), new, ["ticker", Q])


@query("U04_set_difference", "SELECT ticker FROM stock_info EXCEPT SELECT ticker FROM model_registry")
def _(d):
    return d.stock_info.select("ticker").subtract(d.model_registry.select("ticker"))


@query("U05_blacklist_split", "SELECT s.ticker, b.ticker IS NOT NULL AS blacklisted FROM stock_info s LEFT JOIN (SELECT ticker FROM blacklist WHERE active) b ON s.ticker = b.ticker")
def _(d):
    return tables.split_by_membership(d.stock_info.select("ticker"), d.blacklist.where("active"), "ticker", "blacklisted")


register("listings", "SELECT l_partkey AS symbol, n_nationkey AS listed_by, n_regionkey AS position FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey")


@query("U06_first_owner", "SELECT symbol, listed_by, position FROM (SELECT DISTINCT * FROM listings) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY position, listed_by) = 1")
def _(d):
    j = d.raw("lineitem").select("l_partkey", "l_suppkey").join(
        d.raw("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").join(
        d.raw("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey")
    listing = j.select(F.col("l_partkey").alias("symbol"), F.col("s_nationkey").alias("listed_by"),
                       F.col("n_regionkey").alias("position"))
    return tables.first_owner(listing, "symbol", "listed_by", "position")


@query("U07_distinct", "SELECT DISTINCT industry, country FROM stock_info")
def _(d):
    return d.stock_info.select("industry", "country").distinct()


@query("U08_universe", """
SELECT ticker, min(source) AS source FROM (
  SELECT ticker, '1_index' AS source FROM index_membership WHERE is_current
  UNION ALL SELECT ticker, '2_stored' FROM bars UNION ALL SELECT ticker, '3_market' FROM stock_info WHERE industry = 'Index')
WHERE ticker NOT IN (SELECT ticker FROM blacklist WHERE active) GROUP BY 1""")
def _(d):
    parts = [(d.index_membership.where("is_current"), "1_index"), (d.bars, "2_stored"),
             (d.stock_info.where("industry = 'Index'"), "3_market")]
    union = None
    for t, name in parts:
        p = t.select("ticker").distinct().withColumn("source", F.lit(name))
        union = p if union is None else union.unionByName(p)
    kept = union.join(d.blacklist.where("active").select("ticker"), "ticker", "left_anti")
    return kept.groupBy("ticker").agg(F.min("source").alias("source"))
