"""F: scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.functions import scalar as sc
from tickerloom.functions.windows import series
from tickerloom.plans.domain_sql import register
from tickerloom.plans.registry import query
from tickerloom.plans.sql_text import case_suffix, clip, lag, sdiv, sratio

Q = "fiscal_quarter_end"
_LINE = "l_orderkey, l_linenumber, l_partkey"
_LINE_COLS = ["l_orderkey", "l_linenumber", "l_partkey"]


@query("F01_safe_divide", f"SELECT {_LINE}, {sdiv('l_tax', 'l_discount')} AS v FROM lineitem", "v")
def _(d):
    return d.raw("lineitem").select(*_LINE_COLS, sc.safe_divide("l_tax", "l_discount").alias("v"))


@query("F02_safe_ratio", f"SELECT {_LINE}, {sratio('l_extendedprice', 'l_discount')} AS v FROM lineitem", "v")
def _(d):
    return d.raw("lineitem").select(*_LINE_COLS, sc.safe_ratio("l_extendedprice", "l_discount").alias("v"))


_NI = lag("net_income_q", 1, Q)


@query("F03_growth", f"SELECT ticker, {Q}, net_income_q / nullif({_NI}, 0) - 1 AS g FROM income_quarterly", "g")
def _(d):
    prev = F.lag("net_income_q").over(series(order=(Q,)))
    return d.income_quarterly.select("ticker", Q, sc.growth("net_income_q", prev).alias("g"))


@query("F04_growth_abs", f"SELECT ticker, {Q}, {sdiv(f'net_income_q - {_NI}', f'abs({_NI})')} AS g FROM income_quarterly", "g")
def _(d):
    prev = F.lag("net_income_q").over(series(order=(Q,)))
    return d.income_quarterly.select("ticker", Q, sc.growth_abs("net_income_q", prev).alias("g"))


# symbols with blanks, mixed case and market suffixes
_SUFFIXES = ["", ".CO", ".ST", ".L", ".DE", ".TO", ".AX", ".T", ".NS", ".SW", ".BR", ".HK"]
_EXCHANGES = list(sc.EXCHANGE_SUFFIXES)
_SQL_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
register("symbols", f"""
SELECT c_custkey, ' ' || lower(c_mktsegment) || ' ' || CAST(c_custkey % 97 AS VARCHAR)
         || list_extract({_SQL_LIST(_SUFFIXES)}, CAST(c_custkey % {len(_SUFFIXES)} + 1 AS INTEGER)) AS symbol,
       list_extract({_SQL_LIST(_EXCHANGES)}, CAST(c_nationkey % {len(_EXCHANGES)} + 1 AS INTEGER)) AS exchange FROM customer""")


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _symbols(d):
    k = F.col("c_custkey")
    symbol = F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(" "), (k % 97).cast("string"), _pick(_SUFFIXES, k))
    return d.raw("customer").select("c_custkey", symbol.alias("symbol"), _pick(_EXCHANGES, F.col("c_nationkey")).alias("exchange"))


_CLEAN = {v: v for v in sc.EXCHANGE_SUFFIXES.values() if v}
_OWN = "CASE exchange " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in sc.EXCHANGE_SUFFIXES.items()) + " ELSE '' END"


@query("F05_clean_symbol", f"""
SELECT c_custkey, CASE WHEN sfx <> '' THEN replace(trim(left(s, length(s) - length(sfx))), ' ', '-') || sfx
                       ELSE replace(s, ' ', '-') || {_OWN} END AS cleaned
FROM (SELECT *, {case_suffix('s', _CLEAN, "''")} AS sfx FROM (SELECT *, upper(trim(symbol)) AS s FROM symbols))""")
def _(d):
    return _symbols(d).select("c_custkey", sc.clean_symbol("symbol", "exchange").alias("cleaned"))


@query("F06_exchange_of", f"SELECT c_custkey, {case_suffix('upper(symbol)', {s: n for n, s, *_ in sc.MARKETS}, chr(39) + 'us' + chr(39))} AS exchange FROM symbols")
def _(d):
    return _symbols(d).select("c_custkey", sc.exchange_of("symbol").alias("exchange"))


@query("F07_currency_of", f"SELECT c_custkey, {case_suffix('symbol', sc.CURRENCIES, chr(39) + 'USD' + chr(39))} AS currency FROM symbols")
def _(d):
    return _symbols(d).select("c_custkey", sc.currency_of("symbol").alias("currency"))


_MARKETS_SQL = "(VALUES " + ", ".join(f"('{n}', '{tz}', {o}, {c})" for n, _, tz, o, c in sc.MARKETS) + ") AS m(exchange, timezone, o, c)"
register("market_events", f"""
SELECT event_id, e.exchange, timezone(m.timezone, timezone('UTC', ts)) AS local_ts, o, c
FROM (SELECT event_id, ts, list_extract({_SQL_LIST([m[0] for m in sc.MARKETS])}, CAST(user_id % {len(sc.MARKETS)} + 1 AS INTEGER)) AS exchange FROM events) e
JOIN {_MARKETS_SQL} ON e.exchange = m.exchange""")
_DAY_SECONDS = "epoch(local_ts - date_trunc('day', local_ts))"


def _market_events(d):
    e = d.raw("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"),
                               _pick([m[0] for m in sc.MARKETS], F.col("user_id")).alias("exchange"))
    return sc.market_local_time(e, "ts", "exchange", sc.market_table(d.spark))


@query("F08_market_open", f"SELECT event_id, isodow(local_ts) < 6 AND {_DAY_SECONDS} BETWEEN o * 60 AND c * 60 AS is_open FROM market_events")
def _(d):
    return _market_events(d).select("event_id", sc.is_open().alias("is_open"))


@query("F09_market_closed_today", f"SELECT event_id, isodow(local_ts) < 6 AND {_DAY_SECONDS} > c * 60 AS has_closed FROM market_events")
def _(d):
    return _market_events(d).select("event_id", sc.has_closed().alias("has_closed"))


_BACK = "d - CASE isodow(d) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END"
_NEXT = "(d + 1) + CASE isodow(d + 1) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END"


@query("F10_trading_days", f"""
SELECT event_id, {_BACK} AS last_trading_day, {_NEXT.replace('d + 1', 'CAST(local_ts AS DATE) + 1').replace('(d)', '(CAST(local_ts AS DATE))')} AS next_trading_day
FROM (SELECT *, CAST(local_ts AS DATE) - CASE WHEN isodow(local_ts) < 6 AND {_DAY_SECONDS} > c * 60 THEN 0 ELSE 1 END AS d FROM market_events)""")
def _(d):
    day = F.col("local_ts").cast("date")
    return _market_events(d).select("event_id", sc.last_trading_day(day, sc.has_closed()).alias("last_trading_day"),
                                    sc.next_trading_day(day).alias("next_trading_day"))


@query("F11_fetch_decision", f"""
WITH l AS (SELECT ticker, max(date) AS d FROM bars GROUP BY 1),
u AS (SELECT ticker, d AS last, {_NEXT} AS nxt, (SELECT as_of - CASE isodow(as_of) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END FROM as_of) AS upto FROM l)
SELECT ticker, last < upto AND nxt <= upto AS should_fetch, CASE WHEN last < upto AND nxt <= upto THEN nxt ELSE last END AS start_date,
       CASE WHEN last >= upto THEN 'up_to_date' WHEN nxt > upto THEN 'next_day_in_future' ELSE 'fetch' END AS reason FROM u""")
def _(d):
    last = d.bars.groupBy("ticker").agg(F.max("date").alias("last"))
    should, start, reason = sc.fetch_decision("last", sc.last_trading_day(d.last_bar_date, F.lit(True)))
    return last.select("ticker", should.alias("should_fetch"), start.alias("start_date"), reason.alias("reason"))


@query("F12_freshness_decision", """
SELECT ticker, reason <> 'fresh' AS should_fetch, reason FROM (
  SELECT ticker, CASE WHEN last_fetch_date IS NULL THEN 'never_fetched' WHEN as_of - last_fetch_date >= 30 THEN 'fetch_too_old'
    WHEN last_quarter_end IS NULL THEN 'no_quarters' WHEN as_of - last_quarter_end >= 100 THEN 'quarter_too_old'
    WHEN quarters_count < 4 THEN 'too_few_quarters' ELSE 'fresh' END AS reason FROM quarterly_metadata, as_of)""")
def _(d):
    should, reason = sc.freshness_decision("last_fetch_date", "last_quarter_end", "quarters_count", d.last_bar_date)
    return d.quarterly_metadata.select("ticker", should.alias("should_fetch"), reason.alias("reason"))


@query("F13_json_params", """
SELECT ticker, model_type, CAST(hyperparameters->>'max_depth' AS BIGINT) AS max_depth,
       '{"ticker":"' || ticker || '","model":"' || model_type || '"}' AS encoded FROM model_registry""")
def _(d):
    parsed = F.from_json("hyperparameters", "max_depth int, n_estimators int")
    encoded = F.to_json(F.struct("ticker", F.col("model_type").alias("model")))
    return d.model_registry.select("ticker", "model_type", parsed["max_depth"].alias("max_depth"), encoded.alias("encoded"))


@query("F14_feature_hash", "SELECT o_orderkey, sha256(least(o_orderpriority, o_orderstatus) || ',' || greatest(o_orderpriority, o_orderstatus)) AS hash FROM orders")
def _(d):
    return d.raw("orders").select("o_orderkey", sc.feature_hash(F.array("o_orderpriority", "o_orderstatus")).alias("hash"))


@query("F15_target_date", "SELECT date, ticker, date + CAST(floor((trade_Volume // 100) * 365 / 252) AS INTEGER) AS target FROM bars")
def _(d):
    return d.bars.select("date", "ticker", sc.target_date("date", F.col("trade_Volume") / 100).alias("target"))


@query("F16_cagr", """
SELECT ticker, pow(last / first, 1e0 / years) - 1 AS cagr FROM (
  SELECT ticker, arg_max(close_Price, date) AS last, arg_min(close_Price, date) AS first, (max(date) - min(date)) / 365.25e0 AS years FROM bars GROUP BY 1)""", "cagr")
def _(d):
    g = d.bars.groupBy("ticker").agg(F.max_by("close_Price", "date").alias("last"), F.min_by("close_Price", "date").alias("first"),
                                     (F.datediff(F.max("date"), F.min("date")) / F.lit(365.25)).alias("years"))
    return g.select("ticker", sc.cagr("last", "first", "years").alias("cagr"))


@query("F17_log_return", "SELECT date, ticker, ln(1 + ret) AS lr FROM numbered", "lr")
def _(d):
    c = F.col("close_Price")
    r = F.try_divide(c, F.lag(c).over(series())) - F.lit(1.0)
    return d.bars.select("date", "ticker", sc.log_return(r).alias("lr"))


@query("F18_clip_sign_round", f"SELECT event_id, {clip('value / 10', '-1e0', '1e0')} AS clipped, CAST(sign(value - 5) AS DOUBLE) AS sgn, round(value + 1e-9, 1) AS rounded FROM events", "clipped sgn rounded")
def _(d):
    v = F.col("value")
    return d.raw("events").select("event_id", sc.clip(v / 10, -1.0, 1.0).alias("clipped"), F.signum(v - 5).alias("sgn"),
                                  F.round(v + F.lit(1e-9), 1).alias("rounded"))


_COUNTRIES = [*sc.RISK_FREE_RATES, "Brazil", "Mexico"]


@query("F19_risk_free_rate", f"""
SELECT c_custkey, coalesce(CASE list_extract({_SQL_LIST(_COUNTRIES)}, CAST(c_nationkey % {len(_COUNTRIES)} + 1 AS INTEGER)) """
       + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in sc.RISK_FREE_RATES.items()) + " END, 0.04e0) AS rate FROM customer", "rate")
def _(d):
    return d.raw("customer").select("c_custkey", sc.risk_free_rate(_pick(_COUNTRIES, F.col("c_nationkey"))).alias("rate"))


@query("F20_error_class", """
SELECT event_id, CASE WHEN m LIKE '%invalid or not found%' OR m LIKE '%no data found%' OR m LIKE '%symbol may be delisted%'
         OR m LIKE '%404%' OR m LIKE '%not available%' OR m LIKE '%keyerror%'
  THEN CASE WHEN m LIKE '%delisted%' OR m LIKE '%not found%' THEN 'delisted' WHEN m LIKE '%no data%' THEN 'no_data' ELSE 'invalid' END END AS reason
FROM (SELECT event_id, lower(message) AS m FROM error_events)""")
def _(d):
    return d.error_events.select("event_id", sc.error_class("message").alias("reason"))


@query("F21_beta_label", """
SELECT s_suppkey, CASE WHEN b > 1.5e0 THEN 'high' WHEN b > 1 THEN 'above_market' WHEN b > 0.5e0 THEN 'defensive'
  WHEN b > 0 THEN 'very_defensive' ELSE 'negative' END AS label FROM (SELECT s_suppkey, s_acctbal / 4e3 AS b FROM supplier)""")
def _(d):
    return d.raw("supplier").select("s_suppkey", sc.beta_label(F.col("s_acctbal") / F.lit(4000.0)).alias("label"))
