"""Scalar building blocks: divisions, growth, calendars, symbols, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.windows import as_col

# Fixed values -------------------------------------------------------------------------
RATIO_EPSILON = 0.01
RATIO_MIN, RATIO_MAX = -1000.0, 10000.0
DEFAULT_RISK_FREE_RATE = 0.04

MARKET_COLUMNS = "exchange string, suffix string, timezone string, open_minute int, close_minute int"
MARKETS = [
    ("us", "", "America/New_York", 570, 960),
    ("copenhagen", ".CO", "Europe/Copenhagen", 540, 1020),
    ("stockholm", ".ST", "Europe/Stockholm", 540, 1050),
    ("helsinki", ".HE", "Europe/Helsinki", 600, 1110),
    ("oslo", ".OL", "Europe/Oslo", 540, 980),
    ("frankfurt", ".DE", "Europe/Berlin", 540, 1050),
    ("paris", ".PA", "Europe/Paris", 540, 1050),
    ("london", ".L", "Europe/London", 480, 990),
    ("amsterdam", ".AS", "Europe/Amsterdam", 540, 1050),
    ("madrid", ".MC", "Europe/Madrid", 540, 1050),
    ("milan", ".MI", "Europe/Rome", 540, 1050),
    ("zurich", ".SW", "Europe/Zurich", 540, 1050),
]
CURRENCIES = {
    ".CO": "DKK", ".ST": "SEK", ".HE": "EUR", ".OL": "NOK", ".L": "GBp", ".PA": "EUR",
    ".DE": "EUR", ".AS": "EUR", ".MI": "EUR", ".MC": "EUR", ".BR": "EUR", ".VI": "EUR",
    ".SW": "CHF", ".TO": "CAD", ".AX": "AUD", ".HK": "HKD", ".T": "JPY", ".NS": "INR",
    ".BO": "INR",
}
EXCHANGE_SUFFIXES = {
    "copenhagen": ".CO", "stockholm": ".ST", "helsinki": ".HE", "oslo": ".OL",
    "frankfurt": ".DE", "xetra": ".DE", "paris": ".PA", "london": ".L", "amsterdam": ".AS",
    "madrid": ".MC", "milan": ".MI", "zurich": ".SW", "brussels": ".BR", "vienna": ".VI",
    "lisbon": ".LS", "dublin": ".IR", "warsaw": ".WA", "prague": ".PR",
    "us": "", "nyse": "", "nasdaq": "",
}
RISK_FREE_RATES = {
    "Denmark": 0.028, "United States": 0.043, "Germany": 0.025, "France": 0.031,
    "United Kingdom": 0.041, "Sweden": 0.027, "Norway": 0.035, "Finland": 0.030,
    "Netherlands": 0.027, "Switzerland": 0.008, "Spain": 0.033, "Italy": 0.038,
    "Belgium": 0.030, "Austria": 0.029, "Portugal": 0.031, "Japan": 0.010,
    "Australia": 0.042, "Canada": 0.034,
}
MARKET_INDICES = (
    "^VIX", "^GSPC", "^IXIC", "^DJI", "^STOXX50E", "^FTSE", "^GDAXI", "^FCHI",
)
FATAL_MESSAGES = (
    "invalid or not found", "no data found", "symbol may be delisted", "404",
    "not available", "keyerror",
)
# --------------------------------------------------------------------------------------


def safe_divide(num, den, eps: float = RATIO_EPSILON) -> Column:
    """NULL where either side is NULL or the denominator is closer to zero than ``eps``."""
    num, den = as_col(num), as_col(den)
    return F.when(F.abs(den) >= eps, F.try_divide(num, den))


def safe_ratio(num, den, eps: float = RATIO_EPSILON, low=RATIO_MIN, high=RATIO_MAX) -> Column:
    """``safe_divide`` that also hides values outside [low, high]."""
    value = safe_divide(num, den, eps)
    return F.when(value.between(low, high), value)


def growth(cur, prev) -> Column:
    return F.try_divide(as_col(cur), as_col(prev)) - F.lit(1.0)


def growth_abs(cur, prev) -> Column:
    """Change relative to the magnitude of the earlier value."""
    cur, prev = as_col(cur), as_col(prev)
    return safe_divide(cur - prev, F.abs(prev))


def finite(x) -> Column:
    """NULL for NaN and infinities."""
    x = as_col(x)
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(~bad, x)


def to_number(x) -> Column:
    """Text to double, unparsable text to NULL."""
    return as_col(x).try_cast("double")


def clip(x, low: float, high: float) -> Column:
    x = as_col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def log_return(r) -> Column:
    return F.log1p(as_col(r))


def cagr(value, start, years) -> Column:
    """Annualised growth; NULL where the start is not positive or no time has passed."""
    value, start, years = as_col(value), as_col(start), as_col(years)
    ok = (start > 0) & (value >= 0) & (years > 0)
    return F.when(ok, F.pow(value / start, F.lit(1.0) / years) - F.lit(1.0))


def target_date(day, horizon) -> Column:
    """Calendar date of a horizon counted in trading days (252 per 365 days)."""
    return F.date_add(as_col(day), F.floor(as_col(horizon) * 365 / 252).cast("int"))


def feature_hash(features) -> Column:
    """SHA-256 of the sorted, comma-joined feature names."""
    return F.sha2(F.array_join(F.array_sort(as_col(features)), ","), 256)


# ---- symbols ---------------------------------------------------------------------------
def _suffix_case(symbol: Column, table: dict[str, str], default: Column) -> Column:
    """First suffix of ``table`` that ends ``symbol``; longer suffixes are tried first."""
    chain = None
    for suffix in sorted(table, key=lambda s: (-len(s), s)):
        if suffix:
            value = F.lit(table[suffix])
            hit = symbol.endswith(suffix)
            chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain.otherwise(default)


def exchange_of(ticker) -> Column:
    symbol = F.upper(as_col(ticker))
    table = {suffix: name for name, suffix, *_ in MARKETS}
    return F.when(symbol.startswith("^"), "us").otherwise(
        _suffix_case(symbol, table, F.lit("us"))
    )


def currency_of(ticker) -> Column:
    return _suffix_case(as_col(ticker), CURRENCIES, F.lit("USD"))


def clean_symbol(symbol, exchange) -> Column:
    """Trim and upper-case; spaces inside the base become ``-``; add a missing suffix."""
    s = F.upper(F.trim(as_col(symbol)))
    known = sorted({v for v in EXCHANGE_SUFFIXES.values() if v})
    present = _suffix_case(s, {v: v for v in known}, F.lit(""))
    base = F.substring(s, F.lit(1), F.length(s) - F.length(present))
    pairs = [F.lit(x) for kv in EXCHANGE_SUFFIXES.items() for x in kv]
    own = F.coalesce(F.element_at(F.create_map(*pairs), F.lower(as_col(exchange))), F.lit(""))
    cleaned = F.when(
        present != "", F.concat(F.replace(F.trim(base), F.lit(" "), F.lit("-")), present)
    ).otherwise(F.concat(F.replace(s, F.lit(" "), F.lit("-")), own))
    return F.when(s == "", F.lit("")).otherwise(cleaned)


def is_index(ticker, industry=None) -> Column:
    t = as_col(ticker)
    flag = t.startswith("^") | t.isin(*MARKET_INDICES)
    if industry is not None:
        flag = flag | F.coalesce(as_col(industry) == "Index", F.lit(False))
    return flag


def risk_free_rate(country) -> Column:
    pairs = [F.lit(x) for kv in RISK_FREE_RATES.items() for x in kv]
    rates = F.create_map(*pairs)
    return F.coalesce(F.element_at(rates, as_col(country)), F.lit(DEFAULT_RISK_FREE_RATE))


def error_class(message) -> Column:
    """Reason for an error text that calls for blacklisting at once, else NULL."""
    m = F.lower(as_col(message))
    fatal = F.lit(False)
    for text in FATAL_MESSAGES:
        fatal = fatal | m.contains(text)
    kind = (
        F.when(m.contains("delisted") | m.contains("not found"), "delisted")
        .when(m.contains("no data"), "no_data")
        .otherwise("invalid")
    )
    return F.when(fatal, kind)


def beta_label(beta) -> Column:
    b = as_col(beta)
    return (
        F.when(b.isNull(), None)
        .when(b > 1.5, "high")
        .when(b > 1.0, "above_market")
        .when(b > 0.5, "defensive")
        .when(b > 0, "very_defensive")
        .otherwise("negative")
    )


# ---- calendars -------------------------------------------------------------------------
def _minute_of_day(ts: Column) -> Column:
    return (F.hour(ts) * 60 + F.minute(ts)).cast("int")


def _second_of_day(ts: Column) -> Column:
    """Seconds since local midnight, with their fraction."""
    return _minute_of_day(ts) * 60 + F.extract(F.lit("SECOND"), ts).cast("double")


def is_weekend(day) -> Column:
    return F.weekday(as_col(day)) >= 5


def market_local_time(df: DataFrame, ts: str, exchange: str, markets: DataFrame) -> DataFrame:
    """Add the market row of ``exchange`` (unknown ones count as ``us``) and local time.

    ``markets`` is the 12-row market table; timestamps are UTC.
    """
    known = [m[0] for m in MARKETS]
    key = F.when(F.col(exchange).isin(*known), F.col(exchange)).otherwise("us")
    m = markets.withColumnRenamed("exchange", "_exchange")
    return (
        df.withColumn("_exchange", key)
        .join(m, "_exchange")
        .withColumn("local_ts", F.from_utc_timestamp(ts, F.col("timezone")))
        .drop("_exchange", "suffix", "timezone")
    )


def market_table(spark) -> DataFrame:
    return spark.createDataFrame(MARKETS, MARKET_COLUMNS)


def is_open() -> Column:
    """Market open at ``local_ts`` (weekdays, opening to closing minute inclusive)."""
    now = _second_of_day(F.col("local_ts"))
    return ~is_weekend("local_ts") & now.between(F.col("open_minute") * 60, F.col("close_minute") * 60)


def has_closed() -> Column:
    """Market opened and closed on the local day of ``local_ts``."""
    return ~is_weekend("local_ts") & (_second_of_day(F.col("local_ts")) > F.col("close_minute") * 60)


def back_to_weekday(day) -> Column:
    d = as_col(day)
    return F.date_sub(d, F.greatest(F.weekday(d) - 4, F.lit(0)))


def next_trading_day(day) -> Column:
    d = F.date_add(as_col(day), 1)
    wd = F.weekday(d)
    return F.date_add(d, F.when(wd >= 5, 7 - wd).otherwise(0))


def last_trading_day(day, closed) -> Column:
    """Newest day with complete data: ``day`` itself only if its market has closed."""
    d = as_col(day)
    return back_to_weekday(F.when(closed, d).otherwise(F.date_sub(d, 1)))


def fetch_decision(last_date, last_trading) -> tuple[Column, Column, Column]:
    """(should fetch, start date, reason) for the newest stored date of a ticker."""
    last, upto = as_col(last_date), as_col(last_trading)
    nxt = next_trading_day(last)
    should = (last < upto) & (nxt <= upto)
    reason = (
        F.when(last >= upto, "up_to_date").when(nxt > upto, "next_day_in_future").otherwise("fetch")
    )
    return should, F.when(should, nxt).otherwise(last), reason


def freshness_decision(
    last_fetch, last_quarter, quarters, as_of, max_fetch_days=30, max_quarter_days=100, min_quarters=4
) -> tuple[Column, Column]:
    """(should fetch, reason) for quarterly reports; the first matching rule wins."""
    f, q, n, now = (as_col(x) for x in (last_fetch, last_quarter, quarters, as_of))
    reason = (
        F.when(f.isNull(), "never_fetched")
        .when(F.datediff(now, f) >= max_fetch_days, "fetch_too_old")
        .when(q.isNull(), "no_quarters")
        .when(F.datediff(now, q) >= max_quarter_days, "quarter_too_old")
        .when(n < min_quarters, "too_few_quarters")
        .otherwise("fresh")
    )
    return reason != "fresh", reason
