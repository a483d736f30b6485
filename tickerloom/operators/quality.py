"""Data-quality checks.

Every check returns issue rows ``(ticker, table, issue, severity, value)``; ``all_issues``
style unions and the roll-ups work on those rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.scalar import error_class
from tickerloom.operators.joins import keep_first
from tickerloom.operators.ratios import RATIOS

# Thresholds and severities.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
STALE_DAYS, MIN_ROWS, ZERO_VOLUME, SPIKE, GAP_DAYS = 7, 100, 0.2, 0.40, 10
EXTREME_HIGH, EXTREME_LOW, LAG_DAYS, JUMP = 10000.0, -1000.0, 30, 3.0
WARM_UP = {"sma_200": 200, "rsi_14": 34}
WARM_UP_SLACK = 10
PRICES, INCOME, BALANCE, CASH = (
    "stock_price_data", "stock_income_stmt_data", "stock_balancesheet_data", "stock_cash_flow_data",
)
RATIO = "stock_ratio_data"
INCOME_Q, BALANCE_Q, CASH_Q = (
    "stock_income_stmt_quarterly", "stock_balancesheet_quarterly", "stock_cashflow_quarterly",
)
PRESENCE_SEVERITY = {
    PRICES: "HIGH", INCOME: "HIGH", BALANCE: "HIGH", CASH: "HIGH", RATIO: "HIGH",
    INCOME_Q: "MEDIUM", BALANCE_Q: "MEDIUM", CASH_Q: "MEDIUM",
}
MAX_ERRORS = 3


def issues(df: DataFrame, table, issue, severity, value, where: Column | None = None) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    df = df if where is None else df.where(where)
    return df.select(
        "ticker", lit(table).alias("table"), lit(issue).alias("issue"), lit(severity).alias("severity"),
        value.cast("double").alias("value"),
    )


def from_rules(df: DataFrame, table: str, rules) -> DataFrame:
    """Unpivot (issue, severity, value, condition) rules of one row per ticker into issues."""
    cells = F.array(
        *[
            F.struct(
                F.lit(table).alias("table"), F.lit(i).alias("issue"), F.lit(s).alias("severity"),
                v.cast("double").alias("value"), F.coalesce(cond, F.lit(False)).alias("_hit"),
            )
            for i, s, v, cond in rules
        ]
    )
    return df.select("ticker", F.inline(cells)).where("_hit").drop("_hit")


def union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def nulls(column: str) -> Column:
    return F.count_if(F.col(column).isNull())


# ---- Q1 .. Q14 -------------------------------------------------------------------------
def missing_info(info: DataFrame) -> DataFrame:
    blank = lambda c: F.col(c).isNull() | (F.col(c) == "")
    one = F.lit(1.0)
    return from_rules(info, "stock_info_data", [
        ("missing_company_name", "LOW", one, blank("company_Name")),
        ("missing_industry", "LOW", one, blank("industry")),
    ])


def absent_tickers(stocks: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(ticker, table) pairs without any row; ``tables`` maps names to tables."""
    wanted = stocks.select("ticker", F.explode(F.array(*[F.lit(t) for t in tables])).alias("table"))
    present = union([t.select("ticker").distinct().withColumn("table", F.lit(n)) for n, t in tables.items()])
    severity = F.element_at(F.create_map(*[F.lit(x) for kv in PRESENCE_SEVERITY.items() for x in kv]), F.col("table"))
    missing = wanted.join(present, ["ticker", "table"], "left_anti")
    return issues(missing, F.col("table"), "no_data", severity, F.lit(1.0))


def price_basics(bars: DataFrame, as_of: Column) -> DataFrame:
    stats = bars.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), F.max("date").alias("last"), F.min("close_Price").alias("low")
    ).withColumn("days", F.datediff(as_of, F.col("last")))
    return from_rules(stats, PRICES, [
        ("stale_price", "HIGH", F.col("days"), F.col("days") > STALE_DAYS),
        ("few_rows", "MEDIUM", F.col("n"), F.col("n") < MIN_ROWS),
        ("close_not_positive", "CRITICAL", F.col("low"), F.col("low") <= 0),
    ])


def null_prices(bars: DataFrame) -> DataFrame:
    cols = ("close_Price", "open_Price", "high_Price", "low_Price")
    n = bars.groupBy("ticker").agg(reduce(lambda a, b: a + b, [nulls(c) for c in cols]).alias("n"))
    return issues(n, PRICES, "null_ohlc", "HIGH", F.col("n"), F.col("n") > 0)


def inverted_range(bars: DataFrame) -> DataFrame:
    n = bars.where("high_Price < low_Price").groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    return issues(n, PRICES, "high_below_low", "CRITICAL", F.col("n"))


def zero_volume(bars: DataFrame) -> DataFrame:
    v = F.col("trade_Volume")
    share = F.count_if(v.isNull() | (v == 0)) / F.count(F.lit(1))
    n = bars.groupBy("ticker").agg(share.alias("p"))
    return issues(n, PRICES, "zero_volume", "MEDIUM", F.col("p") * 100, F.col("p") > ZERO_VOLUME)


def indicator_nulls(indicators: DataFrame) -> DataFrame:
    n = indicators.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), *[nulls(c).alias(c) for c in WARM_UP])
    rules = []
    for c, rows in WARM_UP.items():
        excess = F.col(c) - F.least(F.lit(rows), F.col("n"))
        rules.append((f"excess_null_{c}", "MEDIUM", excess, excess > WARM_UP_SLACK))
    return from_rules(n, PRICES, rules)


def _moves(bars: DataFrame) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("date")
    prev = F.lag("close_Price").over(w)
    return bars.select("ticker", "date", "close_Price", prev.alias("_prev"), F.lag("date").over(w).alias("_prev_date"))


def price_spikes(bars: DataFrame, limit: float = SPIKE) -> DataFrame:
    m = _moves(bars).where("_prev > 0").withColumn("p", F.abs(F.col("close_Price") - F.col("_prev")) / F.col("_prev"))
    return issues(m, PRICES, "price_spike", "CRITICAL", F.col("p") * 100, F.col("p") > limit)


def date_gaps(bars: DataFrame, days: int = GAP_DAYS) -> DataFrame:
    m = _moves(bars).withColumn("g", F.datediff("date", "_prev_date"))
    return issues(m, PRICES, "date_gap", "MEDIUM", F.col("g"), F.col("g") > days)


def statement_nulls(income: DataFrame, balance: DataFrame, cash: DataFrame) -> DataFrame:
    def part(df, table, spec, few=False):
        n = df.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), *[nulls(c).alias(c) for c, _ in spec])
        rules = [(f"null_{c}", s, F.col(c), F.col(c) > 0) for c, s in spec]
        if few:
            rules.append(("few_records", "LOW", F.col("n"), F.col("n") < 3))
        return from_rules(n, table, rules)

    return union([
        part(income, INCOME, [("revenue", "HIGH"), ("eps", "MEDIUM"), ("average_shares", "MEDIUM")], True),
        part(balance, BALANCE, [("total_Assets", "HIGH"), ("book_Value_Per_Share", "MEDIUM")]),
        part(cash, CASH, [("free_Cash_Flow", "MEDIUM"), ("free_Cash_Flow_Per_Share", "MEDIUM")]),
    ])


def ratio_issues(ratios: DataFrame) -> DataFrame:
    n = ratios.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), nulls("financial_date_used").alias("nd"),
        *[nulls(r).alias(f"n_{r}") for r in RATIOS],
        *[F.min(r).alias(f"lo_{r}") for r in RATIOS], *[F.max(r).alias(f"hi_{r}") for r in RATIOS],
    )
    total = F.col("n")
    every = reduce(lambda a, b: a & b, [F.col(f"n_{r}") == total for r in RATIOS])
    rules = [("all_ratios_null", "CRITICAL", total, every)]
    for r in RATIOS:
        pct = F.col(f"n_{r}") * F.lit(100.0) / total
        rules += [
            (f"mostly_null_{r}", "HIGH", pct, ~every & (pct > 50)),
            (f"extreme_high_{r}", "MEDIUM", F.col(f"hi_{r}"), F.col(f"hi_{r}") > EXTREME_HIGH),
            (f"extreme_low_{r}", "MEDIUM", F.col(f"lo_{r}"), F.col(f"lo_{r}") < EXTREME_LOW),
        ]
    rules.append(("null_financial_date", "MEDIUM", F.col("nd"), F.col("nd") > 0))
    return from_rules(n, RATIO, rules)


def quarterly_issues(income: DataFrame, cash: DataFrame) -> DataFrame:
    i = income.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), nulls("revenue_ttm").alias("nr"))
    excess = F.greatest(F.lit(0), F.col("nr") - F.least(F.lit(3), F.col("n")))
    c = cash.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    return union([
        from_rules(i, INCOME_Q, [
            ("few_quarters", "MEDIUM", F.col("n"), F.col("n") < 4),
            ("unexpected_null_revenue_ttm", "HIGH", excess, excess > 0),
        ]),
        from_rules(c, CASH_Q, [("few_quarters", "MEDIUM", F.col("n"), F.col("n") < 4)]),
    ])


def ratio_lag(ratios: DataFrame, bars: DataFrame) -> DataFrame:
    r = ratios.groupBy("ticker").agg(F.max("date").alias("r"))
    p = bars.groupBy("ticker").agg(F.max("date").alias("p"))
    j = r.join(p, "ticker").withColumn("g", F.datediff("p", "r"))
    return issues(j, "cross-table", "ratios_lag_prices", "HIGH", F.col("g"), F.col("g") > LAG_DAYS)


def period_mismatch(income: DataFrame, balance: DataFrame, cash: DataFrame, period: str) -> DataFrame:
    n = lambda df, name: df.groupBy("ticker").agg(F.countDistinct(period).alias(name))
    j = (
        n(income, "i").join(n(balance, "b"), "ticker", "left").join(n(cash, "c"), "ticker", "left")
        .na.fill(0, ["b", "c"])
    )
    off = (F.col("i") != F.col("b")) | (F.col("b") != F.col("c"))
    return issues(j, "cross-table", "period_mismatch", "MEDIUM", F.col("i"), off)


# ---- roll-ups --------------------------------------------------------------------------
def severity_rank() -> Column:
    pairs = [x for i, s in enumerate(SEVERITIES) for x in (F.lit(s), F.lit(i))]
    return F.element_at(F.create_map(*pairs), F.col("severity"))


def severity_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("ticker").alias("tickers")
    )


def category_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity", "table", "issue").agg(F.count(F.lit(1)).alias("n"))


def worst_by_ticker(found: DataFrame) -> DataFrame:
    """Issue count and worst severity per ticker, worst first."""
    names = F.array(*[F.lit(s) for s in SEVERITIES])
    return (
        found.groupBy("ticker")
        .agg(F.count(F.lit(1)).alias("n"), F.min(severity_rank()).alias("_s"))
        .orderBy("_s", F.col("n").desc(), "ticker")
        .select("ticker", "n", F.get(names, F.col("_s")).alias("worst"))
    )


# ---- gates and repairs -----------------------------------------------------------------
def continuity_gate(bars: DataFrame, limit: float = JUMP) -> DataFrame:
    """Bars of tickers without any day-over-day jump above ``limit``."""
    bad = price_spikes(bars, limit).select("ticker").distinct()
    return bars.join(bad, "ticker", "left_anti")


def null_share_warnings(ratios: DataFrame, limit: float = 80.0) -> DataFrame:
    n = ratios.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n"), *[nulls(r).alias(r) for r in RATIOS])
    pct = {r: F.col(r) * F.lit(100.0) / F.col("n") for r in RATIOS}
    return from_rules(n, RATIO, [(f"null_{r}", "MEDIUM", p, p > limit) for r, p in pct.items()])


def duplicate_rows(df: DataFrame, keys=("date", "ticker")) -> DataFrame:
    """All copies of keys that occur more than once.

    Keys are counted with map-side combination and joined back, so many copies of one key
    never meet in one task.
    """
    keys = list(keys)
    many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return df.join(many, keys)


def without_duplicates(df: DataFrame, keys=("date", "ticker"), precedence=()) -> DataFrame:
    return keep_first(df, list(keys), list(precedence))


def orphans(child: DataFrame, parent: DataFrame, key: str = "ticker") -> DataFrame:
    """Child keys without a parent row, with their row count."""
    lost = child.join(parent.select(key), key, "left_anti")
    return lost.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))


def zscore_outliers(df: DataFrame, value: str, limit: float = 3.0) -> DataFrame:
    stats = df.groupBy("ticker").agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    z = F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))
    return df.join(stats, "ticker").withColumn("z", z).where(F.abs("z") > limit).drop("_m", "_s")


def feature_validation(df: DataFrame, critical, optional) -> DataFrame:
    """One row per expected feature: presence, null share, share of infinities."""
    expected = [*critical, *optional]
    have = [c for c in expected if c in df.columns]
    inf = lambda c: F.count_if(F.abs(F.col(f"`{c}`").cast("double")) == F.lit(float("inf")))
    one = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(f"`{c}`").alias(f"n_{c}") for c in have],
        *[inf(c).alias(f"i_{c}") for c in have],
    )
    cells = []
    for c in expected:
        found = c in have
        cells.append(F.struct(
            F.lit(c).alias("feature"),
            F.lit("critical" if c in critical else "optional").alias("kind"),
            F.lit(found).alias("present"),
            (F.try_divide((F.col("_rows") - F.col(f"`n_{c}`")) * F.lit(100.0), F.col("_rows")) if found else F.lit(None).cast("double")).alias("null_pct"),
            (F.try_divide(F.col(f"`i_{c}`") * F.lit(100.0), F.col(f"`n_{c}`")) if found else F.lit(None).cast("double")).alias("inf_pct"),
        ))
    return one.select(F.inline(F.array(*cells)))


def ratio_recommendations(stocks: DataFrame, ratios: DataFrame) -> DataFrame:
    n = ratios.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), *[nulls(r).alias(r) for r in RATIOS])
    j = stocks.select("ticker").join(n, "ticker", "left")
    rules = [("no_ratio_data", "HIGH", F.lit(1.0), F.col("n").isNull())]
    for r in RATIOS:
        share = F.col(r) / F.col("n")
        rules.append((f"mostly_null_{r}", "MEDIUM", share, share > 0.5))
    return from_rules(j, RATIO, rules)


def data_health(rows: DataFrame, features: int, target: str = "y") -> DataFrame:
    """Sample-size and target-variance findings per ticker over labelled splits."""
    part = lambda s: F.col("split") == s
    var = lambda s: F.var_pop(F.when(part(s), F.col(target)))
    g = rows.groupBy("ticker").agg(
        F.count_if(part("train")).alias("n_train"), F.count_if(part("val")).alias("n_val"),
        var("train").alias("v1"), var("val").alias("v2"), var("test").alias("v3"),
        F.avg(F.when(part("train"), F.abs(F.col(target)))).alias("scale"),
    )
    per = F.col("n_train") / F.lit(float(max(features, 1)))
    val = F.try_divide(F.col("n_val"), F.col("n_train"))
    vs = ["v1", "v2", "v3"]
    spread = F.greatest(*vs) / (F.least(*vs) + F.lit(1e-10))
    return from_rules(g, "dataset", [
        ("few_samples_per_feature", "HIGH", per, per < 10),
        ("unusual_validation_size", "MEDIUM", val, (val < 0.1) | (val > 0.4)),
        ("variance_mismatch", "MEDIUM", spread, spread > 10),
        ("tiny_target", "LOW", F.col("scale"), F.col("scale") < 1e-6),
    ])


def indicator_consistency(raw: DataFrame) -> DataFrame:
    """Per ticker, on unlagged indicators: rows where the mean strays from the price by
    more than half, and rows where the band is not four deviations."""
    far = F.abs(F.col("sma_20") - F.col("close_Price")) > F.col("close_Price") * F.lit(0.5)
    off = F.abs(F.col("bollinger_Band_20_2STD") - F.lit(4.0) * F.col("std_Div_20")) > 1e-6
    return raw.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("rows"), F.count("sma_20").alias("with_sma"),
        F.count_if(far).alias("far_from_price"), F.count_if(off).alias("band_mismatch"),
    )


def table_ranges(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows, first and last date per ticker and table."""
    return union([
        t.groupBy("ticker").agg(
            F.lit(n).alias("table"), F.count(F.lit(1)).alias("rows"), F.min(d).alias("first"), F.max(d).alias("last"))
        for n, (t, d) in tables.items()
    ])


def stale_tickers(bars: DataFrame, blacklist: DataFrame, as_of: Column, days: int = STALE_DAYS) -> DataFrame:
    last = bars.groupBy("ticker").agg(F.max("date").alias("last_date")).withColumn(
        "days_stale", F.datediff(as_of, F.col("last_date")))
    return last.where(F.col("days_stale") > days).join(blacklist.select("ticker"), "ticker", "left_anti")


def error_triage(events: DataFrame, max_errors: int = MAX_ERRORS) -> DataFrame:
    """Tickers to blacklist: a fatal message, or too many errors of any kind."""
    kind = error_class("message")
    g = events.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("errors"),
        F.min_by(kind, F.when(kind.isNotNull(), F.struct("ts", "event_id"))).alias("_fatal"),
    )
    many = F.col("errors") >= max_errors
    return g.where(many | F.col("_fatal").isNotNull()).select(
        "ticker", F.when(many, "error").otherwise(F.col("_fatal")).alias("reason"), "errors")


def blacklist_summary(blacklist: DataFrame) -> DataFrame:
    """Totals as rows (measure, n): all, active, inactive and active per reason."""
    active = F.col("active")
    totals = {"total": F.count(F.lit(1)), "active": F.count_if(active), "inactive": F.count_if(~active)}
    one = blacklist.agg(*[v.alias(k) for k, v in totals.items()])
    cells = F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("n")) for k in totals])
    reasons = blacklist.where(active).groupBy(F.concat(F.lit("reason:"), F.col("reason")).alias("measure")).agg(
        F.count(F.lit(1)).alias("n"))
    return one.select(F.inline(cells)).unionByName(reasons)
