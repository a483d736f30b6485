"""Annual and quarterly statement metrics, trailing-twelve-month sums, source choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.scalar import growth, growth_abs, safe_divide
from tickerloom.functions.windows import forward_fill, series
from tickerloom.operators.joins import keep_first

QUARTER = "fiscal_quarter_end"
YEAR = "financial_Statement_Date"
QUARTERS = 4

INCOME_FLOWS = ("revenue_q", "gross_profit_q", "operating_income_q", "net_income_q")
CASH_FLOWS = ("operating_cash_flow_q", "capex_q", "free_cash_flow_q", "dividends_paid_q")


def _ttm(name: str) -> str:
    return name[: -len("_q")] + "_ttm"


def by_period(period: str):
    return Window.partitionBy("ticker").orderBy(period)


def one_a_period(statements: DataFrame, period: str) -> DataFrame:
    """One statement of each ticker and period: where they repeat, an as-of join takes any one."""
    return keep_first(statements, ["ticker", period], [F.col(period)])


# ---- quarterly -------------------------------------------------------------------------
def ttm_strict(quarters: DataFrame, flows=INCOME_FLOWS) -> DataFrame:
    """Sum of four rows from the fourth row on; a NULL quarter counts as zero."""
    w = by_period(QUARTER)
    last4 = w.rowsBetween(-(QUARTERS - 1), 0)
    sums = {_ttm(c): F.sum(F.coalesce(F.col(c), F.lit(0.0))).over(last4) for c in flows}
    return quarters.withColumns({**sums, "_rn": F.row_number().over(w)}).where(
        F.col("_rn") >= QUARTERS
    ).drop("_rn")


def ttm_tolerant(quarters: DataFrame, flows=INCOME_FLOWS, with_growth: bool = True) -> DataFrame:
    """Sum of the last four rows if at least three are known, scaled to a full year.

    Tickers with fewer than four quarters get no values at all.
    """
    w = by_period(QUARTER)
    last4 = w.rowsBetween(-(QUARTERS - 1), 0)
    cols: dict[str, Column] = {"_n": F.count(F.lit(1)).over(Window.partitionBy("ticker"))}
    for c in flows:
        known = F.count(c).over(last4)
        cols[_ttm(c)] = F.when(known >= 3, F.sum(c).over(last4) * (F.lit(4.0) / known))
    if with_growth:
        cols["revenue_growth_qoq"] = growth(F.col("revenue_q"), F.lag("revenue_q").over(w))
        cols["net_income_growth_qoq"] = growth(F.col("net_income_q"), F.lag("net_income_q").over(w))
    df = quarters.withColumns(cols)
    if with_growth:
        df = df.withColumns(
            {
                f"{m}_growth_yoy": growth(F.col(f"{m}_ttm"), F.lag(f"{m}_ttm", QUARTERS).over(w))
                for m in ("revenue", "net_income")
            }
        )
    enough = F.col("_n") >= QUARTERS
    new = [c for c in df.columns if c not in quarters.columns and c != "_n"]
    return df.select(*quarters.columns, *[F.when(enough, F.col(c)).alias(c) for c in new])


def ttm_ratios(income_ttm: DataFrame, balance: DataFrame, cash_ttm: DataFrame) -> DataFrame:
    """Margins, returns, leverage and per-share values per quarter.

    Quarters present in both income and balance; cash flow is optional.
    """
    keys = ["ticker", QUARTER]
    joined = (
        income_ttm.select(
            *keys, "revenue_ttm", "gross_profit_ttm", "operating_income_ttm", "net_income_ttm",
            "shares_diluted",
        )
        .join(balance, keys)
        .join(cash_ttm.select(*keys, "free_cash_flow_ttm"), keys, "left")
    )
    out = joined.select(
        *keys,
        safe_divide("gross_profit_ttm", "revenue_ttm").alias("gross_margin_ttm"),
        safe_divide("operating_income_ttm", "revenue_ttm").alias("operating_margin_ttm"),
        safe_divide("net_income_ttm", "revenue_ttm").alias("net_margin_ttm"),
        safe_divide("net_income_ttm", "total_assets").alias("roa_ttm"),
        safe_divide("net_income_ttm", "total_equity").alias("roe_ttm"),
        safe_divide("total_liabilities", "total_equity").alias("debt_to_equity"),
        safe_divide("current_assets", "current_liabilities").alias("current_ratio"),
        safe_divide(F.col("current_assets") - F.col("inventory"), "current_liabilities").alias(
            "quick_ratio"
        ),
        safe_divide("total_equity", "shares_diluted").alias("book_value_per_share"),
        safe_divide("net_income_ttm", "shares_diluted").alias("eps_ttm"),
        safe_divide("free_cash_flow_ttm", "shares_diluted").alias("fcf_per_share"),
        "revenue_ttm",
        "net_income_ttm",
        "total_assets",
        "total_equity",
        "shares_diluted",
    )
    w = by_period(QUARTER)
    enough = F.count(F.lit(1)).over(Window.partitionBy("ticker")) >= QUARTERS
    return out.withColumns(
        {
            name: F.when(enough, growth(F.col(src), F.lag(src, QUARTERS).over(w)))
            for name, src in (
                ("revenue_growth_yoy", "revenue_ttm"),
                ("net_income_growth_yoy", "net_income_ttm"),
                ("assets_growth_yoy", "total_assets"),
            )
        }
    )


def quarterly_metrics(income: DataFrame, balance: DataFrame, cash: DataFrame) -> DataFrame:
    """The quarterly schema's derived columns, from tolerant TTM sums."""
    keys = ["ticker", QUARTER]
    inc = ttm_tolerant(income, with_growth=False)
    cfs = ttm_tolerant(cash, CASH_FLOWS, with_growth=False)
    j = inc.join(balance, keys, "left").join(cfs, keys, "left")
    shares = F.col("shares_diluted")
    out = j.select(
        *keys,
        safe_divide("gross_profit_ttm", "revenue_ttm").alias("gross_margin_ttm"),
        safe_divide("operating_income_ttm", "revenue_ttm").alias("operating_margin_ttm"),
        safe_divide("net_income_ttm", "revenue_ttm").alias("net_margin_ttm"),
        safe_divide("net_income_ttm", shares).alias("eps_diluted_ttm"),
        safe_divide("cash_and_equivalents", "current_liabilities").alias("cash_ratio"),
        safe_divide("total_debt", "total_assets").alias("debt_to_assets"),
        safe_divide("total_equity", shares).alias("book_value_per_share"),
        safe_divide("net_income_ttm", F.col("total_equity") + F.col("total_debt")).alias("roic_ttm"),
        safe_divide("free_cash_flow_ttm", shares).alias("fcf_per_share_ttm"),
        safe_divide("operating_cash_flow_ttm", shares).alias("ocf_per_share_ttm"),
        safe_divide("free_cash_flow_ttm", "revenue_ttm").alias("fcf_margin_ttm"),
        safe_divide("capex_ttm", "revenue_ttm").alias("capex_to_revenue_ttm"),
        safe_divide("free_cash_flow_ttm", "net_income_ttm").alias("fcf_conversion_ttm"),
        "free_cash_flow_ttm",
        "operating_cash_flow_ttm",
    )
    w = by_period(QUARTER)
    yoy = {
        "eps_growth_yoy": "eps_diluted_ttm",
        "book_value_growth_yoy": "book_value_per_share",
        "fcf_growth_yoy": "free_cash_flow_ttm",
        "ocf_growth_yoy": "operating_cash_flow_ttm",
    }
    return out.withColumns(
        {k: growth_abs(F.col(c), F.lag(c, QUARTERS).over(w)) for k, c in yoy.items()}
    )


def cash_flow_proxy(cash_ttm: DataFrame, cash_annual: DataFrame) -> DataFrame:
    """Annual free cash flow stands in for tickers without any quarterly cash flow."""
    annual = cash_annual.join(cash_ttm.select("ticker").distinct(), "ticker", "left_anti")
    return cash_ttm.select(
        "ticker", F.col(QUARTER).alias("date"), "free_cash_flow_ttm", F.lit("quarterly").alias("source")
    ).unionByName(
        annual.select(
            "ticker",
            F.col(YEAR).alias("date"),
            F.col("free_Cash_Flow").alias("free_cash_flow_ttm"),
            F.lit("annual").alias("source"),
        )
    )


# ---- annual ----------------------------------------------------------------------------
def filled(statements: DataFrame, columns, period: str = YEAR) -> DataFrame:
    """Carry the last known value of each column forward within a ticker."""
    w = series(("ticker",), (period,))
    return statements.withColumns({c: forward_fill(c, w) for c in columns})


def with_growth(df: DataFrame, columns, period: str = YEAR) -> DataFrame:
    w = by_period(period)
    return df.withColumns({f"{c}_Growth": growth(F.col(c), F.lag(c).over(w)) for c in columns})


INCOME_GROWTH = (
    "revenue", "gross_Profit", "gross_Margin", "operating_Earning", "operating_Earning_Margin",
    "net_Income", "net_Income_Margin", "eps",
)
BALANCE_GROWTH = (
    "total_Assets", "current_Assets", "cash_And_Cash_Equivalents", "equity", "liabilities",
    "current_liabilities", "book_Value", "book_Value_Per_Share", "return_On_Assets",
    "return_On_Equity", "return_On_Invested_Capital", "current_Ratio", "quick_Ratio",
    "debt_To_Equity",
)
CASH_GROWTH = ("free_Cash_Flow", "free_Cash_Flow_Per_Share")


def annual_income(income: DataFrame) -> DataFrame:
    per = lambda a, b: F.try_divide(F.col(a), F.col(b))
    base = income.select(
        "ticker",
        YEAR,
        "revenue",
        "gross_Profit",
        per("gross_Profit", "revenue").alias("gross_Margin"),
        "operating_Earning",
        per("operating_Earning", "revenue").alias("operating_Earning_Margin"),
        "net_Income",
        per("net_Income", "revenue").alias("net_Income_Margin"),
        per("net_Income", "average_shares").alias("eps"),
        "average_shares",
    )
    return with_growth(base, INCOME_GROWTH)


# Phrases that mark an industry of the financial sector.
FINANCIAL_PHRASES = (
    "banks", "insurance", "capital markets", "financial services",
    "asset management", "diversified financial", "specialty finance",
    "investment banking", "brokerage", "credit services",
    "financial data", "financial exchange",
)


def financial_sector(industry: Column | str) -> Column:
    """The industry's name holds one of the phrases, in any case; NULL is no financial industry."""
    name = F.lower(F.col(industry) if isinstance(industry, str) else industry)
    return F.coalesce(name.rlike("|".join(FINANCIAL_PHRASES)), F.lit(False))


def annual_balance(balance: DataFrame, income: DataFrame, financial: Column | None = None) -> DataFrame:
    """Balance metrics; ``financial`` marks tickers whose cash replaces current assets."""
    keys = ["ticker", YEAR]
    j = balance.join(income.select(*keys, "net_Income", "average_shares"), keys)
    if financial is not None:
        j = j.withColumn(
            "current_Assets",
            F.when(financial, F.col("cash_And_Cash_Equivalents")).otherwise(F.col("current_Assets")),
        )
    per = lambda a, b: F.try_divide(F.col(a), F.col(b))
    owed = F.col("current_liabilities")
    base = j.select(
        *keys,
        "total_Assets",
        "current_Assets",
        "cash_And_Cash_Equivalents",
        "equity",
        "liabilities",
        "current_liabilities",
        F.col("equity").alias("book_Value"),
        per("equity", "average_shares").alias("book_Value_Per_Share"),
        per("net_Income", "total_Assets").alias("return_On_Assets"),
        per("net_Income", "equity").alias("return_On_Equity"),
        F.try_divide(F.col("net_Income"), F.col("equity") + F.col("liabilities")).alias(
            "return_On_Invested_Capital"
        ),
        F.when(owed == 0, F.lit(0.0)).otherwise(per("current_Assets", "current_liabilities")).alias(
            "current_Ratio"
        ),
        F.when(owed == 0, F.lit(0.0))
        .otherwise(per("cash_And_Cash_Equivalents", "current_liabilities"))
        .alias("quick_Ratio"),
        per("liabilities", "equity").alias("debt_To_Equity"),
    )
    return with_growth(base, BALANCE_GROWTH)


def annual_cash_flow(cash: DataFrame, income: DataFrame) -> DataFrame:
    keys = ["ticker", YEAR]
    base = cash.join(income.select(*keys, "average_shares"), keys).select(
        *keys,
        "free_Cash_Flow",
        F.try_divide(F.col("free_Cash_Flow"), F.col("average_shares")).alias(
            "free_Cash_Flow_Per_Share"
        ),
    )
    return with_growth(base, CASH_GROWTH)


def assemble_annual(income: DataFrame, balance: DataFrame, cash: DataFrame, once: bool = False) -> DataFrame:
    """Join the three statements and drop each ticker's oldest row (it has no growth).

    ``once`` keeps one row of a ticker and period where statements repeat: the join pairs each
    with each, and an as-of join takes any one of them.
    """
    keys = ["ticker", YEAR]
    if once:
        w = Window.partitionBy(*keys)
        income, balance, cash = (
            one_a_period(t.withColumn(f"_n{i}", F.count(F.lit(1)).over(w)), YEAR)
            for i, t in enumerate((income, balance, cash))
        )
    joined = income.join(balance, keys).join(cash, keys)
    newer = F.col("_rn") > 1
    if once:  # of an oldest period that repeats only one row is dropped
        newer = newer | (F.greatest("_n0", "_n1", "_n2") > 1)
    joined = joined.withColumn("_rn", F.row_number().over(by_period(YEAR))).where(newer)
    return joined.drop("_rn", "_n0", "_n1", "_n2")


def per_share_annual(income: DataFrame, balance: DataFrame, cash: DataFrame) -> DataFrame:
    """Per-share values of annual statements; balance and cash flow are optional."""
    keys = ["ticker", YEAR]
    j = income.join(balance.select(*keys, "equity"), keys, "left").join(
        cash.select(*keys, "free_Cash_Flow"), keys, "left"
    )
    return j.select(
        *keys,
        safe_divide("net_Income", "average_shares").alias("eps"),
        safe_divide("equity", "average_shares").alias("book_value_per_share"),
        safe_divide("revenue", "average_shares").alias("revenue_per_share"),
        safe_divide("free_Cash_Flow", "average_shares").alias("fcf_per_share"),
    )


# ---- choice of source ------------------------------------------------------------------
def source_selection(universe: DataFrame, ratios_ttm: DataFrame, income_q: DataFrame,
                     income_annual: DataFrame) -> DataFrame:
    """``ttm``, ``annual`` or ``none`` per ticker, with its number of quarters."""
    quarters = income_q.groupBy("ticker").agg(F.count(F.lit(1)).alias("quarters_available"))
    usable = ratios_ttm.groupBy("ticker").agg(
        (F.count("eps_ttm") + F.count("book_value_per_share") + F.count("fcf_per_share")).alias("_u")
    )
    annual = income_annual.select("ticker").distinct().withColumn("_a", F.lit(True))
    n = F.coalesce(F.col("quarters_available"), F.lit(0))
    ttm = (n >= QUARTERS) & (F.coalesce(F.col("_u"), F.lit(0)) > 0)
    return (
        universe.select("ticker")
        .join(quarters, "ticker", "left")
        .join(usable, "ticker", "left")
        .join(annual, "ticker", "left")
        .select(
            "ticker",
            F.when(ttm, "ttm").when(F.col("_a"), "annual").otherwise("none").alias(
                "ratio_data_source"
            ),
            n.alias("quarters_available"),
        )
    )


def validate_ttm(ratios_ttm: DataFrame, income_annual: DataFrame, margin: float = 0.15) -> DataFrame:
    """Newest TTM value against newest annual value per metric, and the ticker's verdict."""
    def newest(value: str, date: str) -> Column:
        return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(date)))

    ttm = ratios_ttm.groupBy("ticker").agg(
        newest("revenue_ttm", QUARTER).alias("rev_t"),
        newest("net_income_ttm", QUARTER).alias("ni_t"),
    )
    annual = income_annual.groupBy("ticker").agg(
        newest("revenue", YEAR).alias("rev_a"), newest("net_Income", YEAR).alias("ni_a")
    )
    pairs = F.array(
        F.struct(F.lit("Revenue").alias("metric"), F.col("rev_t").alias("ttm_value"),
                 F.col("rev_a").alias("annual_value")),
        F.struct(F.lit("Net Income").alias("metric"), F.col("ni_t").alias("ttm_value"),
                 F.col("ni_a").alias("annual_value")),
    )
    diff = F.when(
        F.abs("annual_value") > 1e-10,
        F.try_divide(F.abs(F.col("ttm_value") - F.col("annual_value")), F.abs("annual_value")),
    )
    rows = (
        ttm.join(annual, "ticker")
        .select("ticker", F.inline(pairs))
        .withColumn("pct_diff", diff)
        .withColumn("within_margin", F.coalesce(F.col("pct_diff") <= margin, F.lit(True)))
    )
    bad = F.coalesce(F.col("pct_diff") > 2 * margin, F.lit(False))
    return rows.withColumn("valid", ~F.max(bad).over(Window.partitionBy("ticker")))
