"""Daily valuation ratios from as-of joined reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.scalar import safe_divide, safe_ratio
from tickerloom.functions.windows import backward_fill
from tickerloom.operators.joins import as_of, as_of_each, keep_first
from tickerloom.operators.statements import QUARTER, YEAR
from tickerloom.session import dealt

RATIOS = ("p_s", "p_e", "p_b", "p_fcf")


def _shifted(df: DataFrame, lag: int) -> DataFrame:
    if lag == 0:
        return df
    w = Window.partitionBy("ticker").orderBy("date")
    return df.withColumns({r: F.lag(r, lag).over(w) for r in RATIOS})


#: Report columns that a bar's ratios are made of, by quarter and by year.
QUARTER_VALUES = ("eps_ttm", "book_value_per_share", "revenue_ttm", "fcf_per_share", "shares_diluted")
YEAR_VALUES = ("revenue_per_share", "eps", "book_value_per_share", "fcf_per_share")


def _by_quarter() -> dict[str, Column]:
    c = F.col("close_Price")
    return {
        "p_s": safe_ratio(c, F.try_divide(F.col("revenue_ttm"), F.col("shares_diluted"))),
        "p_e": safe_ratio(c, "eps_ttm"),
        "p_b": safe_ratio(c, "book_value_per_share"),
        "p_fcf": safe_ratio(c, "fcf_per_share"),
    }


def _by_year(divide=safe_ratio, prefix: str = "") -> dict[str, Column]:
    c = F.col("close_Price")
    return {r: divide(c, prefix + v) for r, v in zip(RATIOS, YEAR_VALUES)}


def ratios_from_ttm(bars: DataFrame, ratios_ttm: DataFrame, lag: int = 1,
                    latest_shares: bool = False, rows: int | None = None) -> DataFrame:
    """P/S, P/E, P/B, P/FCF against the newest quarter ended on or before the bar.

    Sales per share use the share count of that quarter; ``latest_shares`` uses the newest
    count of the whole history instead. ``rows``, where known, is the number of bars.
    """
    reports = ratios_ttm.select("ticker", QUARTER, *QUARTER_VALUES)
    if latest_shares:
        whole = Window.partitionBy("ticker")
        newest = F.max_by("shares_diluted", F.when(F.col("shares_diluted").isNotNull(), F.col(QUARTER)))
        reports = reports.withColumn("shares_diluted", newest.over(whole))
    j = as_of(bars.select("ticker", "date", "close_Price"), reports, right_on=QUARTER,
              matched="financial_date_used", rows=rows)
    out = j.select("date", "ticker", *[v.alias(r) for r, v in _by_quarter().items()], "financial_date_used")
    return _shifted(out, lag)


def ratios_from_annual(bars: DataFrame, per_share: DataFrame, lag: int = 1,
                       guarded: bool = True, rows: int | None = None) -> DataFrame:
    """The same ratios from annual per-share values; ``guarded=False`` only avoids x/0."""
    j = as_of(bars.select("ticker", "date", "close_Price"), per_share, right_on=YEAR,
              matched="financial_date_used", rows=rows)
    divide = safe_ratio if guarded else lambda a, b: F.try_divide(a, F.col(b))
    out = j.select("date", "ticker", *[v.alias(r) for r, v in _by_year(divide).items()], "financial_date_used")
    return _shifted(out, lag)


def _annual_for_empty(ttm: str, annual: str) -> dict[str, Column]:
    """Each ratio of the struct ``ttm``; that of ``annual`` where the ticker has none (``_n_...``)."""
    return {r: F.when(F.col(f"_n_{r}") == 0, F.col(f"{annual}.{r}")).otherwise(F.col(f"{ttm}.{r}")) for r in RATIOS}


def _rights(ratios_ttm: DataFrame, per_share: DataFrame) -> list:
    quarters = ratios_ttm.select("ticker", QUARTER, *QUARTER_VALUES)
    years = per_share.select("ticker", YEAR, *[F.col(c).alias(f"_y_{c}") for c in YEAR_VALUES])
    return [(quarters, QUARTER, None, "financial_date_used"), (years, YEAR, None, None)]


def _both_kinds(j: DataFrame, lag: int) -> DataFrame:
    """Structs ``_q`` and ``_y`` of the ratios by quarter and by year, as shown ``lag`` rows later, and the number
    of the ticker's known ratios by quarter; ``j`` has the values of ``_rights`` beside its bars."""
    w = Window.partitionBy("ticker").orderBy("date")
    whole = Window.partitionBy("ticker")
    raw = {f"_{k}_{r}": v for k, kind in (("q", _by_quarter()), ("z", _by_year(prefix="_y_"))) for r, v in kind.items()}
    j = j.withColumns(raw).drop(*QUARTER_VALUES, *[f"_y_{c}" for c in YEAR_VALUES])
    if lag:
        j = j.withColumns({c: F.lag(c, lag).over(w) for c in raw})
    j = j.withColumns({f"_n_{r}": F.count(f"_q_{r}").over(whole) for r in RATIOS})
    both = {f"_{n}": F.struct(*[F.col(f"_{k}_{r}").alias(r) for r in RATIOS]) for n, k in (("q", "q"), ("y", "z"))}
    return j.withColumns(both).drop(*raw)


def _of_the_day(*columns: str) -> Column:
    """What a join by date and ticker finds among the table's own rows: usually the row itself."""
    day = Window.partitionBy("ticker").orderBy("date").rangeBetween(Window.currentRow, Window.currentRow)
    found = F.collect_list(F.struct(*columns)).over(day)
    return F.when(F.col("date").isNotNull() & F.col("ticker").isNotNull(), found)


def ratios_with_fallback(bars: DataFrame, ratios_ttm: DataFrame, per_share: DataFrame, lag: int = 1,
                         rows: int | None = None) -> DataFrame:
    """Ratios by quarter; a ratio that is NULL on every row of a ticker is the one by year.

    The same rows as ``with_annual_fallback`` of both kinds, in one shuffle by ticker and without a join.
    """
    j = _both_kinds(as_of_each(bars.select("ticker", "date", "close_Price"), _rights(ratios_ttm, per_share), rows=rows), lag)
    j = j.withColumn("_day", _of_the_day("_y")).withColumn("_same", F.explode_outer("_day"))
    chosen = [v.alias(r) for r, v in _annual_for_empty("_q", "_same._y").items()]
    return j.select("date", "ticker", *chosen, "financial_date_used")


def with_annual_fallback(ttm: DataFrame, annual: DataFrame, rows: int | None = None) -> DataFrame:
    """Replace a ratio that is NULL on every row of a ticker by the annual one.

    ``rows``, where known, is the number of rows of each side and bounds the tasks' memory.
    """
    other = annual.select("date", "ticker", *[F.col(r).alias(f"_a_{r}") for r in RATIOS])
    whole = Window.partitionBy("ticker")
    counted = ttm.withColumns({f"_n_{r}": F.count(r).over(whole) for r in RATIOS})
    if rows is not None:
        counted, other = (dealt(x, "date", "ticker", rows=rows) for x in (counted, other))
    j = counted.join(other, ["date", "ticker"], "left")
    cols = [
        F.when(F.col(f"_n_{r}") == 0, F.col(f"_a_{r}")).otherwise(F.col(r)).alias(r)
        if r in RATIOS
        else F.col(r)
        for r in ttm.columns
    ]
    return j.select(*cols)


def drop_empty(ratios: DataFrame) -> DataFrame:
    return ratios.na.drop(how="all", subset=list(RATIOS))


def report_dates(annual: DataFrame, quarterly: DataFrame) -> DataFrame:
    """All report dates per ticker; where both kinds share a date, annual wins."""
    both = annual.select(
        "ticker", F.col(YEAR).alias("date"), F.lit("annual").alias("source"), F.lit(0).alias("_p")
    ).unionByName(
        quarterly.select(
            "ticker", F.col(QUARTER).alias("date"), F.lit("quarterly").alias("source"),
            F.lit(1).alias("_p"),
        )
    )
    return keep_first(both, ["ticker", "date"], [F.col("_p")]).drop("_p")


def newest_report(annual: DataFrame, quarterly: DataFrame) -> DataFrame:
    """Newest report date per ticker and where it comes from (annual on equal dates)."""
    dates = report_dates(annual, quarterly)
    return dates.groupBy("ticker").agg(
        F.max("date").alias("newest_date"), F.max_by("source", "date").alias("source")
    )


def refresh_plan(bars: DataFrame, stored: DataFrame, reports: DataFrame) -> DataFrame:
    """Per ticker: scenario and first date to recompute.

    ``initial`` without stored ratios (from the first bar), ``recalculate`` from the first
    report newer than the newest one used, else ``update`` from the day after the last
    stored ratio. A recalculation never starts later than that day, so no bar between the
    last stored ratio and the new report is skipped.
    """
    first_bar = bars.groupBy("ticker").agg(F.min("date").alias("_first"))
    state = stored.groupBy("ticker").agg(
        F.max("date").alias("_last"), F.max_by("financial_date_used", "date").alias("_used")
    )
    newer = (
        reports.join(state, "ticker", "left")
        .groupBy("ticker")
        .agg(
            F.min("date").alias("_earliest"),
            F.min(F.when(F.col("date") > F.col("_used"), F.col("date"))).alias("_next"),
        )
    )
    scenario = (
        F.when(F.col("_last").isNull(), "initial")
        .when(F.col("_used").isNull() | F.col("_next").isNotNull(), "recalculate")
        .otherwise("update")
    )
    start = (
        F.when(F.col("_last").isNull(), F.col("_first"))
        .when(F.col("_used").isNull(), F.col("_earliest"))
        .otherwise(F.least("_next", F.date_add("_last", 1)))
    )
    return (
        first_bar.join(newer, "ticker")
        .join(state, "ticker", "left")
        .select("ticker", scenario.alias("scenario"), start.alias("recalculate_from"))
    )


def bars_to_refresh(bars: DataFrame, plan: DataFrame) -> DataFrame:
    """The bars a refresh reads: from each start date on, and the one bar before it.

    Tickers without bars from their start date on have nothing to do and drop out.
    """
    start = plan.select("ticker", "recalculate_from")
    late = F.col("date") >= F.col("recalculate_from")
    edges = bars.select("ticker", "date").join(start, "ticker").groupBy("ticker").agg(
        F.max(F.when(~late, F.col("date"))).alias("_before"), F.max(F.when(late, F.col("recalculate_from"))).alias("_from")
    ).where("_from IS NOT NULL")
    first = edges.select("ticker", F.coalesce("_before", "_from").alias("_first"))
    return bars.join(first, "ticker").where(F.col("date") >= F.col("_first")).drop("_first")


def refreshed_ratios(stored: DataFrame, plan: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Stored ratios before each ticker's start date, recomputed ones from it on.

    ``recomputed`` must carry the bar before the start date in its inputs, so that the
    first refreshed row keeps its lagged value; ``ratios_*`` over ``bars_to_refresh`` does.
    """
    start = plan.select("ticker", "recalculate_from")
    kept = (
        stored.join(start, "ticker", "left")
        .where(F.col("recalculate_from").isNull() | (F.col("date") < F.col("recalculate_from")))
        .drop("recalculate_from")
    )
    fresh = (
        drop_empty(recomputed)
        .join(start, "ticker")
        .where(F.col("date") >= F.col("recalculate_from"))
        .drop("recalculate_from")
    )
    return kept.unionByName(fresh)


def extended_multiples(bars: DataFrame, income_ttm: DataFrame, balance: DataFrame,
                       cash_ttm: DataFrame) -> DataFrame:
    """Market value, enterprise value and their multiples and yields per bar."""
    keys = ["ticker", QUARTER]
    w = Window.partitionBy("ticker").orderBy(QUARTER)
    reports = (
        income_ttm.join(balance, keys, "left")
        .join(cash_ttm, keys, "left")
        .select(
            *keys, "revenue_ttm", "operating_income_ttm", "net_income_ttm", "shares_diluted",
            "total_debt", "cash_and_equivalents", "free_cash_flow_ttm", "operating_cash_flow_ttm",
            "dividends_paid_ttm",
        )
        .withColumn(
            "_g",
            safe_divide(
                F.col("net_income_ttm") - F.lag("net_income_ttm", 4).over(w),
                F.abs(F.lag("net_income_ttm", 4).over(w)),
            ),
        )
    )
    j = as_of(bars.select("ticker", "date", "close_Price"), reports, right_on=QUARTER)
    cap = F.col("close_Price") * F.col("shares_diluted")
    j = j.withColumn("market_cap", cap).withColumn(
        "enterprise_value", F.col("market_cap") + F.col("total_debt") - F.col("cash_and_equivalents")
    )
    pe = safe_ratio("market_cap", "net_income_ttm")
    return j.select(
        "date",
        "ticker",
        "market_cap",
        "enterprise_value",
        safe_ratio("market_cap", "operating_cash_flow_ttm").alias("p_ocf_ttm"),
        safe_ratio("enterprise_value", "revenue_ttm").alias("ev_sales_ttm"),
        safe_ratio("enterprise_value", "operating_income_ttm").alias("ev_ebit_ttm"),
        safe_ratio("enterprise_value", "free_cash_flow_ttm").alias("ev_fcf_ttm"),
        F.when((pe > 0) & (F.col("_g") > 0), safe_ratio(pe, F.col("_g") * F.lit(100.0))).alias(
            "peg_ratio"
        ),
        safe_ratio("net_income_ttm", "market_cap").alias("earnings_yield_ttm"),
        safe_ratio("free_cash_flow_ttm", "market_cap").alias("fcf_yield_ttm"),
        safe_ratio(F.abs("dividends_paid_ttm"), "market_cap").alias("dividend_yield"),
    )


def model_dataset(bars: DataFrame, market: DataFrame, reports: DataFrame, ratios_ttm: DataFrame,
                  per_share: DataFrame, rows: int | None = None) -> DataFrame:
    """Bars with the market series (filled forward), as-of reports and ratios (those of
    ``ratios_with_fallback`` that are not empty), in one shuffle by ticker.

    Rows before a ticker's first report take that first report's values. ``market`` should be a
    stored table: it is small, and its size lets the bars stay where they are.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    behind = w.rowsBetween(Window.unboundedPreceding, 0)
    values = [c for c in reports.columns if c not in ("ticker", YEAR)]
    base = bars.join(market, "date", "left")
    found = reports.select("ticker", YEAR, *[F.col(c).alias(f"_r_{c}") for c in values])
    j = as_of_each(base, [(found, YEAR, None, None), *_rights(ratios_ttm, per_share)], rows=rows)
    j = _both_kinds(j.withColumn("market_close", F.last("market_close", True).over(behind)), 1)
    j = j.withColumn("_day", _of_the_day("_q", "_y"))
    j = j.withColumns({f"_r_{c}": backward_fill(f"_r_{c}") for c in values})
    pairs = F.flatten(F.transform("_day", lambda q: F.transform("_day", lambda y: F.struct(*[
        F.when(F.col(f"_n_{r}") == 0, y["_y"][r]).otherwise(q["_q"][r]).alias(r) for r in RATIOS]))))
    known = F.filter(pairs, lambda p: F.coalesce(*[p[r] for r in RATIOS]).isNotNull())
    j = j.withColumn("_found", known).withColumn("_ratio", F.explode_outer("_found"))
    names = [c for c in base.columns if c not in ("date", "ticker")]
    return j.select("date", "ticker", *names, *[F.col(f"_r_{c}").alias(c) for c in values],
                    *[F.col(f"_ratio.{r}").alias(r) for r in RATIOS])


def key_metrics(latest_quarter: DataFrame, latest_annual: DataFrame) -> DataFrame:
    """Snapshot per ticker: the quarterly TTM figure, else the annual one."""
    pairs = {
        "revenue": ("revenue_ttm", "revenue"),
        "net_income": ("net_income_ttm", "net_Income"),
        "gross_margin": ("gross_margin_ttm", "gross_Margin"),
        "operating_margin": ("operating_margin_ttm", "operating_Earning_Margin"),
        "roe": ("roe_ttm", "return_On_Equity"),
        "debt_to_equity": ("debt_to_equity", "debt_To_Equity"),
        "current_ratio": ("current_ratio", "current_Ratio"),
    }
    q = latest_quarter.select("ticker", *[F.col(a).alias(f"_q_{k}") for k, (a, _) in pairs.items()])
    a = latest_annual.select("ticker", *[F.col(b).alias(f"_a_{k}") for k, (_, b) in pairs.items()])
    return a.join(q, "ticker", "left").select(
        "ticker", *[F.coalesce(f"_q_{k}", f"_a_{k}").alias(k) for k in pairs]
    )
