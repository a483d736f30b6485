"""B: statement metrics; V: daily valuation ratios."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.operators import joins, ratios, statements as st
from tickerloom.plans.domain_sql import register
from tickerloom.plans.registry import query
from tickerloom.session import materialised
from tickerloom.plans.sql_text import div, growth, lag, sdiv, sratio

Q, Y = st.QUARTER, st.YEAR
_L4 = f"(PARTITION BY ticker ORDER BY {Q} ROWS 3 PRECEDING)"


def _strict(flows) -> str:
    return ", ".join(f"sum(coalesce({c}, 0)) OVER {_L4} AS {c[:-2]}_ttm" for c in flows)


def _tolerant(flows) -> str:
    return ", ".join(
        f"CASE WHEN count({c}) OVER {_L4} >= 3 AND count(*) OVER (PARTITION BY ticker) >= 4 "
        f"THEN sum({c}) OVER {_L4} * (4e0 / count({c}) OVER {_L4}) END AS {c[:-2]}_ttm"
        for c in flows
    )


for _name, _table, _flows in (
    ("income_strict", "income_quarterly", st.INCOME_FLOWS),
    ("cash_strict", "cashflow_quarterly", st.CASH_FLOWS),
):
    register(_name, f"SELECT *, {_strict(_flows)} FROM {_table} "
             f"QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY {Q}) >= 4")
register("income_tolerant", f"SELECT *, {_tolerant(st.INCOME_FLOWS)} FROM income_quarterly")
register("cash_tolerant", f"SELECT *, {_tolerant(st.CASH_FLOWS)} FROM cashflow_quarterly")

_INC_COLS = "revenue_q gross_profit_q operating_income_q net_income_q shares_diluted"
_INC_TTM = "revenue_ttm gross_profit_ttm operating_income_ttm net_income_ttm"
_CF_COLS = "operating_cash_flow_q capex_q dividends_paid_q free_cash_flow_q"
_CF_TTM = "operating_cash_flow_ttm capex_ttm free_cash_flow_ttm dividends_paid_ttm"


def _income_strict(d):
    return st.ttm_strict(d.income_quarterly)


def _cash_strict(d):
    return st.ttm_strict(d.cashflow_quarterly, st.CASH_FLOWS)


def quarter_ratios(d):
    return st.ttm_ratios(_income_strict(d), d.balance_quarterly, _cash_strict(d))


query("B06_ttm_strict_income", "SELECT * FROM income_strict", f"{_INC_COLS} {_INC_TTM}")(_income_strict)
query("B06_ttm_strict_cashflow", "SELECT * FROM cash_strict", f"{_CF_COLS} {_CF_TTM}")(_cash_strict)


@query("B07_ttm_tolerant", f"""
SELECT ticker, {Q}, revenue_ttm, gross_profit_ttm, operating_income_ttm, net_income_ttm,
       CASE WHEN n >= 4 THEN revenue_growth_qoq END AS revenue_growth_qoq,
       CASE WHEN n >= 4 THEN net_income_growth_qoq END AS net_income_growth_qoq,
       {growth('revenue_ttm', 4, Q)} AS revenue_growth_yoy,
       {growth('net_income_ttm', 4, Q)} AS net_income_growth_yoy
FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS n,
             {growth('revenue_q', 1, Q)} AS revenue_growth_qoq,
             {growth('net_income_q', 1, Q)} AS net_income_growth_qoq FROM income_tolerant)""",
       f"{_INC_TTM} revenue_growth_qoq net_income_growth_qoq revenue_growth_yoy net_income_growth_yoy")
def _(d):
    keep = f"ticker {Q} {_INC_TTM} revenue_growth_qoq net_income_growth_qoq revenue_growth_yoy net_income_growth_yoy"
    return st.ttm_tolerant(d.income_quarterly).select(*keep.split())


register("quarter_ratios", f"""
SELECT *, CASE WHEN n >= 4 THEN {growth('revenue_ttm', 4, Q)} END AS revenue_growth_yoy,
       CASE WHEN n >= 4 THEN {growth('net_income_ttm', 4, Q)} END AS net_income_growth_yoy,
       CASE WHEN n >= 4 THEN {growth('total_assets', 4, Q)} END AS assets_growth_yoy
FROM (SELECT i.ticker, i.{Q}, {sdiv('gross_profit_ttm', 'revenue_ttm')} AS gross_margin_ttm,
             {sdiv('operating_income_ttm', 'revenue_ttm')} AS operating_margin_ttm,
             {sdiv('net_income_ttm', 'revenue_ttm')} AS net_margin_ttm,
             {sdiv('net_income_ttm', 'total_assets')} AS roa_ttm,
             {sdiv('net_income_ttm', 'total_equity')} AS roe_ttm,
             {sdiv('total_liabilities', 'total_equity')} AS debt_to_equity,
             {sdiv('current_assets', 'current_liabilities')} AS current_ratio,
             {sdiv('current_assets - inventory', 'current_liabilities')} AS quick_ratio,
             {sdiv('total_equity', 'shares_diluted')} AS book_value_per_share,
             {sdiv('net_income_ttm', 'shares_diluted')} AS eps_ttm,
             {sdiv('free_cash_flow_ttm', 'shares_diluted')} AS fcf_per_share,
             revenue_ttm, net_income_ttm, total_assets, total_equity, shares_diluted,
             count(*) OVER (PARTITION BY i.ticker) AS n
      FROM income_strict i JOIN balance_quarterly b ON i.ticker = b.ticker AND i.{Q} = b.{Q}
      LEFT JOIN cash_strict c ON i.ticker = c.ticker AND i.{Q} = c.{Q})
""")
_QR = ("gross_margin_ttm operating_margin_ttm net_margin_ttm roa_ttm roe_ttm debt_to_equity "
       "current_ratio quick_ratio book_value_per_share eps_ttm fcf_per_share revenue_ttm "
       "net_income_ttm total_assets total_equity shares_diluted revenue_growth_yoy "
       "net_income_growth_yoy assets_growth_yoy")
query("B08_ttm_ratios", "SELECT * EXCLUDE (n) FROM quarter_ratios", _QR)(quarter_ratios)

_QM = {
    "gross_margin_ttm": sdiv("gross_profit_ttm", "revenue_ttm"),
    "operating_margin_ttm": sdiv("operating_income_ttm", "revenue_ttm"),
    "net_margin_ttm": sdiv("net_income_ttm", "revenue_ttm"),
    "eps_diluted_ttm": sdiv("net_income_ttm", "shares_diluted"),
    "cash_ratio": sdiv("cash_and_equivalents", "current_liabilities"),
    "debt_to_assets": sdiv("total_debt", "total_assets"),
    "book_value_per_share": sdiv("total_equity", "shares_diluted"),
    "roic_ttm": sdiv("net_income_ttm", "(total_equity + total_debt)"),
    "fcf_per_share_ttm": sdiv("free_cash_flow_ttm", "shares_diluted"),
    "ocf_per_share_ttm": sdiv("operating_cash_flow_ttm", "shares_diluted"),
    "fcf_margin_ttm": sdiv("free_cash_flow_ttm", "revenue_ttm"),
    "capex_to_revenue_ttm": sdiv("capex_ttm", "revenue_ttm"),
    "fcf_conversion_ttm": sdiv("free_cash_flow_ttm", "net_income_ttm"),
    "free_cash_flow_ttm": "free_cash_flow_ttm",
    "operating_cash_flow_ttm": "operating_cash_flow_ttm",
}
_YOY = {"eps_growth_yoy": "eps_diluted_ttm", "book_value_growth_yoy": "book_value_per_share",
        "fcf_growth_yoy": "free_cash_flow_ttm", "ocf_growth_yoy": "operating_cash_flow_ttm"}
query("B10_quarterly_metrics", f"""
SELECT *, {', '.join(sdiv(f'{c} - {lag(c, 4, Q)}', f'abs({lag(c, 4, Q)})') + f' AS {k}' for k, c in _YOY.items())}
FROM (SELECT i.ticker, i.{Q}, {', '.join(f'{v} AS {k}' for k, v in _QM.items())}
      FROM income_tolerant i LEFT JOIN balance_quarterly b ON i.ticker = b.ticker AND i.{Q} = b.{Q}
      LEFT JOIN cash_tolerant c ON i.ticker = c.ticker AND i.{Q} = c.{Q})""",
      " ".join([*_QM, *_YOY]))(
    lambda d: st.quarterly_metrics(d.income_quarterly, d.balance_quarterly, d.cashflow_quarterly)
)


@query("B09_cash_flow_proxy", f"""
SELECT ticker, {Q} AS date, free_cash_flow_ttm, 'quarterly' AS source FROM cash_strict
UNION ALL SELECT ticker, {Y}, free_Cash_Flow, 'annual' FROM cash_flow_annual
WHERE ticker NOT IN (SELECT ticker FROM cash_strict)""", "free_cash_flow_ttm")
def _(d):
    return st.cash_flow_proxy(_cash_strict(d), d.cash_flow_annual)


# ---- annual ----------------------------------------------------------------------------
register("income_metrics", f"""
SELECT *, {', '.join(growth(c, 1, Y) + f' AS {c}_Growth' for c in st.INCOME_GROWTH)}
FROM (SELECT ticker, {Y}, revenue, gross_Profit, {div('gross_Profit', 'revenue')} AS gross_Margin,
             operating_Earning, {div('operating_Earning', 'revenue')} AS operating_Earning_Margin,
             net_Income, {div('net_Income', 'revenue')} AS net_Income_Margin,
             {div('net_Income', 'average_shares')} AS eps, average_shares FROM income_annual)
""")
register("balance_metrics", f"""
SELECT *, {', '.join(growth(c, 1, Y) + f' AS {c}_Growth' for c in st.BALANCE_GROWTH)}
FROM (SELECT b.ticker, b.{Y}, total_Assets, current_Assets, cash_And_Cash_Equivalents, equity,
             liabilities, current_liabilities, equity AS book_Value,
             {div('equity', 'average_shares')} AS book_Value_Per_Share,
             {div('net_Income', 'total_Assets')} AS return_On_Assets,
             {div('net_Income', 'equity')} AS return_On_Equity,
             {div('net_Income', 'equity + liabilities')} AS return_On_Invested_Capital,
             CASE WHEN current_liabilities = 0 THEN 0 ELSE current_Assets / current_liabilities END AS current_Ratio,
             CASE WHEN current_liabilities = 0 THEN 0
                  ELSE cash_And_Cash_Equivalents / current_liabilities END AS quick_Ratio,
             {div('liabilities', 'equity')} AS debt_To_Equity
      FROM balance_annual b JOIN income_annual i ON b.ticker = i.ticker AND b.{Y} = i.{Y})
""")
register("cash_metrics", f"""
SELECT *, {', '.join(growth(c, 1, Y) + f' AS {c}_Growth' for c in st.CASH_GROWTH)}
FROM (SELECT c.ticker, c.{Y}, free_Cash_Flow, {div('free_Cash_Flow', 'average_shares')} AS free_Cash_Flow_Per_Share
      FROM cash_flow_annual c JOIN income_annual i ON c.ticker = i.ticker AND c.{Y} = i.{Y})
""")
_IM = "revenue gross_Profit gross_Margin operating_Earning operating_Earning_Margin net_Income net_Income_Margin eps average_shares"
_IMG = _IM + " " + " ".join(f"{c}_Growth" for c in st.INCOME_GROWTH)
_BMG = " ".join(st.BALANCE_GROWTH) + " " + " ".join(f"{c}_Growth" for c in st.BALANCE_GROWTH)
_CMG = " ".join(st.CASH_GROWTH) + " " + " ".join(f"{c}_Growth" for c in st.CASH_GROWTH)


def income_metrics(d):
    return st.annual_income(d.income_annual)


def balance_metrics(d):
    return st.annual_balance(d.balance_annual, d.income_annual)


def cash_metrics(d):
    return st.annual_cash_flow(d.cash_flow_annual, d.income_annual)


query("B01_annual_income", "SELECT * FROM income_metrics", _IMG)(income_metrics)
query("B02_annual_balance", "SELECT * FROM balance_metrics", _BMG)(balance_metrics)
query("B03_annual_cash_flow", "SELECT * FROM cash_metrics", _CMG)(cash_metrics)


_INDUSTRIES = ("Banks - Regional", "Semiconductors", "INSURANCE - LIFE", "Software", "Credit Services & Cards", "Oil",
               "Financial Data & Stock Exchanges", "Bank notes")
_LIKE = " OR ".join(f"lower(name) LIKE '%{x}%'" for x in st.FINANCIAL_PHRASES)


@query("B02_financial_sector", f"""
WITH s AS (SELECT ticker, list_extract([{', '.join(f"'{x}'" for x in _INDUSTRIES)}], CAST(hash_of % {len(_INDUSTRIES)} AS INTEGER) + 1) AS name
           FROM (SELECT ticker, CAST(substr(ticker, 2) AS BIGINT) AS hash_of FROM stock_info WHERE ticker LIKE 'S%'))
SELECT b.ticker, b.{Y}, CASE WHEN {_LIKE} THEN cash_And_Cash_Equivalents ELSE current_Assets END / current_liabilities AS current_Ratio
FROM balance_annual b JOIN s USING (ticker)""", "current_Ratio")
def _(d):
    names = F.array(*[F.lit(x) for x in _INDUSTRIES])
    number = F.substring("ticker", 2, 12).cast("bigint") % len(_INDUSTRIES)
    info = d.stock_info.where(F.col("ticker").startswith("S")).select(
        "ticker", F.element_at(names, number.cast("int") + 1).alias("name"))
    balance = d.balance_annual.join(info, "ticker")
    return st.annual_balance(balance, d.income_annual, st.financial_sector("name")).select("ticker", Y, "current_Ratio")


register("annual_assembled", f"""
SELECT i.*, b.* EXCLUDE (ticker, {Y}), c.* EXCLUDE (ticker, {Y})
FROM income_metrics i JOIN balance_metrics b ON i.ticker = b.ticker AND i.{Y} = b.{Y}
JOIN cash_metrics c ON i.ticker = c.ticker AND i.{Y} = c.{Y}
QUALIFY row_number() OVER (PARTITION BY i.ticker ORDER BY i.{Y}) > 1
""")


def annual_assembled(d):
    return st.assemble_annual(income_metrics(d), balance_metrics(d), cash_metrics(d))


query("B04_annual_assembly", "SELECT * FROM annual_assembled", f"{_IMG} {_BMG} {_CMG}")(annual_assembled)


@query("B05_statement_forward_fill", f"""
SELECT ticker, {Y}, last_value(revenue IGNORE NULLS) OVER w AS revenue,
       last_value(average_shares IGNORE NULLS) OVER w AS average_shares
FROM income_annual WINDOW w AS (PARTITION BY ticker ORDER BY {Y} ROWS UNBOUNDED PRECEDING)""",
       "revenue average_shares")
def _(d):
    return st.filled(d.income_annual, ["revenue", "average_shares"]).select(
        "ticker", Y, "revenue", "average_shares")


register("source_choice", """
SELECT s.ticker, CASE WHEN coalesce(n, 0) >= 4 AND coalesce(u, 0) > 0 THEN 'ttm'
                      WHEN a.ticker IS NOT NULL THEN 'annual' ELSE 'none' END AS ratio_data_source,
       coalesce(n, 0) AS quarters_available
FROM stock_info s
LEFT JOIN (SELECT ticker, count(*) AS n FROM income_quarterly GROUP BY 1) q ON s.ticker = q.ticker
LEFT JOIN (SELECT ticker, count(eps_ttm) + count(book_value_per_share) + count(fcf_per_share) AS u
           FROM quarter_ratios GROUP BY 1) r ON s.ticker = r.ticker
LEFT JOIN (SELECT DISTINCT ticker FROM income_annual) a ON s.ticker = a.ticker
""")


@query("B11_source_selection", "SELECT * FROM source_choice")
def _(d):
    return st.source_selection(d.stock_info, quarter_ratios(d), d.income_quarterly, d.income_annual)


@query("B12_ttm_validation", f"""
WITH t AS (SELECT ticker, arg_max(revenue_ttm, CASE WHEN revenue_ttm IS NOT NULL THEN {Q} END) AS rt,
                  arg_max(net_income_ttm, CASE WHEN net_income_ttm IS NOT NULL THEN {Q} END) AS nt
           FROM quarter_ratios GROUP BY 1),
a AS (SELECT ticker, arg_max(revenue, CASE WHEN revenue IS NOT NULL THEN {Y} END) AS ra,
             arg_max(net_Income, CASE WHEN net_Income IS NOT NULL THEN {Y} END) AS na
      FROM income_annual GROUP BY 1),
m AS (SELECT ticker, 'Revenue' AS metric, rt AS ttm_value, ra AS annual_value FROM t JOIN a USING (ticker)
      UNION ALL SELECT ticker, 'Net Income', nt, na FROM t JOIN a USING (ticker)),
p AS (SELECT *, CASE WHEN abs(annual_value) > 1e-10
                     THEN abs(ttm_value - annual_value) / abs(annual_value) END AS pct_diff FROM m)
SELECT *, coalesce(pct_diff <= 0.15e0, true) AS within_margin,
       NOT bool_or(coalesce(pct_diff > 0.3e0, false)) OVER (PARTITION BY ticker) AS valid FROM p""",
       "ttm_value annual_value pct_diff")
def _(d):
    return st.validate_ttm(quarter_ratios(d), d.income_annual)


# ---- valuation -------------------------------------------------------------------------
_RATIOS = "p_s p_e p_b p_fcf"
_SHOW = ", ".join(f"lag({r}) OVER (PARTITION BY ticker ORDER BY date) AS {r}" for r in ratios.RATIOS)
register("ratio_ttm", f"""
SELECT date, ticker, {_SHOW}, financial_date_used
FROM (SELECT b.date, b.ticker, {sratio('close_Price', 'revenue_ttm / shares_diluted')} AS p_s,
             {sratio('close_Price', 'eps_ttm')} AS p_e,
             {sratio('close_Price', 'book_value_per_share')} AS p_b,
             {sratio('close_Price', 'fcf_per_share')} AS p_fcf, r.{Q} AS financial_date_used
      FROM bars b ASOF LEFT JOIN quarter_ratios r ON b.ticker = r.ticker AND b.date >= r.{Q})
""")
register("annual_per_share", f"""
SELECT i.ticker, i.{Y}, {sdiv('net_Income', 'average_shares')} AS eps,
       {sdiv('equity', 'average_shares')} AS book_value_per_share,
       {sdiv('revenue', 'average_shares')} AS revenue_per_share,
       {sdiv('free_Cash_Flow', 'average_shares')} AS fcf_per_share
FROM income_annual i LEFT JOIN balance_annual b ON i.ticker = b.ticker AND i.{Y} = b.{Y}
LEFT JOIN cash_flow_annual c ON i.ticker = c.ticker AND i.{Y} = c.{Y}
""")


def _annual_sql(divide) -> str:
    return f"""
SELECT date, ticker, {_SHOW}, financial_date_used
FROM (SELECT b.date, b.ticker, {divide('close_Price', 'revenue_per_share')} AS p_s,
             {divide('close_Price', 'eps')} AS p_e, {divide('close_Price', 'book_value_per_share')} AS p_b,
             {divide('close_Price', 'fcf_per_share')} AS p_fcf, r.{Y} AS financial_date_used
      FROM bars b ASOF LEFT JOIN annual_per_share r ON b.ticker = r.ticker AND b.date >= r.{Y})"""


register("ratio_annual", _annual_sql(sratio))


def _quarters(d):
    """``quarter_ratios`` for as-of joins of bars: one row of a ticker and quarter.

    Tickers of five digits are shared by several suppliers from 100,000 on; pairs of all their
    statements would be very many, and an as-of join takes any one of them."""
    return st.ttm_ratios(*(st.one_a_period(t, Q) for t in (_income_strict(d), d.balance_quarterly, _cash_strict(d))))


def _years(d):
    """``per_share`` for as-of joins of bars, likewise."""
    return st.per_share_annual(*(st.one_a_period(t, Y) for t in (d.income_annual, d.balance_annual, d.cash_flow_annual)))


def ratio_ttm(d, bars=None, ratios_q=None):
    return ratios.ratios_from_ttm(d.bars if bars is None else bars,
                                  _quarters(d) if ratios_q is None else ratios_q,
                                  rows=d.bars.count() if bars is None else None)


def per_share(d):
    return st.per_share_annual(d.income_annual, d.balance_annual, d.cash_flow_annual)


query("V01_ratios_ttm", "SELECT * FROM ratio_ttm", _RATIOS)(ratio_ttm)


@query("V01_ratios_latest_shares", f"""
SELECT date, ticker, lag(p_s) OVER (PARTITION BY ticker ORDER BY date) AS p_s
FROM (SELECT b.date, b.ticker, {sratio('close_Price', 'revenue_ttm / s.shares')} AS p_s
      FROM bars b ASOF LEFT JOIN quarter_ratios r ON b.ticker = r.ticker AND b.date >= r.{Q}
      LEFT JOIN (SELECT ticker, arg_max(shares_diluted, {Q}) AS shares FROM quarter_ratios
                 WHERE shares_diluted IS NOT NULL GROUP BY 1) s ON b.ticker = s.ticker)""", "p_s")
def _(d):
    return ratios.ratios_from_ttm(d.bars, quarter_ratios(d), latest_shares=True).select(
        "date", "ticker", "p_s")


@query("V02_ratios_annual", "SELECT * FROM ratio_annual", _RATIOS)
def _(d):
    return ratios.ratios_from_annual(d.bars, per_share(d))


@query("V03_ratios_plain", _annual_sql(div), _RATIOS)
def _(d):
    return ratios.ratios_from_annual(d.bars, per_share(d), guarded=False)


register("ratio_data", f"""
SELECT t.date, t.ticker, {', '.join(
    f'CASE WHEN count(t.{r}) OVER (PARTITION BY t.ticker) = 0 THEN a.{r} ELSE t.{r} END AS {r}'
    for r in ratios.RATIOS)}, t.financial_date_used
FROM ratio_ttm t LEFT JOIN ratio_annual a ON t.ticker = a.ticker AND t.date = a.date
""")
register("stock_ratio_data", f"""
SELECT * FROM ratio_data WHERE {' OR '.join(f'{r} IS NOT NULL' for r in ratios.RATIOS)}""")


def ratio_data(d):
    rows = d.bars.count()  # from the footers of the stored table
    return ratios.ratios_with_fallback(d.bars, _quarters(d), _years(d), rows=rows)


def stock_ratio_data(d):
    """The stored ratio table: derived once per session and folder, like the bars."""
    return d.stored("stock_ratio_data", lambda: ratios.drop_empty(ratio_data(d)))


def stored_ratio_ttm(d):
    return d.stored("ratio_ttm", lambda: ratio_ttm(d))


query("V04_annual_fallback", "SELECT * FROM ratio_data", _RATIOS)(ratio_data)
query("P12_drop_all_null_rows", "SELECT * FROM stock_ratio_data", _RATIOS)(lambda d: ratios.drop_empty(ratio_data(d)))


@query("V05_financial_date_used", f"""
SELECT b.date, b.ticker, r.date AS financial_date_used
FROM bars b ASOF LEFT JOIN (
  SELECT ticker, {Q} AS date FROM income_quarterly UNION SELECT ticker, {Y} FROM income_annual) r
ON b.ticker = r.ticker AND b.date >= r.date""")
def _(d):
    dates = ratios.report_dates(d.income_annual, d.income_quarterly).drop("source")
    return joins.as_of(d.bars.select("date", "ticker"), dates, matched="financial_date_used")


def _stored_before(d, days: int):
    """Ratios as they stood ``days`` ago, for two thirds of the tickers."""
    cut = F.date_sub(d.last_bar_date, days)
    known = quarter_ratios(d).where(F.col(Q) <= cut)
    old = ratios.drop_empty(ratio_ttm(d, d.bars.where(F.col("date") <= cut), known))
    return old.where(F.pmod(F.crc32("ticker"), F.lit(3)) != 0)


@query("V06_ratio_refresh", f"SELECT * FROM ratio_ttm WHERE {' OR '.join(f'{r} IS NOT NULL' for r in ratios.RATIOS)}", _RATIOS)
def _(d):
    stored = d.stored("ratios_before", lambda: _stored_before(d, 200))
    reports = quarter_ratios(d).select("ticker", F.col(Q).alias("date"))
    plan = materialised(ratios.refresh_plan(d.bars, stored, reports), "refresh-plan")
    return ratios.refreshed_ratios(stored, plan, ratio_ttm(d, ratios.bars_to_refresh(d.bars, plan)))


@query("V06_refresh_plan", f"""
WITH cut AS (SELECT as_of - 200 AS c FROM as_of),
st AS (SELECT r.ticker, max(r.date) AS last, arg_max(r.financial_date_used, r.date) AS used
       FROM stock_ratio_data r, cut WHERE r.date <= c GROUP BY 1),
rep AS (SELECT ticker, {Y} AS date FROM income_annual UNION SELECT ticker, {Q} FROM income_quarterly),
nx AS (SELECT rep.ticker, min(date) AS earliest, min(CASE WHEN date > used THEN date END) AS nxt
       FROM rep LEFT JOIN st ON rep.ticker = st.ticker GROUP BY 1),
fb AS (SELECT ticker, min(date) AS first FROM bars GROUP BY 1)
SELECT fb.ticker, CASE WHEN last IS NULL THEN 'initial' WHEN used IS NULL OR nxt IS NOT NULL THEN 'recalculate'
       ELSE 'update' END AS scenario,
       CASE WHEN last IS NULL THEN first WHEN used IS NULL THEN earliest
            ELSE least(nxt, last + 1) END AS recalculate_from
FROM fb JOIN nx ON fb.ticker = nx.ticker LEFT JOIN st ON fb.ticker = st.ticker""")
def _(d):
    cut = F.date_sub(d.last_bar_date, 200)
    stored = stock_ratio_data(d).where(F.col("date") <= cut)
    reports = ratios.report_dates(d.income_annual, d.income_quarterly)
    return ratios.refresh_plan(d.bars, stored, reports)


@query("V07_newest_report", f"""
SELECT coalesce(a.ticker, q.ticker) AS ticker, greatest(a.d, q.d) AS newest_date,
       CASE WHEN q.d IS NULL OR a.d >= q.d THEN 'annual' ELSE 'quarterly' END AS source
FROM (SELECT ticker, max({Y}) AS d FROM income_annual GROUP BY 1) a
FULL JOIN (SELECT ticker, max({Q}) AS d FROM income_quarterly GROUP BY 1) q ON a.ticker = q.ticker""")
def _(d):
    return ratios.newest_report(d.income_annual, d.income_quarterly)


_EXT = ("market_cap enterprise_value p_ocf_ttm ev_sales_ttm ev_ebit_ttm ev_fcf_ttm peg_ratio "
        "earnings_yield_ttm fcf_yield_ttm dividend_yield")
_PE = sratio("market_cap", "net_income_ttm")


@query("V08_extended_multiples", f"""
WITH r AS (SELECT i.ticker, i.{Q}, revenue_ttm, operating_income_ttm, net_income_ttm, shares_diluted,
                  total_debt, cash_and_equivalents, free_cash_flow_ttm, operating_cash_flow_ttm,
                  dividends_paid_ttm,
                  {sdiv('net_income_ttm - ' + lag('net_income_ttm', 4, 'i.' + Q, 'i.ticker'),
                        'abs(' + lag('net_income_ttm', 4, 'i.' + Q, 'i.ticker') + ')')} AS g
           FROM income_strict i LEFT JOIN balance_quarterly b ON i.ticker = b.ticker AND i.{Q} = b.{Q}
           LEFT JOIN cash_strict c ON i.ticker = c.ticker AND i.{Q} = c.{Q}),
j AS (SELECT b.date, b.ticker AS tk, close_Price * shares_diluted AS market_cap,
             close_Price * shares_diluted + total_debt - cash_and_equivalents AS enterprise_value, r.*
      FROM bars b ASOF LEFT JOIN r ON b.ticker = r.ticker AND b.date >= r.{Q}),
k AS (SELECT *, {_PE} AS pe FROM j)
SELECT date, tk AS ticker, market_cap, enterprise_value,
       {sratio('market_cap', 'operating_cash_flow_ttm')} AS p_ocf_ttm,
       {sratio('enterprise_value', 'revenue_ttm')} AS ev_sales_ttm,
       {sratio('enterprise_value', 'operating_income_ttm')} AS ev_ebit_ttm,
       {sratio('enterprise_value', 'free_cash_flow_ttm')} AS ev_fcf_ttm,
       CASE WHEN pe > 0 AND g > 0 THEN {sratio('pe', 'g * 1e2')} END AS peg_ratio,
       {sratio('net_income_ttm', 'market_cap')} AS earnings_yield_ttm,
       {sratio('free_cash_flow_ttm', 'market_cap')} AS fcf_yield_ttm,
       {sratio('abs(dividends_paid_ttm)', 'market_cap')} AS dividend_yield
FROM k""", _EXT)
def _(d):
    return ratios.extended_multiples(d.bars, _income_strict(d), d.balance_quarterly, _cash_strict(d))


_DS = "eps book_Value_Per_Share free_Cash_Flow_Per_Share revenue_Growth"
_NEXT = "(PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_PREV = "(PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)"
register("model_dataset", f"""
WITH m AS (SELECT date, close_Price AS market_close FROM benchmarks WHERE index_code = 'R0'),
p AS (SELECT b.*, last_value(m.market_close IGNORE NULLS) OVER (PARTITION BY b.ticker ORDER BY b.date
             ROWS UNBOUNDED PRECEDING) AS market_close FROM bars b LEFT JOIN m ON b.date = m.date),
j AS (SELECT p.*, {', '.join('r.' + c for c in _DS.split())}
      FROM p ASOF LEFT JOIN annual_assembled r ON p.ticker = r.ticker AND p.date >= r.{Y}),
f AS (SELECT date, ticker, open_Price, high_Price, low_Price, close_Price, trade_Volume, market_close,
             {', '.join(f'first_value({c} IGNORE NULLS) OVER {_NEXT} AS {c}' for c in _DS.split())} FROM j)
SELECT f.*, p_s, p_e, p_b, p_fcf
FROM f LEFT JOIN stock_ratio_data s ON f.ticker = s.ticker AND f.date = s.date
""")


def model_dataset(d):
    market = materialised(d.benchmarks.where("index_code = 'R0'").select(
        "date", F.col("close_Price").alias("market_close")), "market")
    assembled = st.assemble_annual(income_metrics(d), balance_metrics(d), cash_metrics(d), once=True)
    rows = d.bars.count()  # from the footers of the stored table
    return ratios.model_dataset(d.bars, market, assembled.select("ticker", Y, *_DS.split()), _quarters(d), _years(d), rows)


query("V09_model_dataset", "SELECT * FROM model_dataset",
      f"open_Price high_Price low_Price close_Price market_close {_DS} {_RATIOS}")(model_dataset)


@query("V10_key_metrics", f"""
WITH q AS (SELECT * FROM quarter_ratios QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY {Q} DESC) = 1),
a AS (SELECT * FROM annual_assembled QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY {Y} DESC) = 1)
SELECT a.ticker, coalesce(revenue_ttm, revenue) AS revenue, coalesce(net_income_ttm, net_Income) AS net_income,
       coalesce(gross_margin_ttm, gross_Margin) AS gross_margin,
       coalesce(operating_margin_ttm, operating_Earning_Margin) AS operating_margin,
       coalesce(roe_ttm, return_On_Equity) AS roe, coalesce(q.debt_to_equity, a.debt_To_Equity) AS debt_to_equity,
       coalesce(q.current_ratio, a.current_Ratio) AS current_ratio
FROM a LEFT JOIN q ON a.ticker = q.ticker""",
       "revenue net_income gross_margin operating_margin roe debt_to_equity current_ratio")
def _(d):
    q = joins.keep_latest(quarter_ratios(d), ["ticker"], [F.col(Q)])
    a = joins.keep_latest(annual_assembled(d), ["ticker"], [F.col(Y)])
    return ratios.key_metrics(q, a)


@query("J05_as_of_backward", f"""
SELECT b.date, b.ticker, b.close_Price, r.{Q} AS report_date, revenue_ttm, eps_ttm
FROM bars b ASOF LEFT JOIN quarter_ratios r ON b.ticker = r.ticker AND b.date >= r.{Q}""",
       "close_Price revenue_ttm eps_ttm")
def _(d):
    right = quarter_ratios(d).select("ticker", Q, "revenue_ttm", "eps_ttm")
    return joins.as_of(d.bars.select("date", "ticker", "close_Price"), right, right_on=Q,
                       matched="report_date")


@query("J06_stepwise_statement_fill", f"""
SELECT b.date, b.ticker, revenue, average_shares
FROM bars b ASOF LEFT JOIN income_annual r ON b.ticker = r.ticker AND b.date >= r.{Y}""",
       "revenue average_shares")
def _(d):
    right = d.income_annual.select("ticker", Y, "revenue", "average_shares")
    return joins.as_of(d.bars.select("date", "ticker"), right, right_on=Y)
