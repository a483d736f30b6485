"""SQL twins of the domain tables, as CTEs resolved by name."""

from __future__ import annotations

import re

_WALK = """
SELECT date, ticker, k, open_Price,
       greatest(open_Price, close_Price) + (q % 5) AS high_Price,
       least(open_Price, close_Price) - (q % 3) AS low_Price,
       close_Price, q * 100 AS trade_Volume
FROM (SELECT *, coalesce(lag(close_Price) OVER (PARTITION BY k ORDER BY date), 5e2) AS open_Price
      FROM (SELECT *, CAST(500 + sum((q + k) % 7 - 3) OVER (PARTITION BY k ORDER BY date
                           ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS close_Price FROM {daily}))
"""

_SUMS = """
SELECT 'S' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS ticker, l_suppkey AS k, {period} AS {name},
       CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS rev,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS ext,
       CAST(sum(CAST(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END AS DECIMAL(18,4)))
            AS DOUBLE) AS ret
FROM lineitem GROUP BY 1, 2, 3
"""

_NET = "(rev - 0.75e0 * ext - 0.5e0 * ret)"

CTES: dict[str, str] = {
    "daily_s": """
SELECT l_suppkey AS k, 'S' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') AS ticker,
       CAST(l_shipdate AS DATE) AS date, CAST(sum(l_quantity) AS BIGINT) AS q
FROM lineitem GROUP BY 1, 2, 3
""",
    "daily_n": """
SELECT CAST(s_nationkey AS BIGINT) AS k, 'N' || CAST(s_nationkey AS VARCHAR) AS ticker,
       CAST(l_shipdate AS DATE) AS date, CAST(sum(l_quantity) AS BIGINT) AS q
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3
""",
    "bars_keyed": _WALK.format(daily="daily_s"),
    "bars": "SELECT * EXCLUDE (k) FROM bars_keyed",
    "bars_nation": "SELECT * EXCLUDE (k) FROM (" + _WALK.format(daily="daily_n") + ")",
    "bars_dirty": """
SELECT date, ticker, open_Price,
       CASE WHEN (k + day(date)) % 97 = 0 THEN low_Price - 1 ELSE high_Price END AS high_Price,
       low_Price,
       CASE WHEN (7 * k + dayofyear(date)) % 199 = 0 THEN NULL
            WHEN k % 9 = 4 AND (31 * k + dayofyear(date)) % 211 = 0 THEN close_Price * 5
            WHEN (31 * k + dayofyear(date)) % 211 = 0 THEN close_Price * 1.5e0
            ELSE close_Price END AS close_Price,
       CASE WHEN k % 8 = 2 AND day(date) % 4 = 0 THEN 0 ELSE trade_Volume END AS trade_Volume
FROM bars_keyed
""",
    "suppliers": """
SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS ticker, s_suppkey AS k, s_name, n_name,
       r_name, r_regionkey
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""",
    "stock_info": """
SELECT ticker, CASE WHEN k % 13 <> 0 THEN s_name END AS company_Name, n_name AS industry,
       r_name AS country FROM suppliers
UNION ALL
SELECT '^R' || CAST(r_regionkey AS VARCHAR), r_name, 'Index', r_name FROM region
""",
    "index_membership": """
SELECT ticker, 'R' || CAST(r_regionkey AS VARCHAR) AS index_code, r_name AS index_name,
       n_name AS exchange, k % 6 <> 0 AS is_current FROM suppliers
""",
    "benchmarks": """
SELECT index_code, date, avg(close_Price) AS close_Price
FROM bars JOIN index_membership USING (ticker) GROUP BY 1, 2
""",
    "quarter_sums": _SUMS.format(
        period="CAST(last_day(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH) AS DATE)",
        name="fiscal_quarter_end",
    ),
    "year_sums": _SUMS.format(
        period="make_date(year(l_shipdate), 12, 31)", name="financial_Statement_Date"
    ),
    "income_quarterly": f"""
SELECT ticker, fiscal_quarter_end,
       CASE WHEN (k + 4 * year(fiscal_quarter_end) + quarter(fiscal_quarter_end)) % 11 <> 0
            THEN rev END AS revenue_q,
       rev - 0.6e0 * ext AS gross_profit_q, rev - 0.7e0 * ext AS operating_income_q,
       {_NET} AS net_income_q, CAST(1000 + 10 * k AS DOUBLE) AS shares_diluted
FROM quarter_sums WHERE k % 10 <> 0
""",
    "balance_quarterly": """
SELECT ticker, fiscal_quarter_end, total_assets, total_liabilities,
       total_assets - total_liabilities AS total_equity, 0.6e0 * total_assets AS current_assets,
       0.4e0 * total_liabilities AS current_liabilities, 0.2e0 * total_assets AS inventory,
       0.1e0 * total_assets AS cash_and_equivalents, 0.5e0 * total_liabilities AS total_debt
FROM (SELECT *, 3e0 * rev + 5e4 AS total_assets, 1.5e0 * rev + 2e4 AS total_liabilities
      FROM quarter_sums)
""",
    "cashflow_quarterly": f"""
SELECT ticker, fiscal_quarter_end, {_NET} + 0.05e0 * rev AS operating_cash_flow_q,
       0.04e0 * rev AS capex_q, -0.3e0 * greatest({_NET}, 0e0) AS dividends_paid_q,
       ({_NET} + 0.05e0 * rev) - 0.04e0 * rev AS free_cash_flow_q
FROM quarter_sums WHERE k % 5 <> 0
""",
    "income_annual": f"""
SELECT ticker, financial_Statement_Date,
       CASE WHEN (k + year(financial_Statement_Date)) % 11 <> 0 THEN rev END AS revenue,
       rev - 0.6e0 * ext AS gross_Profit, rev - 0.7e0 * ext AS operating_Earning,
       {_NET} AS net_Income,
       CASE WHEN (k + year(financial_Statement_Date)) % 13 <> 0
            THEN CAST(1000 + 10 * k AS DOUBLE) END AS average_shares
FROM year_sums
""",
    "balance_annual": """
SELECT ticker, financial_Statement_Date, a AS total_Assets, 0.6e0 * a AS current_Assets,
       0.1e0 * a AS cash_And_Cash_Equivalents, a - l AS equity, l AS liabilities,
       0.4e0 * l AS current_liabilities, 0.2e0 * a AS inventory
FROM (SELECT *, 3e0 * rev + 5e4 AS a, 1.5e0 * rev + 2e4 AS l FROM year_sums)
""",
    "cash_flow_annual": f"""
SELECT ticker, financial_Statement_Date, {_NET} + 0.05e0 * rev - 0.04e0 * rev AS free_Cash_Flow
FROM year_sums
""",
    "month_ends": """
SELECT ticker, k, date, close_Price FROM bars_keyed
QUALIFY row_number() OVER (PARTITION BY ticker, date_trunc('month', date) ORDER BY date DESC) = 1
""",
    "predictions": """
SELECT date AS prediction_date, ticker, h AS prediction_horizon_days,
       date + CAST(floor(h * 365 / 252) AS INTEGER) AS target_date, price AS predicted_price,
       close_Price AS current_price, ret AS predicted_return,
       price * 0.8e0 AS confidence_lower_5, price * 0.9e0 AS confidence_lower_16,
       price * 1.1e0 AS confidence_upper_84, price * 1.2e0 AS confidence_upper_95
FROM (SELECT *, close_Price * (1 + ret) AS price
      FROM (SELECT *, ((31 * k + 17 * month(date) + h) % 41 - 20) / 1e2 AS ret
            FROM month_ends, (VALUES (30), (60), (90), (252)) AS hz(h)))
""",
    "as_of": "SELECT CAST(max(l_shipdate) AS DATE) AS as_of FROM lineitem",
    "model_registry": """
SELECT ticker, model_type, (SELECT as_of FROM as_of) - CAST(7 * k % 60 AS INTEGER) AS tuning_date,
       k % 11 <> 0 AS is_valid,
       '{"max_depth": ' || (k % 7 + 3) || ', "n_estimators": ' || (k % 5 * 50 + 50) || '}'
         AS hyperparameters,
       CASE WHEN k % 4 = 0 THEN 'stale'
            ELSE sha256('p_e,rsi_14,sma_20,volatility_20d') END AS feature_hash,
       (k % 17 + length(model_type)) / 1e4 + 1e-4 AS val_mse
FROM suppliers, (VALUES ('rf'), ('xgb'), ('tcn')) AS m(model_type)
WHERE model_type <> 'tcn' OR k % 3 <> 0
""",
    "blacklist": """
SELECT ticker, list_extract(['delisted', 'invalid', 'no_data', 'manual', 'error', 'suspended'],
       CAST(k % 6 + 1 AS INTEGER)) AS reason, k % 2 = 1 AS active
FROM suppliers WHERE k % 7 = 3
""",
    "quarterly_metadata": """
SELECT s.ticker, (SELECT as_of FROM as_of) - CAST(k % 45 AS INTEGER) AS last_fetch_date,
       last_quarter_end, coalesce(quarters_count, 0) AS quarters_count
FROM suppliers s LEFT JOIN (
  SELECT ticker, max(fiscal_quarter_end) AS last_quarter_end, count(*) AS quarters_count
  FROM income_quarterly GROUP BY 1) q ON s.ticker = q.ticker
""",
    "error_events": """
SELECT event_id, ts, 'S' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS ticker,
       list_extract(['No data found for symbol', 'Symbol may be delisted', 'HTTP 404 for url',
         'Connection timed out', 'Ticker invalid or not found'],
         CAST(event_id % 5 + 1 AS INTEGER)) AS message
FROM events WHERE event_type = 'error'
""",
    "ticks": """
SELECT event_id, ts, 'S' || lpad(CAST(user_id AS VARCHAR), 5, '0') AS ticker, value AS price
FROM events
""",
}


def register(name: str, sql: str) -> None:
    """Add a shared derived CTE (used by several oracle queries)."""
    CTES[name] = sql


def _mentioned(sql: str) -> list[str]:
    words = set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", sql))
    return [n for n in CTES if n in words]


def with_ctes(sql: str) -> str:
    """Prefix ``sql`` with the CTEs it (transitively) mentions, in dependency order."""
    ordered: list[str] = []

    def visit(name: str, body: str) -> None:
        for dep in _mentioned(body):
            if dep != name and dep not in ordered:
                visit(dep, CTES[dep])
        if name and name not in ordered:
            ordered.append(name)

    visit("", sql)
    body = sql.strip()
    parts = [f"{n} AS ({CTES[n].strip()})" for n in ordered]
    own = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    if own:
        body = body[own.end():]
        head = ",\n".join(parts)
        return f"WITH RECURSIVE {head + ',' if head else ''}\n{body}"
    return (f"WITH RECURSIVE {', '.join(parts)}\n{body}") if parts else body


def finished(sql: str, doubles: tuple[str, ...]) -> str:
    """Round the double columns the way ``registry.present`` rounds the Spark side."""
    inner = with_ctes(sql)
    if not doubles:
        return inner
    rounded = ", ".join(f'round("{c}" * 1e6 + 1e-3) / 1e6 + 0e0 AS "{c}"' for c in doubles)
    return f"SELECT * REPLACE ({rounded}) FROM (\n{inner}\n) AS result"
