"""Logical schemas of the stored tables.

Fixed values: table and column names. Prices, ratios and indicators are doubles; missing
values are NULL, never NaN.
"""

from __future__ import annotations

from pyspark.sql import types as T

from tickerloom.operators.indicators import FAMILIES, _columns

DATE, TEXT, LONG, INT, DOUBLE, BOOL, TIME = (
    T.DateType(), T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)


def _schema(*groups: tuple[T.DataType, str]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for kind, names in groups for name in names.split()])


def _with_growth(names: str) -> str:
    return " ".join(f"{n} {n}_Growth" for n in names.split())


STOCK_INFO = _schema((TEXT, "ticker company_Name industry"))
STOCK_PRICE = _schema(
    (DATE, "date"), (TEXT, "ticker currency"), (LONG, "trade_Volume"),
    (DOUBLE, "open_Price high_Price low_Price close_Price"), (DOUBLE, " ".join(_columns(FAMILIES))),
)
INCOME_ANNUAL = _schema(
    (DATE, "financial_Statement_Date date_published"), (TEXT, "ticker"),
    (DOUBLE, _with_growth("revenue gross_Profit gross_Margin operating_Earning operating_Earning_Margin "
                          "net_Income net_Income_Margin eps")), (DOUBLE, "average_shares"),
)
BALANCE_ANNUAL = _schema(
    (DATE, "financial_Statement_Date date_Published"), (TEXT, "ticker"),
    (DOUBLE, _with_growth("total_Assets current_Assets cash_And_Cash_Equivalents equity liabilities "
                          "current_liabilities book_Value book_Value_Per_Share return_On_Assets "
                          "return_On_Equity current_Ratio quick_Ratio debt_To_Equity")),
)
CASH_FLOW_ANNUAL = _schema(
    (DATE, "financial_Statement_Date date_published"), (TEXT, "ticker"),
    (DOUBLE, _with_growth("free_Cash_Flow free_Cash_Flow_Per_Share")),
)
_QUARTER = ((DATE, "fiscal_quarter_end"), (INT, "fiscal_year fiscal_quarter"), (DATE, "date_published"), (TEXT, "ticker"))
INCOME_QUARTERLY = _schema(
    *_QUARTER,
    (DOUBLE, "revenue_q gross_profit_q operating_income_q net_income_q eps_basic_q eps_diluted_q shares_diluted ebitda_q"),
    (DOUBLE, "revenue_ttm gross_profit_ttm operating_income_ttm net_income_ttm eps_basic_ttm eps_diluted_ttm ebitda_ttm"),
    (DOUBLE, "gross_margin_ttm operating_margin_ttm net_margin_ttm ebitda_margin_ttm"),
    (DOUBLE, "revenue_growth_yoy gross_profit_growth_yoy operating_income_growth_yoy net_income_growth_yoy eps_growth_yoy"),
    (DOUBLE, "revenue_growth_qoq net_income_growth_qoq"),
)
BALANCE_QUARTERLY = _schema(
    *_QUARTER,
    (DOUBLE, "total_assets current_assets cash_and_equivalents cash_and_investments accounts_receivable inventory "
             "goodwill intangible_assets total_liabilities current_liabilities accounts_payable total_debt "
             "short_term_debt long_term_debt total_equity retained_earnings"),
    (DOUBLE, "current_ratio quick_ratio cash_ratio debt_to_equity debt_to_assets book_value_per_share "
             "tangible_book_per_share roa_ttm roe_ttm roic_ttm assets_growth_yoy equity_growth_yoy book_value_growth_yoy"),
)
CASH_FLOW_QUARTERLY = _schema(
    *_QUARTER,
    (DOUBLE, "operating_cash_flow_q capex_q free_cash_flow_q investing_cash_flow_q financing_cash_flow_q "
             "dividends_paid_q share_repurchases_q"),
    (DOUBLE, "operating_cash_flow_ttm capex_ttm free_cash_flow_ttm dividends_paid_ttm share_repurchases_ttm "
             "fcf_per_share_ttm ocf_per_share_ttm fcf_margin_ttm capex_to_revenue_ttm fcf_conversion_ttm "
             "fcf_growth_yoy ocf_growth_yoy"),
)
STOCK_RATIO = _schema((DATE, "date"), (TEXT, "ticker"), (DOUBLE, "p_s p_e p_b p_fcf"), (DATE, "financial_date_used"))
STOCK_RATIO_TTM = _schema(
    (DATE, "date"), (TEXT, "ticker"),
    (DOUBLE, "p_s_ttm p_e_ttm p_b p_fcf_ttm p_ocf_ttm ev_sales_ttm ev_ebitda_ttm ev_ebit_ttm ev_fcf_ttm peg_ratio "
             "pegf_ratio earnings_yield_ttm fcf_yield_ttm dividend_yield enterprise_value market_cap"),
)
PREDICTION = _schema((TEXT, "ticker model_Type model_Equation"), (DOUBLE, "prediction_30_Days prediction_60_Days prediction_90_Days"))
PREDICTION_EXTENDED = _schema(
    (DATE, "prediction_date"), (TEXT, "ticker"), (INT, "prediction_horizon_days"), (DATE, "target_date"),
    (DOUBLE, "predicted_price current_price predicted_return confidence_lower_5 confidence_lower_16 "
             "confidence_upper_84 confidence_upper_95"),
    (TEXT, "model_type model_version"), (DOUBLE, "prediction_std"), (BOOL, "mc_dropout_used"), (INT, "mc_iterations"),
)
MONTE_CARLO = _schema(
    (DATE, "simulation_date"), (TEXT, "ticker"), (INT, "simulation_year num_simulations"),
    (DOUBLE, "percentile_5 percentile_10 percentile_16 percentile_25 mean_price median_price percentile_75 "
             "percentile_84 percentile_90 percentile_95 return_percentile_5 return_mean return_percentile_95 "
             "volatility var_95 cvar_95 mu_used sigma_used starting_price"),
)
PORTFOLIO_RUNS = _schema(
    (LONG, "run_id"), (TIME, "run_date"), (TEXT, "run_name risk_level"), (INT, "investment_years portfolio_size"),
    (TEXT, "industries_filter countries_filter excluded_tickers"),
    (INT, "total_stocks_analyzed successful_predictions failed_predictions"),
    (DOUBLE, "expected_return expected_volatility sharpe_ratio mc_return_p5 mc_return_mean mc_return_p95"),
    (TEXT, "status error_message"), (DOUBLE, "execution_time_seconds"),
)
PORTFOLIO_HOLDINGS = _schema(
    (LONG, "run_id"), (TEXT, "ticker"), (DOUBLE, "weight"), (INT, "rank"),
    (DOUBLE, "expected_return volatility sharpe_ratio correlation_to_portfolio marginal_contribution_to_risk"),
    (TEXT, "industry country"),
)
MODEL_HYPERPARAMETERS = _schema(
    (TEXT, "ticker model_type"), (TIME, "tuning_date"), (TEXT, "hyperparameters"), (INT, "num_trials"),
    (DOUBLE, "best_score tuning_time_seconds"), (INT, "training_samples num_features"), (TEXT, "feature_hash"),
    (DOUBLE, "val_mse val_r2 val_mae"), (BOOL, "is_constrained is_valid"),
)
INDEX_MEMBERSHIP = _schema(
    (TEXT, "ticker index_code index_name exchange"), (DATE, "date_added date_removed"), (BOOL, "is_current"),
    (TIME, "last_updated"),
)
STOCK_BETA = _schema(
    (DATE, "date"), (TEXT, "ticker index_code index_symbol"),
    (DOUBLE, "beta_60d beta_120d beta_252d correlation_252d r_squared_252d"), (TIME, "last_updated"),
)
QUARTERLY_FETCH = _schema((TEXT, "ticker"), (DATE, "last_fetch_date last_quarter_end"), (INT, "quarters_count"))
BLACKLIST = _schema((TEXT, "ticker reason details date_added"), (BOOL, "active"))

TABLES = {
    "stock_info_data": STOCK_INFO,
    "stock_price_data": STOCK_PRICE,
    "stock_income_stmt_data": INCOME_ANNUAL,
    "stock_balancesheet_data": BALANCE_ANNUAL,
    "stock_cash_flow_data": CASH_FLOW_ANNUAL,
    "stock_income_stmt_quarterly": INCOME_QUARTERLY,
    "stock_balancesheet_quarterly": BALANCE_QUARTERLY,
    "stock_cashflow_quarterly": CASH_FLOW_QUARTERLY,
    "stock_ratio_data": STOCK_RATIO,
    "stock_ratio_data_ttm": STOCK_RATIO_TTM,
    "stock_prediction_data": PREDICTION,
    "stock_prediction_extended": PREDICTION_EXTENDED,
    "monte_carlo_results": MONTE_CARLO,
    "portfolio_runs": PORTFOLIO_RUNS,
    "portfolio_holdings": PORTFOLIO_HOLDINGS,
    "model_hyperparameters": MODEL_HYPERPARAMETERS,
    "index_membership": INDEX_MEMBERSHIP,
    "stock_beta_data": STOCK_BETA,
    "quarterly_fetch_metadata": QUARTERLY_FETCH,
    "blacklist": BLACKLIST,
}
