"""The domain tables themselves as queries, so that their twins are checked too."""

from __future__ import annotations

from tickerloom.plans.registry import query

DOUBLES = {
    "bars": "open_Price high_Price low_Price close_Price",
    "bars_nation": "open_Price high_Price low_Price close_Price",
    "bars_dirty": "open_Price high_Price low_Price close_Price",
    "stock_info": "",
    "index_membership": "",
    "benchmarks": "close_Price",
    "income_quarterly": "revenue_q gross_profit_q operating_income_q net_income_q shares_diluted",
    "balance_quarterly": "total_assets total_liabilities total_equity current_assets "
    "current_liabilities inventory cash_and_equivalents total_debt",
    "cashflow_quarterly": "operating_cash_flow_q capex_q dividends_paid_q free_cash_flow_q",
    "income_annual": "revenue gross_Profit operating_Earning net_Income average_shares",
    "balance_annual": "total_Assets current_Assets cash_And_Cash_Equivalents equity liabilities "
    "current_liabilities inventory",
    "cash_flow_annual": "free_Cash_Flow",
    "predictions": "predicted_price current_price predicted_return confidence_lower_5 "
    "confidence_lower_16 confidence_upper_84 confidence_upper_95",
    "model_registry": "val_mse",
    "blacklist": "",
    "quarterly_metadata": "",
    "error_events": "",
}


def _table(name: str):
    return lambda d: getattr(d, name)


for _name, _doubles in DOUBLES.items():
    query(f"D_{_name}", f"SELECT * FROM {_name}", _doubles)(_table(_name))
