"""Readable names for stored codes; unknown codes pass through."""

from __future__ import annotations

LAYER_TITLES = {
    "MATH": "Arithmetic check",
    "ML": "Unusual pattern",
    "COMBINED": "Unusual pattern, not due to weather",
}
FINDING_TITLES = {
    "MATH_ERROR": "Charges and total disagree",
    "WEATHER_UNEXPLAINED_SPIKE": "High bill in mild weather",
    "WEATHER_UNEXPLAINED_DROP": "Low bill in harsh weather",
    "WEATHER_DRIVEN": "Change in line with the weather",
    "USAGE_SPIKE": "High bill for this account",
    "USAGE_DROP": "Low bill for this account",
}
FEATURE_TITLES = {
    "zscore_monthly": "Distance from the month's usual bill",
    "zscore_overall": "Distance from the account's usual bill",
    "pct_above_monthly": "Percent over the month's mean",
    "pct_above_overall": "Percent over the account's mean",
    "delivery_rate_ratio": "Shift in delivery rate",
    "delivery_pct": "Share of delivery charges",
    "supply_pct": "Share of supply charges",
    "demand_pct": "Share of demand charges",
    "taxes_pct": "Share of taxes",
    "month": "Time of year",
    "industry_encoded": "Industry",
    "utility_encoded": "Kind of utility",
}


def titled(code: str, titles: dict[str, str]) -> str:
    steps = " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "\\'")) for k, v in titles.items())
    return f"CASE {code} {steps} ELSE {code} END"
