"""Per-account baselines without whole-account windows.

A window over account_id would pull a hot account into one task. Instead the
bills are reduced map-side to one moment row per (account, month), rolled up to
the account from at most 13 such rows, and joined back to the detail.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_MONTH = 0  # month_key of undated bills; they never get a monthly baseline


def month_moments(bills: DataFrame) -> DataFrame:
    """Count, spend, spread and rate sums per (account_id, month_key)."""
    moments = [
        "count(bill_id) AS n", "sum(total_amount) AS spend",
        "min(total_amount) AS low", "max(total_amount) AS high",
        "coalesce(var_pop(CAST(total_amount AS DOUBLE)), 0D) AS var_pop",
        "sum(CASE WHEN usage_volume > 0 THEN effective_delivery_rate END) AS rate_sum",
        "count_if(usage_volume > 0) AS rate_n", "sum(effective_delivery_rate) AS rate_sum_all",
    ]
    return bills.groupBy("account_id", "month_key").agg(*map(F.expr, moments))


def _spread(squares: str, n: str, low: str, high: str) -> str:
    """Sample standard deviation; exactly 0 when every value is equal, null for one row."""
    return f"CASE WHEN {n} < 2 THEN NULL WHEN {low} = {high} THEN 0D ELSE sqrt({squares} / ({n} - 1)) END"


def account_profile(bills: DataFrame) -> DataFrame:
    """One row per account: overall baselines plus an array of its months (≤ 13)."""
    rolled = [
        "array_agg(struct(month_key, n, spend, low, high, var_pop)) AS months",
        "sum(n) AS account_bill_count", "sum(spend) AS spend", "min(low) AS low", "max(high) AS high",
        "sum(rate_sum) AS rate_sum", "sum(rate_n) AS rate_n", "sum(rate_sum_all) AS rate_sum_all",
    ]
    squares = (
        "aggregate(months, 0D, (acc, m) -> acc + m.n * "
        "(m.var_pop + pow(CAST(m.spend AS DOUBLE) / m.n - overall_mean, 2D)))"
    )
    return (
        month_moments(bills)
        .groupBy("account_id")
        .agg(*map(F.expr, rolled))
        .selectExpr("*", "CAST(spend AS DOUBLE) / account_bill_count AS overall_mean")
        .selectExpr(
            "account_id", "months", "account_bill_count", "overall_mean",
            f"{_spread(squares, 'account_bill_count', 'low', 'high')} AS overall_std",
            "rate_sum / nullif(rate_n, 0) AS mean_rate_used",
            "rate_sum_all / account_bill_count AS mean_rate_all",
        )
    )


def month_profile(profile: DataFrame) -> DataFrame:
    """Account profile unfolded to one row per (account_id, month_key)."""
    others = [c for c in profile.columns if c != "months"]
    dated = f"m.month_key <> {NO_MONTH}"
    return profile.selectExpr(*others, "explode(months) AS m").selectExpr(
        *others,
        "m.month_key AS month_key",
        f"CASE WHEN {dated} THEN CAST(m.spend AS DECIMAL(24,2)) END AS monthly_spend",
        f"CASE WHEN {dated} THEN m.n END AS monthly_bills",
        f"CASE WHEN {dated} THEN CAST(m.spend AS DOUBLE) / m.n END AS monthly_mean",
        f"CASE WHEN {dated} THEN {_spread('m.n * m.var_pop', 'm.n', 'm.low', 'm.high')} END AS monthly_std",
    )
