"""Relative features of every bill: the analytic base table and its baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tariffscope.functions.numeric import percent_above, ratio, usable_std
from tariffscope.operators.baseline import NO_MONTH, account_profile, month_profile
from tariffscope.operators.charges import with_charges
from tariffscope.operators.encode import encode_labels
from tariffscope.operators.filters import positive_total
from tariffscope.operators.star import account_directory, bill_star
from tariffscope.session import staged
from tariffscope.sources.tables import AuditTables

# The model inputs in order, and the shortest history it judges.
MODEL_INPUTS = [
    "zscore_monthly", "zscore_overall", "pct_above_monthly", "pct_above_overall",
    "delivery_rate_ratio", "delivery_pct", "supply_pct", "demand_pct", "taxes_pct",
    "month", "industry_encoded", "utility_encoded",
]
MIN_HISTORY = 12

_BILL_COLUMNS = [
    "bill_id", "account_id", "utility_type", "billing_date", "service_period_start",
    "service_period_end", "total_amount", "usage_volume", "usage_unit", "demand_read",
    "is_anomaly_detected", "anomaly_status", "anomaly_reason",
]


def priced_bills(tables: AuditTables) -> DataFrame:
    """Bills with a positive total, their four charge sums, calendar parts and rate."""
    bills = positive_total(tables.bills).select(*_BILL_COLUMNS)
    return with_charges(bills, tables.line_items).selectExpr(
        "*", "month(billing_date) AS month", "year(billing_date) AS year",
        f"coalesce(month(billing_date), {NO_MONTH}) AS month_key",
        f"{ratio('delivery_charge', 'usage_volume', 0)} AS effective_delivery_rate",
    )


def base_table(tables: AuditTables, include_unassigned: bool = False) -> DataFrame:
    """Priced bills inside the star."""
    return bill_star(tables, priced_bills(tables), include_unassigned).drop("month_key")


def engineer(
    tables: AuditTables, include_unassigned: bool = False, include_zero_usage: bool = False,
    fill_missing: bool = True, stage_bills: bool = True, bills: DataFrame | None = None,
) -> DataFrame:
    """Bills with baselines and relative features.

    ``include_zero_usage`` averages the delivery rate over all bills instead of
    those with usage; ``fill_missing=False`` leaves percentages null where there
    is no baseline. The priced bills feed both the baselines and the detail, so
    they are staged and the line items are shuffled once; ``bills`` takes priced
    bills that are stored already. ``stage_bills=False`` keeps the plan lazy and
    builds them twice, but only with the columns its caller uses.
    """
    if bills is None:
        bills = priced_bills(tables)
        if stage_bills:
            bills = staged(bills, "priced-bills")
    profile = account_profile(bills).join(
        account_directory(tables, include_unassigned), "account_id"
    )
    # One join brings both the dimensions and the baselines to the detail rows.
    joined = bills.join(month_profile(profile), ["account_id", "month_key"])

    spreads = {"monthly_std", "overall_std"}
    kept = [c for c in joined.columns if c not in spreads | {"month_key", "mean_rate_used", "mean_rate_all"}]
    known_rate = "mean_rate_all" if include_zero_usage else "mean_rate_used"

    def above(base: str) -> str:
        percent = percent_above("CAST(total_amount AS DOUBLE)", base)
        return f"coalesce({percent}, 0D)" if fill_missing else percent

    shares = {
        "delivery_pct": "delivery_charge", "supply_pct": "supply_charge",
        "demand_pct": "demand_charge", "taxes_pct": "taxes",
    }
    return joined.selectExpr(
        *kept, f"{known_rate} AS avg_delivery_rate", *[f"{usable_std(c)} AS {c}" for c in sorted(spreads)]
    ).selectExpr(
        "*",
        "(CAST(total_amount AS DOUBLE) - monthly_mean) / monthly_std AS zscore_monthly",
        "(CAST(total_amount AS DOUBLE) - overall_mean) / overall_std AS zscore_overall",
        f"{above('monthly_mean')} AS pct_above_monthly",
        f"{above('overall_mean')} AS pct_above_overall",
        f"{ratio('effective_delivery_rate', 'avg_delivery_rate', 1)} AS delivery_rate_ratio",
        *[f"({ratio(part, 'total_amount', 0)}) * 100 AS {name}" for name, part in shares.items()],
    )


CODED = {
    "industry": "industry_encoded",
    "utility_type": "utility_encoded",
    "vendor_name": "vendor_encoded",
}


def label_values(bills: DataFrame, tables: AuditTables) -> DataFrame:
    """Every combination of coded values that occurs, reduced before it meets the dimensions."""
    seen = bills.select("account_id", "utility_type").distinct()
    return seen.join(account_directory(tables), "account_id").select(*CODED).distinct()


def coded_features(tables: AuditTables) -> DataFrame:
    """Features with the label codes of industry, utility and vendor, staged for reuse."""
    bills = staged(priced_bills(tables), "priced-bills")
    features = engineer(tables, bills=bills)
    return staged(encode_labels(features, CODED, label_values(bills, tables)), "features")
