"""Charges per bill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffscope.functions.numeric import MONEY

CHARGE_COLUMNS = {
    "delivery_charge": "Delivery Charge",
    "supply_charge": "Supply Charge",
    "demand_charge": "Demand Charge",
    "taxes": "Taxes and Surcharges",
}


def charge_sums(line_items: DataFrame) -> DataFrame:
    """One scan of the line items: the four charge sums of every bill.

    Conditional sums combine map-side, so a bill with very many items still
    ships one partial row per task.
    """
    sums = [
        f"CAST(coalesce(sum(CASE WHEN category = '{name}' THEN total_price END), 0) AS {MONEY}) AS {column}"
        for column, name in CHARGE_COLUMNS.items()
    ]
    return (
        line_items.filter(F.col("category").isin(*CHARGE_COLUMNS.values()))
        .groupBy("bill_id")
        .agg(*map(F.expr, sums))
    )


def with_charges(bills: DataFrame, line_items: DataFrame) -> DataFrame:
    """Bills with their charge sums, 0 where a category has no items."""
    return bills.join(charge_sums(line_items), "bill_id", "left").selectExpr(
        *[f"{c}" for c in bills.columns],
        *[f"coalesce({c}, CAST(0 AS {MONEY})) AS {c}" for c in CHARGE_COLUMNS],
    )
