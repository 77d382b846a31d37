"""Two-period comparison for one account or for all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffscope.functions.numeric import MONEY, mean_money, percent_change, trend


def _day(text: str) -> str:
    year, month, day = (int(part) for part in text.split("-"))
    return f"DATE '{year:04d}-{month:02d}-{day:02d}'"


def compare(
    bills: DataFrame, accounts: DataFrame, first: tuple[str, str], second: tuple[str, str],
    account_number: str | None = None,
) -> DataFrame:
    """One pass over the bills of both periods, conditional sums per account.

    Bills are reduced per account before account numbers are attached, so a hot
    account never meets the join as detail rows. Accounts without bills in either
    period show zero counts.
    """
    sides = {
        tag: f"(billing_date BETWEEN {_day(a)} AND {_day(b)})" for tag, (a, b) in (("p1", first), ("p2", second))
    }
    sums, shown = [], []
    for tag, inside in sides.items():
        sums += [
            f"count_if({inside}) AS {tag}_bills",
            f"sum(total_amount) FILTER (WHERE {inside}) AS {tag}_spend",
            f"sum(usage_volume) FILTER (WHERE {inside}) AS {tag}_usage",
            f"count(usage_volume) FILTER (WHERE {inside}) AS {tag}_metered",
            f"count_if({inside} AND is_anomaly_detected) AS {tag}_flagged",
        ]
        shown += [
            f"coalesce({tag}_bills, 0) AS {tag}_bills",
            f"CAST({tag}_spend AS {MONEY}) AS {tag}_spend",
            f"{mean_money(f'{tag}_spend', f'{tag}_bills')} AS {tag}_avg_bill",
            f"round({tag}_usage, 2) AS {tag}_usage",
            f"round({tag}_usage / nullif({tag}_metered, 0), 2) AS {tag}_avg_usage",
            f"coalesce({tag}_flagged, 0) AS {tag}_flagged",
        ]
    numbers = accounts.select("account_id", "account_number")
    facts = bills.filter(" OR ".join(sides.values()))
    if account_number:
        numbers = numbers.filter(F.col("account_number") == account_number)
        # The number is unique: this is a lookup of one account's bills.
        facts = facts.join(numbers.select("account_id"), "account_id", "left_semi")
    sums_per_account = facts.groupBy("account_id").agg(*map(F.expr, sums))
    return (
        numbers.join(sums_per_account, "account_id", "left")
        .selectExpr("account_number", *shown)
        .selectExpr(
            "*",
            f"{percent_change('p1_spend', 'p2_spend')} AS spend_change_pct",
            f"{percent_change('p1_usage', 'p2_usage')} AS usage_change_pct",
        )
        .selectExpr(
            "*",
            f"{trend('spend_change_pct')} AS spend_trend", f"{trend('usage_change_pct')} AS usage_trend",
        )
    )
