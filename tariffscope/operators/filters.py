"""Optional predicates: each is skipped when its argument is empty."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffscope.functions.dates import in_year
from tariffscope.functions.text import contains_pattern


def equals(column: str, value) -> list[Column]:
    return [F.col(column) == value] if value else []


def contains(column: str, wanted: str | None) -> list[Column]:
    return [contains_pattern(F.col(column), wanted)] if wanted else []


def between_days(column: str, start: str | None, end: str | None) -> list[Column]:
    found = []
    if start:
        found.append(F.col(column) >= F.lit(start).cast("date"))
    if end:
        found.append(F.col(column) <= F.lit(end).cast("date"))
    return found


def year_is(column: str, year: int | None) -> list[Column]:
    return [F.expr(in_year(column, year))] if year else []


def stored_years(df: DataFrame, start: str | None, end: str | None) -> list[Column]:
    """Bounds on the folder column of stored bills that follow from bounds on their day; none where it is missing.

    Bills without a day lie in a folder without a year, which no range of days holds.
    """
    if "billing_year" not in df.columns:
        return []
    year = F.col("billing_year")
    return ([year >= int(start[:4])] if start else []) + ([year <= int(end[:4])] if end else [])


def unreviewed(show_reviewed: bool) -> list[Column]:
    return [] if show_reviewed else [~F.col("reviewed")]


def where_all(df: DataFrame, *groups: list[Column]) -> DataFrame:
    predicates = [p for group in groups for p in group]
    return df.filter(reduce(and_, predicates)) if predicates else df


def positive_total(bills: DataFrame) -> DataFrame:
    return bills.filter(F.col("total_amount") > 0)


def with_history(df: DataFrame, min_history: int = 12) -> DataFrame:
    """Rows of accounts with enough bills to judge."""
    return df.filter(F.col("account_bill_count") >= min_history)
