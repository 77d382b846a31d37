"""Date helpers. Missing and unreadable dates are null."""

from __future__ import annotations


def parse_date(text: str) -> str:
    """ISO text to DATE; empty or unreadable text becomes null instead of failing."""
    return f"try_to_date(nullif(trim({text}), ''), 'yyyy-MM-dd')"


def month_name(month: str) -> str:
    return f"date_format(make_date(2000, {month}, 1), 'MMMM')"


def year_month(day: str) -> str:
    return f"date_format({day}, 'yyyy-MM')"


def in_year(day: str, year: int) -> str:
    """Range test, so that it prunes partitions and reaches the Parquet scan."""
    return f"{day} BETWEEN DATE '{int(year):04d}-01-01' AND DATE '{int(year):04d}-12-31'"


def month_bounds(year: str, month: str) -> tuple[str, str]:
    """First and last day of a month as ISO text."""
    first = f"make_date({year}, {month}, 1)"
    return f"date_format({first}, 'yyyy-MM-dd')", f"date_format(last_day({first}), 'yyyy-MM-dd')"
