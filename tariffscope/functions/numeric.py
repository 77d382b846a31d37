"""Guarded arithmetic that is safe under ANSI mode."""

from __future__ import annotations

MONEY = "DECIMAL(18,2)"
AUDIT = "DECIMAL(24,6)"  # keeps sub-cent digits while auditing
ZERO = f"CAST(0 AS {AUDIT})"


def ratio(top: str, bottom: str, otherwise: float) -> str:
    """top / bottom where bottom is positive, else ``otherwise``."""
    return (
        f"CASE WHEN {bottom} > 0 THEN CAST({top} AS DOUBLE) / CAST({bottom} AS DOUBLE) "
        f"ELSE CAST({otherwise} AS DOUBLE) END"
    )


def percent_above(value: str, base: str) -> str:
    """How far ``value`` lies above ``base`` in percent; null without a base."""
    return f"CASE WHEN {base} <> 0 THEN ({value} - {base}) / {base} * 100 END"


def usable_std(std: str) -> str:
    """A spread to divide by: missing or zero becomes 1."""
    return f"coalesce(nullif({std}, 0D), 1D)"


def mean_money(total: str, count: str) -> str:
    """Exact decimal mean of a money sum, to the cent, halves away from zero; null of nothing."""
    whole = f"CAST(nullif({count}, 0) AS DECIMAL(12,0))"
    return f"CAST(round(CAST({total} AS DECIMAL(24,2)) / {whole}, 2) AS {MONEY})"


def percent_change(before: str, after: str) -> str:
    """Change from ``before`` to ``after`` in percent, one decimal; 0 if either is null or 0."""
    a, b = f"CAST({before} AS DOUBLE)", f"CAST({after} AS DOUBLE)"
    return f"CASE WHEN {before} <> 0 AND {after} <> 0 THEN bround(({b} - {a}) / {a} * 100, 1) ELSE 0D END"


def trend(change: str) -> str:
    return f"CASE WHEN {change} > 0 THEN 'UP' ELSE 'DOWN' END"


def money_total(value: str) -> str:
    """Sum of a money column, 0 over no rows."""
    return f"CAST(coalesce(sum({value}), 0) AS {MONEY})"


def amount(value: str) -> str:
    """Number to audit with; 0 if missing or not a number."""
    return f"coalesce(TRY_CAST({value} AS {AUDIT}), {ZERO})"
