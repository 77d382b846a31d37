"""The arithmetic audit of one bill, and the reason texts it stores (SQL text)."""

from __future__ import annotations

from tariffscope.functions.numeric import AUDIT, MONEY, amount

# Later runs and other tools find audit failures by these words.
FAILED_MARK = "MATH AUDIT FAILED"
DISCREPANCY_MARK = "Discrepancy of $"
DISCREPANCY_PATTERN = r"Discrepancy of \$([0-9]+(?:\.[0-9]+)?)"
TOLERANCE = "0.02"

PASSED_TEXT = "Charges and total agree."
UNPRICED_TEXT = f"{FAILED_MARK}. A charge is out of line with this account."


def failed_text(charges: str, total: str) -> str:
    return (
        f"concat('{FAILED_MARK}. The charges come to $', CAST({charges} AS {MONEY}), "
        f"' and the bill asks for $', CAST({total} AS {MONEY}), "
        f"'. {DISCREPANCY_MARK}', CAST(abs({charges} - {total}) AS {MONEY}), '.')"
    )


def charge_total(include_fixed: bool = True) -> str:
    """Charges less credits; a missing charge counts as 0."""
    names = ["delivery_charge", "supply_charge", "demand_charge", "taxes_and_surcharges"]
    if include_fixed:
        names = ["fixed_monthly_charge", *names]
    added = " + ".join(amount(n) for n in names)
    return f"CAST({added} - {amount('credits')} AS {AUDIT})"


def misses(discrepancy: str) -> str:
    return f"{discrepancy} > {TOLERANCE}BD"
