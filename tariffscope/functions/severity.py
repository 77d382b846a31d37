"""Severity from the money at stake, and its sort rank."""

from __future__ import annotations

# Lowest recoverable amount of each severity, highest first.
THRESHOLDS = (("URGENT", 5000), ("HIGH", 1000), ("MEDIUM", 200))
LOWEST = "LOW"
ORDER = ("URGENT", "HIGH", "MEDIUM", "LOW")


def severity(recovery: str) -> str:
    steps = " ".join(f"WHEN {recovery} >= {floor} THEN '{name}'" for name, floor in THRESHOLDS)
    return f"CASE {steps} ELSE '{LOWEST}' END"


def severity_rank(code: str) -> str:
    steps = " ".join(f"WHEN '{name}' THEN {place}" for place, name in enumerate(ORDER, start=1))
    return f"CASE {code} {steps} END"
