"""Findings: at most one per bill, explained and priced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffscope.functions.dates import month_name
from tariffscope.functions.numeric import AUDIT, MONEY, ZERO, money_total
from tariffscope.functions.severity import severity
from tariffscope.functions.text import dollars
from tariffscope.plans.audit_rules import DISCREPANCY_PATTERN, FAILED_MARK
from tariffscope.plans.features import MIN_HISTORY
from tariffscope.plans.weather import with_weather

# Limits of the finding rules.
MIN_DISCREPANCY = "0.01"
CONFIRMED_PCT = 20
MILD, HARSH = 0.8, 1.2


def stated_discrepancy(reason: str) -> str:
    """SQL text: amount named in an audit-failure reason; 0 if the reason names none."""
    named = f"nullif(regexp_extract({reason}, r'{DISCREPANCY_PATTERN}', 1), '')"
    return f"coalesce(CASE WHEN contains({reason}, '{FAILED_MARK}') THEN TRY_CAST({named} AS {AUDIT}) END, {ZERO})"


_LAYER = f"""CASE WHEN is_math THEN 'MATH'
    WHEN weather_available AND NOT weather_explains AND abs(pct_above_monthly) > {CONFIRMED_PCT} THEN 'COMBINED'
    ELSE 'ML' END"""

_TYPE = f"""CASE WHEN is_math THEN 'MATH_ERROR'
    WHEN weather_available AND weather_explains THEN 'WEATHER_DRIVEN'
    WHEN weather_available AND rising AND weather_actual < weather_historical * {MILD}D THEN 'WEATHER_UNEXPLAINED_SPIKE'
    WHEN weather_available AND NOT rising AND weather_actual > weather_historical * {HARSH}D THEN 'WEATHER_UNEXPLAINED_DROP'
    WHEN rising THEN 'USAGE_SPIKE' ELSE 'USAGE_DROP' END"""


#: Comparisons with a month need one.
_DATED = "CASE WHEN billing_date IS NOT NULL THEN"


def _whole(value: str) -> str:
    return f"format_number({value}, 0)"


def _explanation() -> str:
    """SQL text of the sentence an auditor reads."""
    years = "greatest(1, account_bill_count DIV 12)"
    pair = f"{_whole('weather_actual')}, ' ', weather_metric, ' against a usual ', {_whole('weather_historical')}"
    math = (
        "concat('The listed charges of this ', lower(utility_type), ' bill miss its total by ', "
        f"{dollars('math_recovery', 2)}, '. Ask the vendor to correct the total.')"
    )
    opening = (
        f"'At ', {dollars('CAST(total_amount AS DOUBLE)')}, ', this ', lower(utility_type), ' bill is ', "
        f"{_whole('abs(pct_above_monthly)')}, '% ', IF(rising, 'above', 'below'), "
        f"\" the account's mean for \", {month_name('month')}, ' of ', {dollars('monthly_mean')}, "
        f"' (', {years}, IF({years} = 1, ' year', ' years'), ' of bills).'"
    )
    caution = "IF(rising, '', ' Check the meter and the service for a fault.')"
    weather = f"""CASE WHEN NOT weather_available THEN ''
        WHEN weather_explains THEN concat(" The month's weather was ", {_whole('abs(weather_deviation_pct)')},
            '% harsher than usual (', {pair}, '), which accounts for part of the change.')
        WHEN finding_type = 'WEATHER_UNEXPLAINED_SPIKE'
            THEN concat(' The month was mild (', {pair}, '), so weather cannot be the cause.')
        WHEN finding_type = 'WEATHER_UNEXPLAINED_DROP'
            THEN concat(' The month was harsh (', {pair}, '), so a low bill is odd.')
        ELSE " The month's weather was ordinary and does not account for it." END"""
    return f"CASE WHEN is_math THEN {math} ELSE concat({opening}, {caution}, {weather}) END"


def judged(scored: DataFrame, weather: DataFrame, min_history: int = MIN_HISTORY) -> DataFrame:
    """Bills that carry a finding, with every column the finding needs.

    ``scored`` holds engineered bills plus ``ml_flagged`` and
    ``ml_anomaly_probability``. An arithmetic error needs no date; undated bills
    that are only flagged are listed by ``undated_flags``.
    """
    reason = "IF(is_anomaly_detected, coalesce(anomaly_reason, ''), '')"
    is_math = f"math_recovery > {MIN_DISCREPANCY}BD"
    # Unremarkable bills leave before the weather join.
    chosen = (
        scored.selectExpr("*", f"{stated_discrepancy(reason)} AS math_recovery")
        .selectExpr("*", f"{is_math} AS is_math", "pct_above_monthly > 0 AS rising")
        .filter(f"is_math OR (ml_flagged AND billing_date IS NOT NULL AND account_bill_count >= {min_history})")
    )
    # Exact decimals: a mean of two bills often ends in half a cent.
    bills = "CAST(monthly_bills AS DECIMAL(12,0))"
    over = f"greatest(0BD, CAST(total_amount * {bills} - monthly_spend AS DECIMAL(24,2)) / {bills})"
    return (
        with_weather(chosen, weather)
        .selectExpr(
            "*", f"{_LAYER} AS detection_layer", f"{_TYPE} AS finding_type",
            f"IF(is_math, math_recovery, {over}) AS recovery", f"monthly_spend / {bills} AS expected",
            "IF(is_math, 1D, ml_anomaly_probability) AS probability",
        )
        .selectExpr("*", f"{severity('recovery')} AS severity")
    )


def findings(
    scored: DataFrame, weather: DataFrame, min_history: int = MIN_HISTORY, run_time: str | None = None
) -> DataFrame:
    """The findings table. A bill has at most one finding, so its id is the finding's id."""
    stamp = f"TIMESTAMP '{run_time}'" if run_time else "current_timestamp()"
    return judged(scored, weather, min_history).selectExpr(
        "bill_id AS analysis_id", "bill_id", "detection_layer", "finding_type", "severity",
        f"CAST(bround(expected, 2) AS {MONEY}) AS expected_value",
        f"CAST(total_amount AS {MONEY}) AS actual_value",
        f"{_DATED} bround(pct_above_monthly, 2) END AS deviation_pct",
        "bround(zscore_monthly, 3) AS zscore_monthly", "bround(zscore_overall, 3) AS zscore_overall",
        f"{_DATED} bround(weather_actual, 1) END AS weather_actual",
        f"{_DATED} bround(weather_historical, 1) END AS weather_historical",
        "bround(probability, 4) AS anomaly_probability",
        f"{_explanation()} AS plain_english_reason",
        f"CAST(bround(recovery, 2) AS {MONEY}) AS potential_recovery",
        f"{stamp} AS detected_at", "false AS reviewed",
    )


def undated_flags(scored: DataFrame, min_history: int = MIN_HISTORY) -> DataFrame:
    """Flagged bills that a missing date keeps out of the findings, measured against their account's overall mean."""
    return scored.filter(f"billing_date IS NULL AND ml_flagged AND account_bill_count >= {min_history}").select(
        "bill_id", "account_id", "total_amount", "overall_mean", "pct_above_overall", "zscore_overall", "ml_anomaly_probability"
    )


def carry_reviewed(fresh: DataFrame, previous: DataFrame) -> DataFrame:
    """Keep the reviewed mark of findings that an earlier run already had in the same layer."""
    seen = previous.filter("reviewed").selectExpr("analysis_id", "detection_layer", "true AS seen")
    kept = [c if c != "reviewed" else "reviewed OR coalesce(seen, false) AS reviewed" for c in fresh.columns]
    return fresh.join(seen, ["analysis_id", "detection_layer"], "left").selectExpr(*kept)


def run_totals(found: DataFrame) -> DataFrame:
    """Findings, urgent, high and total recovery of a run, in one row."""
    return found.agg(
        F.expr("count(*) AS findings"), F.expr("count_if(severity = 'URGENT') AS urgent"),
        F.expr("count_if(severity = 'HIGH') AS high"), F.expr(f"{money_total('potential_recovery')} AS recovery"),
    )


def rule_scores(features: DataFrame, limit: float = 1.5) -> DataFrame:
    """Flag bills far from their account's mean, in place of a trained model."""
    return features.selectExpr(
        "*",
        f"abs(zscore_overall) >= {limit}D AND account_bill_count >= {MIN_HISTORY} AS ml_flagged",
        "least(1D, abs(zscore_overall) / 3) AS ml_anomaly_probability",
    )
