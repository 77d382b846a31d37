"""Batch review: confirm or dismiss findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffscope.operators.upsert import first_per_key
from tariffscope.schemas import MONEY

STATUS_OF = {"confirm": "Confirmed", "dismiss": "Dismissed"}


@dataclass
class Reviewed:
    findings: DataFrame
    bills: DataFrame
    new_claims: DataFrame
    errors: DataFrame
    log: DataFrame
    outcomes: DataFrame


def apply_decisions(
    findings: DataFrame, bills: DataFrame, decisions: DataFrame, run_date: str | None = None
) -> Reviewed:
    """Apply (decision_no, analysis_id, action, note) rows.

    The first decision on a finding counts; findings already reviewed stay as
    they are. A claim's id comes from the finding, its run and the decision:
    replaying a batch makes no second claim, a later run's finding makes its own.
    Unknown ids and actions become error rows, and ``outcomes`` has every decision
    once. Every join key is unique on the findings and bills side.
    """
    first = first_per_key(decisions, "analysis_id", "decision_no")
    known = F.col("action").isin(*STATUS_OF)
    valid = first.filter(known)
    no_action = first.filter(~known | F.col("action").isNull()).select(
        "analysis_id", F.concat(F.lit("unknown action: "), F.coalesce("action", F.lit("none"))).alias("error")
    )
    no_finding = valid.join(findings.select("analysis_id"), "analysis_id", "left_anti").select(
        "analysis_id", F.lit("no such finding").alias("error")
    )

    taken = findings.filter(~F.col("reviewed")).join(valid, "analysis_id")
    outcomes = _outcomes(findings, decisions, first)
    marks = taken.select("analysis_id", F.lit(True).alias("_now"))
    new_findings = (
        findings.join(marks, "analysis_id", "left")
        .withColumn("reviewed", F.col("reviewed") | F.coalesce("_now", F.lit(False)))
        .select(*findings.columns)
    )

    status = F.when(F.col("action") == "confirm", STATUS_OF["confirm"]).otherwise(STATUS_OF["dismiss"])
    decided = taken.select("bill_id", status.alias("_status"))
    new_bills = (
        bills.join(decided, "bill_id", "left")
        .withColumn("anomaly_status", F.coalesce("_status", "anomaly_status"))
        .select(*bills.columns)
    )

    day = F.lit(run_date).cast("date") if run_date else F.current_date()
    note = F.coalesce("note", F.lit(""))
    reason = F.when(note == "", F.col("plain_english_reason")).otherwise(
        F.concat("plain_english_reason", F.lit(" Reviewer: "), note)
    )
    new_claims = taken.filter("action = 'confirm'").select(
        F.xxhash64("analysis_id", "detected_at", "decision_no").alias("claim_id"), "bill_id", day.alias("claim_date"),
        reason.alias("claim_reason"), F.col("potential_recovery").alias("amount_disputed"),
        F.lit(0).cast(MONEY).alias("amount_recovered"), F.lit("Open").alias("status"),
        F.lit(None).cast("string").alias("vendor_response"), F.lit(None).cast("date").alias("resolved_date"),
    )
    log = taken.select("analysis_id", "bill_id", "detected_at", "action", F.col("note"))
    return Reviewed(new_findings, new_bills, new_claims, no_finding.unionByName(no_action), log, outcomes)


def _outcomes(findings: DataFrame, decisions: DataFrame, first: DataFrame) -> DataFrame:
    """(decision_no, analysis_id, action, outcome) of every decision given."""
    counted = first.select("analysis_id", F.col("decision_no").alias("_first"))
    state = findings.select("analysis_id", F.col("reviewed").alias("_reviewed"))
    outcome = (
        F.when(F.col("_first").isNull() | (F.col("decision_no") != F.col("_first")), "repeated")
        .when(F.col("action").isNull() | ~F.col("action").isin(*STATUS_OF), "unknown action")
        .when(F.col("_reviewed").isNull(), "no such finding")
        .when(F.col("_reviewed"), "already reviewed")
        .otherwise("applied")
    )
    known = decisions.join(counted, "analysis_id", "left").join(state, "analysis_id", "left")
    return known.select("decision_no", "analysis_id", "action", outcome.alias("outcome"))
