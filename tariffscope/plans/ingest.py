"""Extractor answers to validated bills, line items and dimension rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tariffscope.functions import text as tx
from tariffscope.functions.dates import parse_date
from tariffscope.functions.numeric import AUDIT, MONEY, amount
from tariffscope.operators.upsert import absent_rows
from tariffscope.plans.audit_rules import PASSED_TEXT, charge_total, failed_text, misses
from tariffscope.schemas import EXTRACTED_EXTRAS, EXTRACTED_RECORD, UTILITY_TYPES

_CORRUPT = "_corrupt_record"
_PAYLOAD = T.StructType(
    EXTRACTED_RECORD.fields + EXTRACTED_EXTRAS.fields + [T.StructField(_CORRUPT, T.StringType())]
)


# --- documents -------------------------------------------------------------

# The marker line above each page.
PAGE_MARK, PAGE_MARK_END = "--- PAGE ", " ---\n"


def assemble_documents(
    pages: DataFrame, filter_pages: bool = True, pages_per_part: int | None = None
) -> DataFrame:
    """Billing pages of each document joined in page order under page markers.

    A document is one row, part 0. With ``pages_per_part`` a longer one continues in
    further rows, for readers that can't hold a whole document. What has no billing
    page keeps a row with empty text.
    """
    part = F.floor(F.col("page_no") / pages_per_part).cast("long") if pages_per_part else F.lit(0).cast("long")
    billing = tx.is_billing_page(F.col("text")) if filter_pages else F.lit(True)
    entry = F.struct("page_no", "text")
    grouped = (
        pages.withColumn("is_billing", billing)
        .groupBy("doc_id", part.alias("part"))
        .agg(
            F.count(F.lit(1)).alias("pages"),
            F.count_if("is_billing").alias("included"),
            F.array_sort(F.array_agg(F.when(F.col("is_billing"), entry))).alias("kept"),
        )
    )
    marked = F.transform(
        F.array_compact("kept"),
        lambda p: F.concat(F.lit(PAGE_MARK), p["page_no"] + 1, F.lit(PAGE_MARK_END), p["text"], F.lit("\n")),
    )
    return grouped.select("doc_id", "part", "pages", "included", F.array_join(marked, "").alias("text"))


# --- extraction hook -------------------------------------------------------

def extract(
    documents: DataFrame,
    extractor: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None,
) -> DataFrame:
    """(record_id, source_file, text) to (record_id, source_file, payload).

    ``extractor`` is a mapInPandas function given ``record_id, source_file, prompt,
    text`` batches, where the prompt is the cleaned text and the opening of the raw
    one, and the text is the whole raw one, for the extractor to cut.
    Without it labelled amounts are read by patterns.
    """
    if extractor is None:
        return documents.select("record_id", "source_file", _pattern_payload().alias("payload"))
    prompt = F.concat(tx.clean_lines(F.col("text")), F.lit("\n\n"), F.substring("text", 1, 300))
    kind = documents.schema["record_id"].dataType.simpleString()
    return documents.select("record_id", "source_file", prompt.alias("prompt"), "text").mapInPandas(
        extractor, f"record_id {kind}, source_file string, payload string"
    )


# The last amount of the line; cents end there, and a factor ("0.07 x 304 kWh") is no amount.
_AMOUNT = r".*(?<![0-9.,])([0-9][0-9,]*\.[0-9]{2})(?![0-9])(?!\s*x\b)"
_DAY = r"([0-9]{4}-[0-9]{2}-[0-9]{2})"
_PERIOD = r"(?i)(?:service|billing) period[^0-9\n]*"
_LABELS = {
    "total_amount_due": "(?:total )?amount due",
    "delivery_charge": "(?:total )?delivery(?: services| charge)?",
    "supply_charge": "(?:total )?supply(?: services| charge)?",
    "demand_charge": "demand charge",
    "fixed_monthly_charge": "(?:basic service|fixed monthly)(?: charge)?",
    "taxes_and_surcharges": "(?:total other charges|taxes)[a-z &/]*",
    "credits": "(?:credits?|balance forward)",
}


def _captured(pattern: str) -> Column:
    return F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))


def _pattern_payload() -> Column:
    def money(label):
        found = _captured(f"(?i){label}{_AMOUNT}")
        return F.coalesce(F.regexp_replace(found, ",", "").try_cast("double"), F.lit(0.0))

    unit = F.when(F.col("text").rlike(r"(?i)\bkwh\b"), "kWh").when(
        F.col("text").rlike(r"(?i)\btherms?\b"), "Therms"
    ).when(F.col("text").rlike(r"(?i)\bccf\b"), "CCF")
    return F.to_json(
        F.struct(
            _captured(r"(?im)^\s*(?:provider|vendor)(?: name)?\s*:?\s*(\S.*?)\s*$").alias("provider_name"),
            _captured(r"(?i)account (?:number|no\.?)\s*:?\s*([0-9][0-9 -]*[0-9])").alias("account_number"),
            F.when(unit == "kWh", "Electric").when(unit.isNotNull(), "Gas").otherwise("Unknown").alias("utility_type"),
            _captured(rf"(?i)(?:statement|billing) date\s*:?\s*{_DAY}").alias("statement_date"),
            _captured(_PERIOD + _DAY).alias("service_period_start"),
            _captured(rf"{_PERIOD}[0-9-]+[^0-9\n]+{_DAY}").alias("service_period_end"),
            F.regexp_replace(
                _captured(r"(?i)(?:usage|consumption)[^0-9\n]*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(?:kwh|therms?|ccf)\b"), ",", ""
            ).try_cast("double").alias("usage_volume"),
            _captured(r"(?i)rate(?: code)?\s*:?\s*\b([A-Z]{1,4}-?[0-9][A-Z0-9-]*)").alias("rate_code"),
            unit.alias("usage_unit"),
            *[money(label).alias(name) for name, label in _LABELS.items()],
            F.lit(False).alias("is_anomaly_detected"),
        )
    )


# --- records ---------------------------------------------------------------

def parse_records(answers: DataFrame) -> DataFrame:
    """Payload text to typed columns; form field names are accepted as aliases.

    The parsed struct is unfolded by a generator, so later filters cannot be
    pushed below it and repeat the parsing for every field they mention.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _PAYLOAD)
    # Text after the object, an empty answer and any error key are refused.
    whole = r"trim(answer) RLIKE r'(?s)^\{.*\}\z'"
    parsed = (
        f"from_json(IF({whole}, answer, NULL), '{schema}', "
        f"map('mode', 'PERMISSIVE', 'columnNameOfCorruptRecord', '{_CORRUPT}'))"
    )
    aliases = {
        "statement_date": "coalesce(statement_date, billing_date)",
        "taxes_and_surcharges": "coalesce(taxes_and_surcharges, taxes_surcharges)",
    }
    dropped = {"billing_date", "taxes_surcharges", "error", _CORRUPT, *aliases}
    return (
        answers.select(
            "record_id", tx.base_name(F.col("source_file")).alias("source_file"),
            tx.strip_fences(F.col("payload")).alias("answer"), F.xxhash64("source_file", "payload").alias("answer_hash"),
        )
        .selectExpr(
            "record_id", "source_file", "answer_hash", f"NOT coalesce({whole}, false) AS no_object",
            # The keys are parsed only where the word occurs, or an escape that may spell it.
            r"coalesce((contains(answer, 'error') OR contains(answer, r'\')) "
            "AND array_contains(json_object_keys(answer), 'error'), false) AS has_error", f"inline(array({parsed}))",
        )
        .selectExpr(
            "record_id", "source_file", "answer_hash", *[f.name for f in _PAYLOAD if f.name not in dropped],
            *[f"{text} AS {name}" for name, text in aliases.items()],
            f"CASE WHEN no_object OR {_CORRUPT} IS NOT NULL THEN 'malformed' "
            "WHEN has_error THEN 'extractor_error' ELSE 'read' END AS read_status",
        )
    )


def conformance(rows: DataFrame) -> DataFrame:
    """Add ``conformance_issues``: required fields and enums as the extractor delivered them."""
    required = ("provider_name", "account_number", "utility_type", "total_amount_due", "is_anomaly_detected")
    issues = [f"IF({c} IS NULL, 'missing {c}', NULL)" for c in required] + [
        f"IF(utility_type NOT IN {UTILITY_TYPES}, 'unlisted utility_type', NULL)",
        "IF(usage_unit NOT IN ('kWh', 'Therms'), 'unlisted usage_unit', NULL)",
    ]
    return rows.selectExpr("*", f"{_listed(issues)} AS conformance_issues")


def _listed(texts: list[str]) -> str:
    return f"array_compact(array({', '.join(texts)}))"


def _replacing(rows: DataFrame, changed: dict[str, str]) -> DataFrame:
    """Swap columns for SQL expressions; names new to the frame are appended."""
    kept = [c for c in rows.columns if c not in changed]
    return rows.selectExpr(*kept, *[f"{text} AS {name}" for name, text in changed.items()])


def normalise(rows: DataFrame) -> DataFrame:
    """CCF is labelled Therms, the unit decides the utility, account digits only, credits positive."""
    unit = "CASE usage_unit WHEN 'CCF' THEN 'Therms' ELSE usage_unit END"
    utility = "CASE usage_unit WHEN 'kWh' THEN 'Electric' WHEN 'Therms' THEN 'Gas' ELSE utility_type END"
    united = _replacing(rows, {"usage_unit": unit, "credits": "abs(credits)"})
    return _replacing(united, {"utility_type": utility}).withColumn(
        "account_number", tx.plain_account_number(F.col("account_number"))
    )


def coerce_codes(rows: DataFrame) -> DataFrame:
    """Codes outside their lists become Unknown."""
    return _replacing(
        rows,
        {
            "utility_type": "IF(utility_type IN ('Electric', 'Gas'), utility_type, 'Unknown')",
            "usage_unit": "IF(usage_unit IN ('kWh', 'Therms'), usage_unit, 'Unknown')",
        },
    )


def math_audit(rows: DataFrame) -> DataFrame:
    """Add charge total, discrepancy, flag and reason; any delivered flag is overwritten."""
    due, failed = amount("total_amount_due"), misses("discrepancy")
    totalled = rows.selectExpr("*", f"{charge_total()} AS charge_total")
    compared = totalled.selectExpr("*", f"CAST(abs(charge_total - {due}) AS {AUDIT}) AS discrepancy")
    return _replacing(
        compared,
        {
            "is_anomaly_detected": failed,
            "anomaly_reason": f"IF({failed}, {failed_text('charge_total', due)}, '{PASSED_TEXT}')",
        },
    )


def form_audit(rows: DataFrame) -> DataFrame:
    """Reviewer variant: no fixed charge, three verdicts, and the missing fields."""
    due = amount("total_amount_due")
    gaps = [
        f"IF(coalesce({column}, '') = '', '{shown}', NULL)"
        for column, shown in (
            ("provider_name", "provider_name"), ("account_number", "account_number"), ("statement_date", "billing_date")
        )
    ] + [f"IF({due} = 0, 'total_amount_due', NULL)"]
    return (
        rows.selectExpr("*", f"{charge_total(include_fixed=False)} AS form_total")
        .selectExpr("*", f"CAST(abs(form_total - {due}) AS {AUDIT}) AS form_discrepancy")
        .selectExpr(
            "*",
            f"CASE WHEN {due} <= 0 OR form_total <= 0 THEN 'not checkable' "
            f"WHEN {misses('form_discrepancy')} THEN 'mismatch' ELSE 'agrees' END AS form_verdict",
            f"{_listed(gaps)} AS missing_fields",
        )
    )


def gate(rows: DataFrame) -> DataFrame:
    """Add ``reject_reasons`` and ``status`` (accepted or rejected)."""
    read = "read_status = 'read'"
    reasons = [
        "IF(record_id IS NULL, 'no record id', NULL)",
        f"IF(NOT {read}, read_status, NULL)",
        f"IF({read} AND coalesce(provider_name, '') IN ('', 'UNKNOWN'), 'no provider', NULL)",
        f"IF({read} AND NOT coalesce(account_number, '') RLIKE r'^[0-9]{{5,}}\\z', 'bad account number', NULL)",
        f"IF({read} AND {amount('total_amount_due')} <= 0, 'no positive total', NULL)",
    ]
    return rows.selectExpr("*", f"{_listed(reasons)} AS reject_reasons").selectExpr(
        "*", "IF(size(reject_reasons) = 0, 'accepted', 'rejected') AS status"
    )


def process(answers: DataFrame) -> DataFrame:
    """Extractor answers to gated records: one map-only plan, a status on every row."""
    return gate(math_audit(coerce_codes(normalise(conformance(parse_records(answers))))))


def batch_summary(processed: DataFrame) -> DataFrame:
    return processed.groupBy("status").agg(F.count(F.lit(1)).alias("records"))


# --- store -----------------------------------------------------------------

_CHARGES = (
    ("Fixed Monthly Charge", "fixed_monthly_charge"), ("Delivery Charge", "delivery_charge"),
    ("Supply Charge", "supply_charge"), ("Demand Charge", "demand_charge"),
    ("Taxes and Surcharges", "taxes_and_surcharges"), ("Credit", "credits"),
)


def line_items(accepted: DataFrame) -> DataFrame:
    """One row per non-zero charge; credits are stored negative."""

    def item(category: str, column: str) -> str:
        value = f"coalesce(TRY_CAST({column} AS {MONEY}), CAST(0 AS {MONEY}))"
        price = f"-abs({value})" if category == "Credit" else value
        return f"struct('{category}' AS category, CAST({price} AS {MONEY}) AS total_price)"

    items = ", ".join(item(*c) for c in _CHARGES)
    return (
        accepted.selectExpr("bill_id", f"inline(array({items}))")
        .filter("total_price <> 0")
        .selectExpr(
            "xxhash64(bill_id, category) AS item_id", "bill_id", "category",
            "CAST(NULL AS STRING) AS description", "total_price",
        )
    )


@dataclass
class Intake:
    """What one batch adds to the store."""

    bills: DataFrame
    line_items: DataFrame
    new_vendors: DataFrame
    new_accounts: DataFrame
    quarantine: DataFrame


def intake(processed: DataFrame, vendors: DataFrame, accounts: DataFrame, audit_time: str | None = None) -> Intake:
    """Split gated records and resolve their dimensions, from accepted rows only.

    Ids are hashes of natural keys, so a retried batch yields the same rows. Known
    vendors and accounts keep their ids; a known account keeps its vendor.
    """
    accepted = processed.filter("status = 'accepted'").selectExpr("*", "xxhash64(record_id) AS bill_id")
    new_vendors = absent_rows(
        accepted.selectExpr("provider_name AS vendor_name", "record_id"), vendors, "vendor_name", "record_id"
    ).selectExpr("xxhash64(vendor_name) AS vendor_id", "vendor_name", "CAST(NULL AS STRING) AS vendor_type")
    known_vendors = vendors.selectExpr("vendor_name", "vendor_id AS known_vendor")
    new_accounts = (
        absent_rows(
            accepted.selectExpr("account_number", "provider_name AS vendor_name", "meter_number", "record_id"),
            accounts, "account_number", "record_id",
        )
        .join(known_vendors, "vendor_name", "left")
        .selectExpr(
            "xxhash64(account_number) AS account_id", "CAST(NULL AS BIGINT) AS property_id",
            "coalesce(known_vendor, xxhash64(vendor_name)) AS vendor_id", "account_number", "meter_number",
            "CAST(NULL AS STRING) AS rate_code",
        )
    )
    known = accounts.selectExpr("account_number", "account_id AS known_account")
    stamp = f"TIMESTAMP '{audit_time}'" if audit_time else "current_timestamp()"
    bills = accepted.join(known, "account_number", "left").selectExpr(
        "bill_id", "coalesce(known_account, xxhash64(account_number)) AS account_id", "utility_type",
        f"{parse_date('statement_date')} AS billing_date",
        f"{parse_date('service_period_start')} AS service_period_start",
        f"{parse_date('service_period_end')} AS service_period_end",
        f"{parse_date('due_date')} AS due_date",
        f"TRY_CAST(total_amount_due AS {MONEY}) AS total_amount",
        "coalesce(usage_volume, 0D) AS usage_volume", "usage_unit", "coalesce(demand_read, 0D) AS demand_read",
        "CAST(NULL AS STRING) AS demand_unit", "rate_code", "tariff_code", "is_anomaly_detected", "anomaly_reason",
        "'Unreviewed' AS anomaly_status", f"{stamp} AS audit_timestamp", "source_file",
    )
    rejected = processed.filter("status = 'rejected'").select(
        "record_id", "source_file", "provider_name", "account_number", "total_amount_due",
        "reject_reasons", "conformance_issues",
    )
    return Intake(bills, line_items(accepted), new_vendors, new_accounts, rejected)
