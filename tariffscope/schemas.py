"""Declared table schemas and the rules Parquet does not enforce by itself."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_TEXT, _ID, _REAL, _DAY = T.StringType(), T.LongType(), T.DoubleType(), T.DateType()
_FLAG, _TIME = T.BooleanType(), T.TimestampType()

CLIENTS = _struct(
    client_id=_ID, client_name=_TEXT, industry=_TEXT, contact_name=_TEXT,
    contact_email=_TEXT, contact_phone=_TEXT, date_onboarded=_DAY, is_active=_FLAG,
)
PROPERTIES = _struct(
    property_id=_ID, client_id=_ID, address=_TEXT, city=_TEXT, state=_TEXT,
    zip_code=_TEXT, property_name=_TEXT,
)
VENDORS = _struct(vendor_id=_ID, vendor_name=_TEXT, vendor_type=_TEXT)
ACCOUNTS = _struct(
    account_id=_ID, property_id=_ID, vendor_id=_ID, account_number=_TEXT,
    meter_number=_TEXT, rate_code=_TEXT,
)
BILLS = _struct(
    bill_id=_ID, account_id=_ID, utility_type=_TEXT, billing_date=_DAY,
    service_period_start=_DAY, service_period_end=_DAY, due_date=_DAY,
    total_amount=MONEY, usage_volume=_REAL, usage_unit=_TEXT, demand_read=_REAL,
    demand_unit=_TEXT, rate_code=_TEXT, tariff_code=_TEXT, is_anomaly_detected=_FLAG,
    anomaly_reason=_TEXT, anomaly_status=_TEXT, audit_timestamp=_TIME, source_file=_TEXT,
)
LINE_ITEMS = _struct(
    item_id=_ID, bill_id=_ID, category=_TEXT, description=_TEXT, total_price=MONEY
)
AUDIT_CLAIMS = _struct(
    claim_id=_ID, bill_id=_ID, claim_date=_DAY, claim_reason=_TEXT,
    amount_disputed=MONEY, amount_recovered=MONEY, status=_TEXT,
    vendor_response=_TEXT, resolved_date=_DAY,
)
FINDINGS = _struct(
    analysis_id=_ID, bill_id=_ID, detection_layer=_TEXT, finding_type=_TEXT,
    severity=_TEXT, expected_value=MONEY, actual_value=MONEY, deviation_pct=_REAL,
    zscore_monthly=_REAL, zscore_overall=_REAL, weather_actual=_REAL,
    weather_historical=_REAL, anomaly_probability=_REAL, plain_english_reason=_TEXT,
    potential_recovery=MONEY, detected_at=_TIME, reviewed=_FLAG,
)
WEATHER_DAILY = _struct(obs_date=_DAY, lat=_REAL, lon=_REAL, tmax=_REAL, tmin=_REAL)
WEATHER_RESPONSE = T.StructType(
    [
        T.StructField("latitude", _REAL),
        T.StructField("longitude", _REAL),
        T.StructField(
            "daily",
            T.StructType(
                [
                    T.StructField("time", T.ArrayType(_TEXT)),
                    T.StructField("temperature_2m_max", T.ArrayType(_REAL)),
                    T.StructField("temperature_2m_min", T.ArrayType(_REAL)),
                ]
            ),
        ),
    ]
)

EXTRACTED_RECORD = _struct(
    provider_name=_TEXT, account_number=_TEXT, utility_type=_TEXT, statement_date=_TEXT,
    service_period_start=_TEXT, service_period_end=_TEXT, total_amount_due=_REAL,
    usage_volume=_REAL, usage_unit=_TEXT, rate_code=_TEXT, fixed_monthly_charge=_REAL,
    delivery_charge=_REAL, supply_charge=_REAL, demand_charge=_REAL,
    taxes_and_surcharges=_REAL, credits=_REAL, is_anomaly_detected=_FLAG,
    anomaly_reason=_TEXT,
)
# Names a review form may send instead, and extras it may add.
EXTRACTED_EXTRAS = _struct(
    billing_date=_TEXT, taxes_surcharges=_REAL, due_date=_TEXT, meter_number=_TEXT,
    demand_read=_REAL, tariff_code=_TEXT, error=_TEXT,
)

QUARANTINE = _struct(
    record_id=_TEXT, source_file=_TEXT, provider_name=_TEXT, account_number=_TEXT, total_amount_due=_REAL,
    reject_reasons=T.ArrayType(_TEXT), conformance_issues=T.ArrayType(_TEXT),
)
#: Records whose bills are stored, and what became of each document of a batch.
TAKEN = _struct(record_id=_TEXT)
DOCUMENT_STATUS = _struct(
    record_id=_TEXT, source_file=_TEXT, route=_TEXT, pages=_ID, included=_ID, answers=_ID, status=_TEXT,
    reject_reasons=T.ArrayType(_TEXT), bill_id=_ID,
)
REVIEWS = _struct(analysis_id=_ID, bill_id=_ID, detected_at=_TIME, action=_TEXT, note=_TEXT)
DECISIONS = _struct(decision_no=_ID, analysis_id=_ID, action=_TEXT, note=_TEXT)

# The allowed codes of the enumerated columns.
UTILITY_TYPES = ("Electric", "Gas", "Unknown")
USAGE_UNITS = ("kWh", "Therms", "Unknown")
VENDOR_TYPES = ("Electric", "Gas", "Both", "Other")
ANOMALY_STATUSES = ("Unreviewed", "Confirmed", "Dismissed", "Claimed")
CLAIM_STATUSES = ("Open", "Pending", "Won", "Lost", "Partial")
CHARGE_CATEGORIES = (
    "Fixed Monthly Charge", "Delivery Charge", "Supply Charge", "Demand Charge",
    "Taxes and Surcharges", "Rider", "Adjustment", "Credit", "Other",
)


@dataclass(frozen=True)
class TableRules:
    """What a relational store would enforce for one table."""

    required: tuple[str, ...] = ()
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    unique: tuple[str, ...] = ()
    references: dict[str, tuple[str, str]] = field(default_factory=dict)


RULES: dict[str, TableRules] = {
    "clients": TableRules(
        required=("client_id", "client_name", "is_active"),
        unique=("client_id", "client_name"),
    ),
    "properties": TableRules(
        required=("property_id", "client_id", "address"),
        unique=("property_id",),
        references={"client_id": ("clients", "client_id")},
    ),
    "vendors": TableRules(
        required=("vendor_id", "vendor_name"),
        allowed={"vendor_type": VENDOR_TYPES},
        unique=("vendor_id", "vendor_name"),
    ),
    "accounts": TableRules(
        required=("account_id", "vendor_id", "account_number"),
        unique=("account_id", "account_number"),
        references={
            "property_id": ("properties", "property_id"),
            "vendor_id": ("vendors", "vendor_id"),
        },
    ),
    "bills": TableRules(
        required=(
            "bill_id", "account_id", "utility_type", "total_amount",
            "is_anomaly_detected", "anomaly_status", "audit_timestamp",
        ),
        allowed={
            "utility_type": UTILITY_TYPES,
            "usage_unit": USAGE_UNITS,
            "anomaly_status": ANOMALY_STATUSES,
        },
        unique=("bill_id",),
        references={"account_id": ("accounts", "account_id")},
    ),
    "line_items": TableRules(
        required=("item_id", "bill_id", "category", "total_price"),
        allowed={"category": CHARGE_CATEGORIES},
        unique=("item_id",),
        references={"bill_id": ("bills", "bill_id")},
    ),
    "audit_claims": TableRules(
        required=("claim_id", "bill_id", "status"),
        allowed={"status": CLAIM_STATUSES},
        unique=("claim_id",),
        references={"bill_id": ("bills", "bill_id")},
    ),
    "findings": TableRules(
        required=("analysis_id", "bill_id", "detection_layer", "finding_type", "severity"),
        allowed={
            "detection_layer": ("MATH", "ML", "COMBINED"),
            "finding_type": (
                "MATH_ERROR", "WEATHER_DRIVEN", "WEATHER_UNEXPLAINED_SPIKE",
                "WEATHER_UNEXPLAINED_DROP", "USAGE_SPIKE", "USAGE_DROP",
            ),
            "severity": ("URGENT", "HIGH", "MEDIUM", "LOW"),
        },
        unique=("analysis_id",),
        references={"bill_id": ("bills", "bill_id")},
    ),
}

TABLES: dict[str, T.StructType] = {
    "clients": CLIENTS,
    "properties": PROPERTIES,
    "vendors": VENDORS,
    "accounts": ACCOUNTS,
    "bills": BILLS,
    "line_items": LINE_ITEMS,
    "audit_claims": AUDIT_CLAIMS,
    "findings": FINDINGS,
}
