"""Adapter: the star-schema sample tables seen as audit tables.

All money is exact decimal arithmetic, so the same rules can be stated in SQL
for any other engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffscope.functions.dates import parse_date
from tariffscope.functions.numeric import MONEY
from tariffscope.plans.audit_rules import UNPRICED_TEXT, failed_text
from tariffscope.session import shuffles_dropped, staged
from tariffscope.sources.tables import AuditTables
from tariffscope.sources.weather import DEFAULT_LAT, DEFAULT_LON

# Declared, so that reading needs no inference job.
SAMPLE_SCHEMAS = {
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SAMPLE_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _hundredth(value: str) -> str:
    return f"CAST(CAST({value} AS {MONEY}) * 0.01BD AS {MONEY})"


_PROPERTY_ID = (
    "CAST(c_nationkey AS BIGINT) * 10 + array_position("
    "array('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'), c_mktsegment) - 1"
)
_PRICE = (
    f"CAST(CASE WHEN l_linenumber = 7 THEN -{_hundredth('l_extendedprice')} "
    f"ELSE {_hundredth('l_extendedprice')} END AS {MONEY})"
)


def clients(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "nation").selectExpr(
        "CAST(n_nationkey AS BIGINT) AS client_id", "n_name AS client_name",
        "CASE n_regionkey WHEN 0 THEN 'Healthcare' WHEN 1 THEN 'Manufacturing' WHEN 2 THEN 'Food Service' "
        "WHEN 3 THEN 'Education' ELSE 'Retail' END AS industry",
        "CAST(NULL AS STRING) AS contact_name", "CAST(NULL AS STRING) AS contact_email",
        "CAST(NULL AS STRING) AS contact_phone", "CAST(NULL AS DATE) AS date_onboarded", "true AS is_active",
    )


def properties(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _table(spark, folder, "customer")
        .selectExpr(
            f"{_PROPERTY_ID} AS property_id", "CAST(c_nationkey AS BIGINT) AS client_id",
            "c_mktsegment AS property_name",
        )
        .distinct()
        .selectExpr(
            "property_id", "client_id", "concat('Site ', property_id) AS address",
            "concat('City ', client_id) AS city", "CAST(NULL AS STRING) AS state",
            "CAST(NULL AS STRING) AS zip_code", "property_name",
        )
    )


def vendors(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "supplier").selectExpr(
        "s_suppkey AS vendor_id", "s_name AS vendor_name", "'Both' AS vendor_type"
    )


def accounts(spark: SparkSession, folder: str) -> DataFrame:
    vendor_count = _table(spark, folder, "supplier").count()  # from the files' metadata
    return _table(spark, folder, "customer").selectExpr(
        "c_custkey AS account_id",
        f"CASE WHEN c_custkey % 50 <> 49 THEN {_PROPERTY_ID} END AS property_id",
        f"c_custkey % {vendor_count} AS vendor_id", "lpad(CAST(c_custkey AS STRING), 8, '0') AS account_number",
        "CAST(NULL AS STRING) AS meter_number", "CAST(NULL AS STRING) AS rate_code",
    )


def line_items(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber AS item_id", "l_orderkey AS bill_id",
        "CASE l_linenumber WHEN 1 THEN 'Delivery Charge' WHEN 2 THEN 'Supply Charge' WHEN 3 THEN 'Demand Charge' "
        "WHEN 4 THEN 'Taxes and Surcharges' WHEN 5 THEN 'Fixed Monthly Charge' WHEN 6 THEN 'Rider' "
        "WHEN 7 THEN 'Credit' END AS category",
        "CAST(NULL AS STRING) AS description", f"{_PRICE} AS total_price",
    )


def bills(spark: SparkSession, folder: str) -> DataFrame:
    lines = (
        _table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.expr(f"CAST(sum({_PRICE}) AS {MONEY}) AS line_sum"), F.expr("sum(l_quantity) AS quantity"))
    )
    raw_date = "CASE WHEN o_orderkey % 500 IN (0, 7) THEN '' ELSE date_format(o_orderdate, 'yyyy-MM-dd') END"
    math_error, spike = "o_orderkey % 20 = 7", "o_orderkey % 40 = 3"
    return (
        _table(spark, folder, "orders")
        .select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
        .join(lines, "o_orderkey", "left")
        .selectExpr(
            "o_orderkey AS bill_id", "o_custkey AS account_id",
            "CASE WHEN o_custkey % 97 = 0 THEN 'Unknown' WHEN o_custkey % 2 = 0 THEN 'Electric' ELSE 'Gas' END "
            "AS utility_type",
            f"{parse_date(raw_date)} AS billing_date",
            f"CAST(CASE WHEN line_sum IS NULL OR line_sum <= 0 THEN {_hundredth('o_totalprice')} "
            f"WHEN {math_error} THEN CAST(line_sum * 1.10BD AS {MONEY}) "
            f"WHEN {spike} THEN CAST(line_sum * 3.00BD AS {MONEY}) ELSE line_sum END AS {MONEY}) AS total_amount",
            f"coalesce(line_sum, CAST(0 AS {MONEY})) AS line_sum",
            "coalesce(quantity, 0D) AS usage_volume", f"{math_error} AS math_error", f"{spike} AS spike",
        )
        .selectExpr(
            "bill_id", "account_id", "utility_type", "billing_date",
            "date_sub(billing_date, 30) AS service_period_start",
            "date_sub(billing_date, 1) AS service_period_end", "date_add(billing_date, 21) AS due_date",
            "total_amount", "usage_volume",
            "CASE utility_type WHEN 'Electric' THEN 'kWh' WHEN 'Gas' THEN 'Therms' ELSE 'Unknown' END AS usage_unit",
            "0D AS demand_read", "CAST(NULL AS STRING) AS demand_unit", "CAST(NULL AS STRING) AS rate_code",
            "CAST(NULL AS STRING) AS tariff_code", "math_error OR spike AS is_anomaly_detected",
            f"CASE WHEN math_error THEN {failed_text('line_sum', 'total_amount')} "
            f"WHEN spike THEN '{UNPRICED_TEXT}' ELSE '' END AS anomaly_reason",
            "'Unreviewed' AS anomaly_status", "TIMESTAMP '2024-01-01 00:00:00' AS audit_timestamp",
            "concat('bill-', bill_id, '.pdf') AS source_file",
        )
    )


def audit_tables(spark: SparkSession, folder: str) -> AuditTables:
    return AuditTables(
        clients=clients(spark, folder), properties=properties(spark, folder),
        vendors=vendors(spark, folder), accounts=accounts(spark, folder),
        bills=bills(spark, folder), line_items=line_items(spark, folder),
    )


# Monthly mean temperatures (°F) of the sample climate.
MONTH_BASE = (26, 28, 36, 47, 58, 67, 74, 72, 64, 53, 42, 31)


def weather_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Sample daily weather covering every month that has orders.

    The calendar comes from the months present in the orders; a day's
    temperatures follow a fixed rule of its date.
    """
    mid = (
        f"element_at(array{MONTH_BASE}, month(d)) + (day(d) * 7 + year(d) * 5 + month(d) * 3) % 13 - 6 "
        "+ (year(d) * month(d)) % 11 - 5"
    )
    return (
        _table(spark, folder, "orders")
        .selectExpr("CAST(trunc(o_orderdate, 'month') AS DATE) AS first")
        .distinct()
        .selectExpr("explode(sequence(first, last_day(first))) AS d")
        .selectExpr(
            "d AS obs_date", f"{DEFAULT_LAT}D AS lat", f"{DEFAULT_LON}D AS lon",
            f"CAST({mid} + 8 AS DOUBLE) AS tmax", f"CASE WHEN day(d) <> 29 THEN CAST({mid} - 8 AS DOUBLE) END AS tmin",
        )
    )


def station_weather(spark: SparkSession, folder: str) -> DataFrame:
    """Daily extremes of the sensor events, one station per user.

    A day with a single reading has no minimum.
    """
    return (
        _table(spark, folder, "events")
        .selectExpr(
            "CAST(ts AS DATE) AS obs_date", "CAST(user_id % 10 AS DOUBLE) AS lat", "CAST(user_id AS DOUBLE) AS lon",
            "value",
        )
        .groupBy("obs_date", "lat", "lon")
        .agg(F.expr("max(value) AS tmax"), F.expr("CASE WHEN count(*) > 1 THEN min(value) END AS tmin"))
    )


#: Least files of the sample's inbox and of its pages, and the most rows of a table that one file stands for.
FILES, ROWS_PER_FILE = 16, 250_000


def file_count(spark: SparkSession, folder: str, table: str, least: int) -> int:
    """A multiple of ``least`` that grows with the table, whose size comes from the files' metadata."""
    return least * -(-max(_table(spark, folder, table).count(), 1) // (least * ROWS_PER_FILE))


def documents_count(spark: SparkSession, folder: str) -> int:
    """From the files' metadata."""
    return _table(spark, folder, "documents").count()


def _delivered(rows: DataFrame, label: str, files: int) -> DataFrame:
    """``rows`` as a source that comes in several files, as an inbox does; the sample tables are one file each."""
    with shuffles_dropped(rows.sparkSession):
        return staged(rows.repartition(files), label)


def extracted_json(spark: SparkSession, folder: str) -> DataFrame:
    """Extractor answers made from the bills: (record_id, source_file, payload), in several files.

    Faults are planted by bill number: broken JSON, empty answers, text after the
    object, error payloads, CCF units, dashed accounts,
    negative credits, missing providers, zero totals and short account numbers.
    """
    categories = {
        "fixed_monthly_charge": "Fixed Monthly Charge", "delivery_charge": "Delivery Charge",
        "supply_charge": "Supply Charge", "demand_charge": "Demand Charge",
        "taxes_and_surcharges": "Taxes and Surcharges", "credit": "Credit",
    }
    sums = line_items(spark, folder).groupBy("bill_id").agg(
        *[
            F.expr(f"CAST(sum(CASE WHEN category = '{name}' THEN total_price END) AS {MONEY}) AS {alias}")
            for alias, name in categories.items()
        ]
    )
    zero = f"CAST(0 AS {MONEY})"
    fields = {
        "provider_name": "CASE WHEN bill_id % 25 <> 5 THEN concat('Vendor ', account_id % 10) END",
        "account_number": "CASE WHEN bill_id % 25 = 8 THEN '123' WHEN bill_id % 10 = 3 "
        "THEN concat(substring(number, 1, 4), '-', substring(number, 5, 4)) ELSE number END",
        "utility_type": "CASE WHEN bill_id % 30 = 9 THEN 'Water' ELSE utility_type END",
        "statement_date": "date_format(billing_date, 'yyyy-MM-dd')",
        "service_period_start": "date_format(service_period_start, 'yyyy-MM-dd')",
        "service_period_end": "date_format(service_period_end, 'yyyy-MM-dd')",
        "total_amount_due": f"CASE WHEN bill_id % 25 = 6 THEN {zero} ELSE total_amount END",
        "usage_volume": "usage_volume",
        "usage_unit": "CASE WHEN bill_id % 10 = 2 THEN 'CCF' ELSE usage_unit END",
        "rate_code": "'SC1'",
        **{name: f"coalesce({name}, {zero})" for name in categories if name != "credit"},
        "credits": f"CASE WHEN bill_id % 10 = 4 THEN -1 ELSE 1 END * abs(coalesce(credit, {zero}))",
        "is_anomaly_detected": "false",
    }
    record = ", ".join(f"{value} AS {name}" for name, value in fields.items())
    answers = (
        bills(spark, folder)
        .join(sums, "bill_id", "left")
        .selectExpr("*", "lpad(CAST(account_id AS STRING), 8, '0') AS number")
        .selectExpr(
            "bill_id AS record_id", "concat('/inbox/', source_file) AS source_file",
            f"CASE bill_id % 50 WHEN 1 THEN '{{not json' WHEN 11 THEN '``````' "
            f"WHEN 21 THEN concat(to_json(struct({record})), ' and a remark') WHEN 31 THEN '{{\"error\": null}}' "
            f"ELSE concat('```json\\n', to_json(struct({record})), '\\n```') END AS payload",
        )
    )
    return _delivered(answers, "inbox", file_count(spark, folder, "orders", FILES))


def bill_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Document texts as pages: (doc_id, page_no, text), four pages a document.

    Every third page ends in a billing line.
    """
    amount = "CAST(CAST(doc_id % 900 + 100 AS DECIMAL(10,2)) + 0.25BD AS DECIMAL(10,2))"
    line = f"concat('\\nTotal Amount Due $', {amount}, ' Account Number ', lpad(CAST(doc_id AS STRING), 8, '0'))"
    pages = _table(spark, folder, "documents").selectExpr(
        "doc_id DIV 4 AS doc_id", "CAST(doc_id % 4 AS INT) AS page_no",
        f"CASE WHEN doc_id % 3 = 0 THEN concat(text, {line}) ELSE text END AS text",
    )
    return _delivered(pages, "pages", file_count(spark, folder, "documents", FILES))


# The planted numbers of paper bill d, in cents; the other engine states the same.
PAPER_CENTS = {
    "basic": "1500 + 100 * (d % 7)", "delivery": "10000 + (d * 37) % 90000", "demand": "CASE WHEN d % 4 = 0 THEN 0 ELSE 1250 END",
    "supply": "20000 + (d * 53) % 90000 + CASE WHEN d % 8 = 2 THEN 150000 ELSE 0 END", "taxes": "500 + d % 100",
    "credits": "CASE WHEN d % 6 = 1 THEN 700 ELSE 0 END",
}


def paper_bills(spark: SparkSession, folder: str) -> DataFrame:
    """Bills as papers: (doc_id, page_no, source_file, text, ocr_text), four pages of prose, the first below a bill's lines.

    Every fifth paper is a scan without a text layer. Faults are planted by number:
    no bill at all, no provider, a short account number, a wrong total. Rate lines
    ("0.07 x 304 kWh") hold no amount.
    """

    def amount(cents: str) -> str:
        return f"format_number(CAST({cents} AS DECIMAL(14,2)) / 100, 2)"

    number = "lpad(CAST(d AS STRING), 8, '0')"
    unit = "CASE WHEN d % 10 < 5 THEN 'kWh' WHEN d % 10 < 8 THEN 'Therms' ELSE 'CCF' END"
    month = "concat('2024-0', d % 9 + 1, '-')"
    total = " + ".join(f"({PAPER_CENTS[c]})" for c in PAPER_CENTS if c != "credits") + f" - ({PAPER_CENTS['credits']})"
    lines = [
        "CASE WHEN d % 12 <> 7 THEN concat('Provider: Vendor ', d % 7) END",
        f"concat('Account Number: ', CASE WHEN d % 12 = 9 THEN '123' WHEN d % 3 = 0 "
        f"THEN concat(substring({number}, 1, 4), '-', substring({number}, 5, 4)) ELSE {number} END)",
        f"concat('Statement Date: ', {month}, '15')", f"concat('Service Period: ', {month}, '01 to ', {month}, '14')",
        f"concat('Usage: ', format_number(100 + d % 1900, 0), ' ', {unit})", "concat('Rate Code: SC-', d % 5 + 1)",
        f"concat('Supply 0.07 x 304 ', {unit})", f"concat('Basic Service Charge $', {amount(PAPER_CENTS['basic'])})",
        f"concat('Delivery Services $', {amount(PAPER_CENTS['delivery'])})", f"concat('Supply Charge $', {amount(PAPER_CENTS['supply'])})",
        f"concat('Demand Charge $', {amount(PAPER_CENTS['demand'])})", f"concat('Taxes and Surcharges $', {amount(PAPER_CENTS['taxes'])})",
        f"concat('Credits $', {amount(PAPER_CENTS['credits'])})",
        f"concat('Total Amount Due $', {amount(total + ' + CASE WHEN d % 12 = 11 THEN 1000 ELSE 0 END')})", "''",
    ]
    return (
        _table(spark, folder, "documents")
        .selectExpr("doc_id DIV 4 AS d", "CAST(doc_id % 4 AS INT) AS page_no", "text AS prose")
        .selectExpr(
            "d", "page_no",
            f"CASE WHEN page_no = 0 AND d % 12 <> 5 THEN concat(concat_ws('\n', {', '.join(lines)}), coalesce(prose, '')) ELSE prose END AS page",
        )
        .selectExpr(
            "d AS doc_id", "page_no", "concat('/papers/', d, '.pdf') AS source_file", "CASE WHEN d % 5 <> 3 THEN page END AS text",
            "CASE WHEN d % 5 = 3 THEN page END AS ocr_text",
        )
    )
