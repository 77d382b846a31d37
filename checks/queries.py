"""Every registered query: its Spark form, its columns and, where there is one, its SQL.

Columns are declared once and applied to both sides, so money, dates and flags
compare alike: i integer, d number, r4 number rounded to 4 places, s text,
b flag as text, t date as text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks import oracle as o
from tariffscope.functions import text as tx
from tariffscope.functions.dates import month_bounds, month_name
from tariffscope.functions.severity import severity
from tariffscope.operators import charges as ch
from tariffscope.operators import star
from tariffscope.operators.baseline import account_profile, month_profile
from tariffscope.operators.constraints import violations
from tariffscope.operators.encode import label_codes
from tariffscope.operators.filters import with_history
from tariffscope.operators.nearest import nearest
from tariffscope.plans import batch as bt
from tariffscope.plans import detect as dt
from tariffscope.plans import features as fe
from tariffscope.plans import findings as fd
from tariffscope.plans import ingest as ig
from tariffscope.plans import model as ml
from tariffscope.plans import reports as rp
from tariffscope.plans import weather as wx
from tariffscope.plans.review import apply_decisions
from tariffscope.session import drop_read, importable, shuffles_dropped, staged, staging_root, tune
from tariffscope.sources import demo
from tariffscope.sources.documents import as_json
from tariffscope.sources.tables import AuditTables, read_only_sql, read_tables
from tariffscope.sources.weather import daily_rows
from tariffscope.sources.store import prepare_store, read_batches, read_table, write_batch, write_review
from tariffscope.streaming.intake import start_document_intake, start_intake

Spark = SparkSession
RUN_TIME, RUN_DATE = "2024-06-01 00:00:00", "2024-06-01"


@dataclass
class Query:
    columns: dict[str, str]
    run: Callable[[Spark, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def _spark_column(name: str, kind: str) -> str:
    if kind == "i":
        return f"CAST(`{name}` AS BIGINT) AS `{name}`"
    if kind == "d":
        return f"CAST(`{name}` AS DOUBLE) AS `{name}`"
    if kind.startswith("r"):
        rounded = f"round(CAST(`{name}` AS DOUBLE), {int(kind[1:])})"
        return f"CASE WHEN {rounded} = 0 THEN 0D ELSE {rounded} END AS `{name}`"
    if kind == "t":
        return f"date_format(`{name}`, 'yyyy-MM-dd') AS `{name}`"
    return f"CAST(`{name}` AS STRING) AS `{name}`"


def _sql_column(name: str, kind: str) -> str:
    quoted = f'"{name}"'
    if kind == "i":
        return f"CAST({quoted} AS BIGINT) AS {quoted}"
    if kind == "d":
        return f"CAST({quoted} AS DOUBLE) AS {quoted}"
    if kind.startswith("r"):
        rounded = f"round(CAST({quoted} AS DOUBLE), {int(kind[1:])})"
        return f"CASE WHEN {rounded} = 0 THEN CAST(0 AS DOUBLE) ELSE {rounded} END AS {quoted}"
    if kind == "t":
        return f"strftime(CAST({quoted} AS DATE), '%Y-%m-%d') AS {quoted}"
    return f"CAST({quoted} AS VARCHAR) AS {quoted}"


def query(columns: str, sql: str | None = None, name: str | None = None):
    """Register a Spark function under its own name with its columns and SQL body."""
    spec = dict(part.split(":") for part in columns.split())

    def register(function):
        def run(spark: Spark, folder: str) -> DataFrame:
            tune(spark)
            return function(spark, folder).selectExpr(*[_spark_column(n, k) for n, k in spec.items()])

        shown = None
        if sql is not None:
            shown = f"SELECT {', '.join(_sql_column(n, k) for n, k in spec.items())} FROM ({o.with_ctes(sql)}) AS answer"
        QUERIES[name or function.__name__] = Query(spec, run, shown)
        return function

    return register


# --- shared inputs ---------------------------------------------------------

def tables_of(spark: Spark, folder: str) -> AuditTables:
    return demo.audit_tables(spark, folder)


def scored_of(tables: AuditTables) -> DataFrame:
    return fd.rule_scores(fe.engineer(tables))


def weather_of(spark: Spark, folder: str, tables: AuditTables) -> DataFrame:
    return wx.weather_table(tables.bills, demo.weather_daily(spark, folder))


def findings_of(spark: Spark, folder: str) -> tuple[AuditTables, DataFrame]:
    """Tables and findings; every fifth bill, and the next, is already reviewed."""
    tables = tables_of(spark, folder)
    found = fd.findings(scored_of(tables), weather_of(spark, folder, tables), run_time=RUN_TIME)
    return tables, found.withColumn("reviewed", (F.col("bill_id") % 5).isin(0, 1))


def mean_sql(total: str, count: str) -> str:
    return f"((2 * CAST({total} * 100 AS HUGEINT) + {count}) // (2 * {count})) / 100.0"


# --- joins and features ----------------------------------------------------

@query(
    "bill_id:i client_name:s property_name:s vendor_name:s account_number:s total_amount:d",
    "SELECT * FROM bills JOIN directory USING (account_id)",
)
def star_join(spark, folder):
    return star.bill_star(tables_of(spark, folder))


@query(
    "bill_id:i client_name:s vendor_name:s account_number:s",
    """SELECT bill_id, client_name, v.vendor_name, a.account_number FROM bills b
       JOIN accounts a ON a.account_id = b.account_id JOIN vendors v ON v.vendor_id = a.vendor_id
       LEFT JOIN directory d ON d.account_id = b.account_id""",
)
def star_join_unassigned(spark, folder):
    return star.bill_star(tables_of(spark, folder), include_unassigned=True)


@query("unassigned:i", "SELECT count(*) AS unassigned FROM accounts WHERE property_id IS NULL")
def unassigned_accounts(spark, folder):
    return star.unassigned_accounts(tables_of(spark, folder)).agg(F.count("*").alias("unassigned"))


@query(
    "bill_id:i delivery_charge:d supply_charge:d demand_charge:d taxes:d",
    """SELECT * FROM charges SEMI JOIN (SELECT bill_id FROM line_items WHERE category IN
       ('Delivery Charge', 'Supply Charge', 'Demand Charge', 'Taxes and Surcharges')) x USING (bill_id)""",
)
def charge_pivot(spark, folder):
    return ch.charge_sums(tables_of(spark, folder).line_items)


FEATURE_COLUMNS = (
    "bill_id:i account_id:i client_name:s industry:s utility_type:s total_amount:d month:d account_bill_count:i "
    "monthly_mean:r6 overall_mean:r6 zscore_monthly:r4 zscore_overall:r4 pct_above_monthly:r4 pct_above_overall:r4 "
    "delivery_rate_ratio:r4 delivery_pct:r4 supply_pct:r4 demand_pct:r4 taxes_pct:r4"
)


@query(FEATURE_COLUMNS, "SELECT * FROM features")
def features(spark, folder):
    return fe.engineer(tables_of(spark, folder))


@query(
    "bill_id:i delivery_rate_ratio:r4 pct_above_monthly:r4",
    """SELECT bill_id, delivery_rate_ratio_all AS delivery_rate_ratio, raw_pct_monthly AS pct_above_monthly
       FROM features""",
)
def rate_ratio_all_usage(spark, folder):
    return fe.engineer(tables_of(spark, folder), include_zero_usage=True, fill_missing=False)


@query(
    "bill_id:i delivery_charge:d supply_charge:d demand_charge:d taxes:d month:d year:d city:s",
    "SELECT * FROM base",
)
def base_table(spark, folder):
    return fe.base_table(tables_of(spark, folder))


@query(
    "account_id:i month:i monthly_mean:r6 monthly_std:r4 overall_mean:r6 overall_std:r4",
    """SELECT m.account_id, month, monthly_mean, monthly_std, overall_mean, overall_std
       FROM by_month m JOIN by_account a ON a.account_id = m.account_id""",
)
def account_baselines(spark, folder):
    tables = tables_of(spark, folder)
    months = month_profile(account_profile(fe.priced_bills(tables))).filter("month_key > 0")
    return months.join(star.account_directory(tables), "account_id").withColumnRenamed("month_key", "month")


@query(
    "account_id:i bill_id:i account_bill_count:i", "SELECT * FROM features WHERE account_bill_count >= 12"
)
def history_gate(spark, folder):
    return with_history(fe.engineer(tables_of(spark, folder)))


@query(
    "column_name:s value:s code:d",
    """SELECT column_name, value, dense_rank() OVER (PARTITION BY column_name ORDER BY value) - 1 AS code FROM (
       SELECT DISTINCT 'industry' AS column_name, industry AS value FROM base
       UNION ALL SELECT DISTINCT 'utility_type', utility_type FROM base
       UNION ALL SELECT DISTINCT 'vendor_name', vendor_name FROM base)""",
)
def label_encode(spark, folder):
    tables = tables_of(spark, folder)
    return label_codes(fe.label_values(fe.priced_bills(tables), tables), list(fe.CODED))


@query(
    "year:i month:i month_name:s first_day:s last_day:s",
    """SELECT year, month, monthname(make_date(year, month, 1)) AS month_name,
       strftime(make_date(year, month, 1), '%Y-%m-%d') AS first_day,
       strftime(last_day(make_date(year, month, 1)), '%Y-%m-%d') AS last_day FROM bill_months""",
)
def billing_calendar(spark, folder):
    first, last = month_bounds("year", "month")
    return wx.bill_months(tables_of(spark, folder).bills).selectExpr(
        "year", "month", f"{month_name('month')} AS month_name", f"{first} AS first_day", f"{last} AS last_day"
    )


# --- clients and bills -----------------------------------------------------

@query(
    "client_id:i client_name:s industry:s properties:i accounts:i",
    """SELECT c.client_id, client_name, industry, count(DISTINCT p.property_id) AS properties,
       count(DISTINCT a.account_id) AS accounts FROM clients c
       LEFT JOIN properties p ON p.client_id = c.client_id LEFT JOIN accounts a ON a.property_id = p.property_id
       GROUP BY 1, 2, 3""",
)
def client_directory(spark, folder):
    return rp.client_directory(tables_of(spark, folder))


_SPENDING = f"""account_number, utility_type, count(*) AS bill_count, sum(total_amount) AS total_spend,
    {mean_sql('sum(total_amount)', 'count(*)')} AS avg_bill, count(*) FILTER (is_anomaly_detected) AS flagged"""


@query(
    "client_name:s industry:s property_name:s address:s city:s account_number:s vendor_name:s utility_type:s "
    "bill_count:i total_spend:d avg_bill:d flagged:i",
    f"""SELECT client_name, industry, property_name, address, city, vendor_name, {_SPENDING}
        FROM bills JOIN directory USING (account_id) WHERE lower(client_name) LIKE lower('%Nation_%')
        GROUP BY client_name, industry, property_name, address, city, vendor_name, account_number, utility_type""",
)
def client_summary(spark, folder):
    return rp.client_summary(tables_of(spark, folder), "Nation_")


@query(
    "client_name:s property_name:s vendor_name:s account_number:s utility_type:s billing_date:t total_amount:d "
    "anomaly_status:s bill_id:i",
    """SELECT * FROM bills JOIN directory USING (account_id) WHERE is_anomaly_detected AND utility_type = 'Gas'
       AND anomaly_status = 'Unreviewed' AND lower(client_name) LIKE '%nation%'
       ORDER BY billing_date DESC NULLS LAST, bill_id LIMIT 20""",
)
def flagged_bills(spark, folder):
    return rp.flagged_bills(tables_of(spark, folder), "NATION", "Unreviewed", "Gas")


@query(
    "client_name:s property_name:s vendor_name:s account_number:s utility_type:s billing_date:t "
    "service_period_start:t service_period_end:t total_amount:d usage_volume:d usage_unit:s "
    "is_anomaly_detected:b anomaly_status:s bill_id:i",
    """SELECT * FROM bills JOIN directory USING (account_id) WHERE utility_type = 'Electric'
       AND billing_date BETWEEN DATE '1996-01-01' AND DATE '1998-06-30'
       ORDER BY billing_date DESC NULLS LAST, bill_id LIMIT 24""",
)
def bill_search(spark, folder):
    return rp.bill_search(
        tables_of(spark, folder), utility_type="Electric", start_date="1996-01-01", end_date="1998-06-30"
    )


def _period_sql(tag: str, start: str, end: str) -> str:
    inside = f"billing_date BETWEEN DATE '{start}' AND DATE '{end}'"
    spend, bills = f"sum(total_amount) FILTER ({inside})", f"count(*) FILTER ({inside})"
    return f"""{bills} AS {tag}_bills, {spend} AS {tag}_spend,
        CASE WHEN {bills} > 0 THEN {mean_sql(spend, bills)} END AS {tag}_avg_bill,
        round(sum(usage_volume) FILTER ({inside}), 2) AS {tag}_usage,
        round(avg(usage_volume) FILTER ({inside}), 2) AS {tag}_avg_usage,
        count(*) FILTER ({inside} AND is_anomaly_detected) AS {tag}_flagged"""


_P1, _P2 = ("1996-01-01", "1997-12-31"), ("1998-01-01", "1999-12-31")


@query(
    "account_number:s "
    + " ".join(
        f"{t}_bills:i {t}_spend:d {t}_avg_bill:d {t}_usage:d {t}_avg_usage:d {t}_flagged:i" for t in ("p1", "p2")
    )
    + " spend_change_pct:d usage_change_pct:d spend_trend:s usage_trend:s",
    f"""SELECT *, CASE WHEN spend_change_pct > 0 THEN 'UP' ELSE 'DOWN' END AS spend_trend,
        CASE WHEN usage_change_pct > 0 THEN 'UP' ELSE 'DOWN' END AS usage_trend FROM (
        SELECT *, CASE WHEN p1_spend <> 0 AND p2_spend <> 0 THEN round_even(
            (CAST(p2_spend AS DOUBLE) - CAST(p1_spend AS DOUBLE)) / CAST(p1_spend AS DOUBLE) * 100, 1) ELSE 0 END AS spend_change_pct,
        CASE WHEN p1_usage <> 0 AND p2_usage <> 0 THEN round_even((p2_usage - p1_usage) / p1_usage * 100, 1) ELSE 0 END AS usage_change_pct
        FROM (SELECT account_number, {_period_sql('p1', *_P1)}, {_period_sql('p2', *_P2)}
        FROM accounts LEFT JOIN bills USING (account_id) GROUP BY account_number))""",
)
def compare_periods(spark, folder):
    return rp.compare_periods(tables_of(spark, folder), _P1, _P2)


@query(
    "client_name:s property_name:s vendor_name:s account_number:s utility_type:s bill_count:i total_spend:d "
    "avg_monthly:d flagged:i",
    f"""SELECT *, avg_bill AS avg_monthly FROM (SELECT client_name, property_name, vendor_name, {_SPENDING}
        FROM bills JOIN directory USING (account_id)
        WHERE utility_type = 'Electric' AND billing_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'
        GROUP BY client_name, property_name, vendor_name, account_number, utility_type)
        ORDER BY total_spend DESC, account_number, utility_type LIMIT 10""",
)
def top_spenders(spark, folder):
    return rp.top_spenders(tables_of(spark, folder), "Electric", 1998)


@query(
    "category:s items:i charged:d",
    "SELECT category, count(*) AS items, sum(total_price) AS charged FROM line_items GROUP BY category",
)
def adhoc_sql(spark, folder):
    return read_only_sql(
        spark, "SELECT category, count(*) AS items, sum(total_price) AS charged FROM line_items GROUP BY category",
        tables_of(spark, folder),
    )


_STATEMENTS = {
    1: "SELECT utility_type AS k, count(*) AS n FROM bills WHERE total_amount > 100 GROUP BY utility_type",
    2: "SELECT * FROM (WITH x AS (SELECT account_id, count(*) AS n FROM bills GROUP BY account_id) "
    "SELECT a.account_number AS k, x.n FROM x JOIN accounts a ON a.account_id = x.account_id);",
    3: "SELECT reflect('java.lang.System', 'getenv', 'HOME') AS k, count(*) AS n FROM bills",
    4: "SELECT n_name AS k, 1 AS n FROM parquet.`{folder}/nation.parquet`",
    5: "SELECT 'x' AS k, 1 / (bill_id - bill_id) AS n FROM bills",
    6: "DROP VIEW bills", 7: "SELECT nothing AS k, 1 AS n FROM bills", 8: "SELECT TRANSFORM(bill_id) USING 'cat' AS (k, n) FROM bills",
}


@query(
    "statement:i outcome:s rows:i total:i",
    """SELECT 1 AS statement, 'answered' AS outcome, count(*) AS rows, sum(n) AS total FROM (
         SELECT count(*) AS n FROM bills WHERE total_amount > 100 GROUP BY utility_type)
       UNION ALL SELECT 2, 'answered', count(*), sum(n) FROM (SELECT count(*) AS n FROM bills GROUP BY account_id)
       UNION ALL SELECT unnest([3, 4, 5, 6, 7, 8]), 'error', 1, NULL""",
)
def adhoc_guard(spark, folder):
    """Allowed statements are answered; files, reflection, scripts, commands and failures come back as error rows."""
    tables, made = tables_of(spark, folder), []
    for number, text in _STATEMENTS.items():
        answer = read_only_sql(spark, text.format(folder=folder), tables)
        failed = answer.columns == ["error"]
        total = F.lit(None).cast("long") if failed else F.sum("n").cast("long")
        made.append(answer.agg(
            F.lit(number).alias("statement"), F.lit("error" if failed else "answered").alias("outcome"), F.count("*").alias("rows"), total.alias("total")
        ))
    return reduce(DataFrame.unionByName, made)


@query(
    "account_number:s vendor_name:s", "SELECT account_number, vendor_name FROM accounts JOIN vendors USING (vendor_id)"
)
def vendor_accounts(spark, folder):
    return rp.vendor_accounts(tables_of(spark, folder))


@query("bill_id:i account_id:i billing_date:t total_amount:d usage_volume:d", "SELECT * FROM bills")
def all_bills(spark, folder):
    return rp.all_bills(tables_of(spark, folder))


@query(
    "record:s",
    "SELECT to_json({'account_number': account_number, 'vendor_name': vendor_name}) AS record "
    "FROM accounts JOIN vendors USING (vendor_id)",
)
def json_records(spark, folder):
    return as_json(rp.vendor_accounts(tables_of(spark, folder)))


@query(
    "month:s bills:i total_spend:d",
    """SELECT strftime(billing_date, '%Y-%m') AS month, count(*) AS bills, sum(total_amount) AS total_spend
       FROM bills WHERE billing_date IS NOT NULL GROUP BY 1""",
)
def monthly_trend(spark, folder):
    return rp.monthly_trend(tables_of(spark, folder).bills)


@query(
    "bills:i clients:i accounts:i unreviewed:i",
    """SELECT (SELECT count(*) FROM bills) AS bills, (SELECT count(*) FROM clients) AS clients,
       (SELECT count(*) FROM accounts) AS accounts, (SELECT count(*) FROM findings WHERE NOT reviewed) AS unreviewed""",
)
def db_counters(spark, folder):
    tables, found = findings_of(spark, folder)
    return rp.database_counters(tables, found)


# --- weather ---------------------------------------------------------------

_STATIONS = """SELECT CAST(ts AS DATE) AS obs_date, user_id % 10 AS lat, user_id AS lon, max(value) AS tmax,
    CASE WHEN count(*) > 1 THEN min(value) END AS tmin FROM events GROUP BY 1, 2, 3"""


@query(
    "obs_date:t lat:d lon:d tmax:d tmin:d", f"SELECT * FROM ({_STATIONS}) WHERE tmax IS NOT NULL AND tmin IS NOT NULL"
)
def weather_source(spark, folder):
    station = demo.station_weather(spark, folder)
    day = F.struct("obs_date", "tmax", "tmin")
    # One response per station and month: at most 31 days in a row.
    months = station.groupBy("lat", "lon", F.trunc("obs_date", "month")).agg(F.array_agg(day).alias("d"))
    responses = months.select(
        F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
        F.struct(
            F.transform("d", lambda x: x["obs_date"].cast("string")).alias("time"),
            F.transform("d", lambda x: x["tmax"]).alias("temperature_2m_max"),
            F.transform("d", lambda x: x["tmin"]).alias("temperature_2m_min"),
        ).alias("daily"),
    )
    return daily_rows(responses)


@query(
    "lat:d lon:d year:i month:i hdd:r1 cdd:r1 avg_temp:r1 days:i",
    f"""SELECT lat, lon, year(obs_date) AS year, month(obs_date) AS month, count(*) AS days,
        round_even(CAST(sum(greatest(0, 65 - (tmax + tmin) / 2)) AS DECIMAL(24,6)), 1) AS hdd,
        round_even(CAST(sum(greatest(0, (tmax + tmin) / 2 - 65)) AS DECIMAL(24,6)), 1) AS cdd,
        round_even(CAST(avg((tmax + tmin) / 2) AS DECIMAL(24,6)), 1) AS avg_temp
        FROM ({_STATIONS}) WHERE tmax IS NOT NULL AND tmin IS NOT NULL GROUP BY 1, 2, 3, 4""",
)
def degree_days(spark, folder):
    return wx.degree_days(demo.station_weather(spark, folder))


@query("month:i avg_hdd:d avg_cdd:d", "SELECT * FROM weather_base")
def weather_baseline(spark, folder):
    months = wx.bill_months(tables_of(spark, folder).bills)
    return wx.month_baselines(wx.degree_days(demo.weather_daily(spark, folder)), months)


@query(
    "bill_id:i weather_available:b weather_actual:d weather_historical:d weather_deviation_pct:d weather_explains:b",
    """SELECT bill_id, weather_available, actual_dd AS weather_actual, usual_dd AS weather_historical,
       round_even(deviation, 1) AS weather_deviation_pct, explains AS weather_explains FROM weather_bills""",
)
def weather_context(spark, folder):
    tables = tables_of(spark, folder)
    return wx.with_weather(fe.engineer(tables), weather_of(spark, folder, tables))


# --- findings --------------------------------------------------------------

@query(
    "severity:s bills:i",
    """SELECT CASE WHEN total_amount >= 5000 THEN 'URGENT' WHEN total_amount >= 1000 THEN 'HIGH'
       WHEN total_amount >= 200 THEN 'MEDIUM' ELSE 'LOW' END AS severity, count(*) AS bills FROM bills GROUP BY 1""",
    name="severity",
)
def severity_levels(spark, folder):
    bills = tables_of(spark, folder).bills
    return bills.groupBy(F.expr(f"{severity('total_amount')} AS severity")).agg(F.count("*").alias("bills"))


@query(
    "analysis_id:i bill_id:i detection_layer:s finding_type:s severity:s expected_value:d actual_value:d "
    "deviation_pct:r2 zscore_monthly:r3 zscore_overall:r3 weather_actual:r1 weather_historical:r1 "
    "anomaly_probability:r4 potential_recovery:d reviewed:b",
    "SELECT * FROM findings",
)
def findings(spark, folder):
    return findings_of(spark, folder)[1]


@query("bill_id:i plain_english_reason:s", "SELECT * FROM findings")
def finding_text(spark, folder):
    return findings_of(spark, folder)[1]


@query(
    "bill_id:i account_id:i total_amount:d overall_mean:r4 pct_above_overall:r4 zscore_overall:r4",
    "SELECT * FROM scored WHERE billing_date IS NULL AND ml_flagged",
)
def undated_flags(spark, folder):
    return fd.undated_flags(scored_of(tables_of(spark, folder)))


@query(
    "findings:i urgent:i high:i recovery:d",
    """SELECT count(*) AS findings, count(*) FILTER (severity = 'URGENT') AS urgent,
       count(*) FILTER (severity = 'HIGH') AS high, sum(potential_recovery) AS recovery FROM findings""",
)
def detection_totals(spark, folder):
    return fd.run_totals(findings_of(spark, folder)[1])


_BY_CLIENT = """SELECT client_name, count(*) AS findings, sum(potential_recovery) AS recovery,
    count(*) FILTER (severity = 'URGENT') AS urgent FROM finding_star"""


@query("client_name:s findings:i recovery:d urgent:i", f"{_BY_CLIENT} WHERE NOT reviewed GROUP BY client_name")
def recovery_by_client(spark, folder):
    tables, found = findings_of(spark, folder)
    return rp.recovery_by_client(found, tables)


@query("client_name:s findings:i recovery:d urgent:i", f"{_BY_CLIENT} GROUP BY client_name")
def recovery_by_client_all(spark, folder):
    tables, found = findings_of(spark, folder)
    return rp.recovery_by_client(found, tables, unreviewed_only=False)


_METHOD = """CASE detection_layer WHEN 'MATH' THEN 'Arithmetic check' WHEN 'ML' THEN 'Unusual pattern'
    ELSE 'Unusual pattern, not due to weather' END"""
_BY_LAYER = f"""SELECT detection_layer, {_METHOD} AS method, count(*) AS findings,
    sum(potential_recovery) AS recovery FROM findings"""


@query("detection_layer:s method:s findings:i recovery:d", f"{_BY_LAYER} WHERE NOT reviewed GROUP BY detection_layer")
def recovery_by_layer(spark, folder):
    return rp.recovery_by_layer(findings_of(spark, folder)[1])


@query("detection_layer:s method:s findings:i recovery:d", f"{_BY_LAYER} GROUP BY detection_layer")
def recovery_by_layer_all(spark, folder):
    return rp.recovery_by_layer(findings_of(spark, folder)[1], unreviewed_only=False)


_OVERALL = """SELECT count(*) AS total_findings, sum(potential_recovery) AS total_recovery,
    count(*) FILTER (severity = 'URGENT') AS urgent, count(*) FILTER (severity = 'HIGH') AS high
    FROM findings WHERE NOT reviewed"""


@query("total_findings:i total_recovery:d urgent:i high:i", _OVERALL)
def recovery_overall(spark, folder):
    return rp.recovery_overall(findings_of(spark, folder)[1])


@query(
    "section:s name:s findings:i recovery:d urgent:d high:d",
    f"""SELECT 'summary' AS section, 'all' AS name, total_findings AS findings, total_recovery AS recovery, urgent, high
        FROM ({_OVERALL}) UNION ALL
        SELECT 'client', client_name, findings, recovery, urgent, NULL FROM ({_BY_CLIENT} WHERE NOT reviewed GROUP BY client_name)
        UNION ALL SELECT 'method', method, findings, recovery, NULL, NULL
        FROM ({_BY_LAYER} WHERE NOT reviewed GROUP BY detection_layer)""",
)
def recovery_summary(spark, folder):
    tables, found = findings_of(spark, folder)
    return rp.recovery_sections(staged(found, "findings"), tables)


@query(
    "finding_type:s title:s findings:i recovery:d avg_recovery:d",
    f"""SELECT finding_type, CASE finding_type WHEN 'MATH_ERROR' THEN 'Charges and total disagree'
        WHEN 'WEATHER_UNEXPLAINED_SPIKE' THEN 'High bill in mild weather'
        WHEN 'WEATHER_UNEXPLAINED_DROP' THEN 'Low bill in harsh weather'
        WHEN 'WEATHER_DRIVEN' THEN 'Change in line with the weather'
        WHEN 'USAGE_SPIKE' THEN 'High bill for this account' ELSE 'Low bill for this account' END AS title,
        count(*) AS findings, sum(potential_recovery) AS recovery,
        {mean_sql('sum(potential_recovery)', 'count(*)')} AS avg_recovery FROM findings GROUP BY finding_type""",
)
def insights_by_type(spark, folder):
    return rp.insights_by_type(findings_of(spark, folder)[1])


@query(
    "vendor_name:s findings:i recovery:d",
    """SELECT vendor_name, count(*) AS findings, sum(potential_recovery) AS recovery FROM findings
       JOIN bills USING (bill_id) JOIN accounts USING (account_id) JOIN vendors USING (vendor_id) GROUP BY vendor_name""",
)
def insights_by_vendor(spark, folder):
    tables, found = findings_of(spark, folder)
    return rp.insights_by_vendor(found, tables)


@query(
    "utility_type:s findings:i recovery:d",
    """SELECT utility_type, count(*) AS findings, sum(potential_recovery) AS recovery
       FROM findings JOIN bills USING (bill_id) GROUP BY utility_type""",
)
def insights_by_utility(spark, folder):
    tables, found = findings_of(spark, folder)
    return rp.insights_by_utility(found, tables)


@query(
    "total:i total_recovery:d urgent:i high:i medium:i low:i unreviewed:i",
    """SELECT count(*) AS total, sum(potential_recovery) AS total_recovery,
       count(*) FILTER (severity = 'URGENT') AS urgent, count(*) FILTER (severity = 'HIGH') AS high,
       count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low,
       count(*) FILTER (NOT reviewed) AS unreviewed FROM findings""",
)
def dashboard_header(spark, folder):
    return rp.dashboard_header(findings_of(spark, folder)[1])


@query(
    "client_name:s industry:s", "SELECT DISTINCT client_name, industry FROM finding_star WHERE NOT reviewed"
)
def clients_with_findings(spark, folder):
    tables, found = findings_of(spark, folder)
    return rp.clients_with_findings(found, tables)


@query(
    "analysis_id:i severity:s detection_layer:s potential_recovery:d reviewed:b utility_type:s billing_date:t "
    "total_amount:d property_name:s vendor_name:s client_name:s",
    "SELECT * FROM finding_star",
)
def review_list(spark, folder):
    tables, found = findings_of(spark, folder)
    return rp.review_list(found, tables, show_reviewed=True)


@query(
    "analysis_id:i severity:s detected_by:s potential_recovery:d utility_type:s billing_date:t total_amount:d "
    "client_name:s property_name:s vendor_name:s",
    f"""SELECT *, {_METHOD} AS detected_by FROM finding_star WHERE NOT reviewed
        ORDER BY potential_recovery DESC, analysis_id LIMIT 10""",
)
def top_findings(spark, folder):
    tables, found = findings_of(spark, folder)
    return rp.top_findings(found, tables)


@query(
    "client_name:s analysis_id:i severity:s potential_recovery:d billing_date:t property_name:s vendor_name:s "
    "plain_english_reason:s",
    "SELECT * FROM finding_star WHERE NOT reviewed",
)
def dashboard_flat(spark, folder):
    tables, found = findings_of(spark, folder)
    return rp.dashboard(found, tables)


_WORST_FIRST = "severity_rank, potential_recovery DESC, analysis_id"


@query(
    "client_name:s page:i total_findings:i potential_recovery:d listing:s",
    f"""SELECT client_name, page, any_value(total_findings) AS total_findings, any_value(client_recovery) AS potential_recovery,
        string_agg(position || '|' || analysis_id || '|' || severity || '|' || potential_recovery, ';' ORDER BY position) AS listing
        FROM (SELECT *, (position - 1) // 20 AS page FROM (
          SELECT *, row_number() OVER (PARTITION BY client_name ORDER BY {_WORST_FIRST}) AS position,
                 count(*) OVER (PARTITION BY client_name) AS total_findings,
                 sum(potential_recovery) OVER (PARTITION BY client_name) AS client_recovery
          FROM finding_star WHERE NOT reviewed))
        GROUP BY client_name, page""",
)
def dashboard_nested(spark, folder):
    tables, found = findings_of(spark, folder)
    pages = rp.dashboard_pages(staged(found, "findings"), tables, page_size=20)
    entry = lambda f: F.concat_ws("|", f["position"], f["analysis_id"], f["severity"], f["potential_recovery"])
    return pages.withColumn("listing", F.array_join(F.transform("findings", entry), ";"))


@query(
    "client_name:s analysis_id:i severity:s is_group_start:b",
    f"""SELECT client_name, analysis_id, severity, lag(severity) OVER (PARTITION BY client_name ORDER BY {_WORST_FIRST})
        IS DISTINCT FROM severity AS is_group_start FROM finding_star WHERE NOT reviewed""",
)
def group_breaks(spark, folder):
    tables, found = findings_of(spark, folder)
    return rp.group_breaks(staged(found, "findings"), tables)


@query(
    "client_name:s first_position:i client_rank:i",
    f"""SELECT client_name, min(p) AS first_position, row_number() OVER (ORDER BY min(p)) AS client_rank FROM (
        SELECT client_name, row_number() OVER (ORDER BY {_WORST_FIRST}) AS p FROM finding_star WHERE NOT reviewed) GROUP BY client_name""",
)
def group_order(spark, folder):
    """Clients in the order in which the listing first names them."""
    tables, found = findings_of(spark, folder)
    return rp.group_order(staged(found, "findings"), tables)


@query(
    "bills:i accounts:i clients:i",
    """SELECT count(*) AS bills, count(DISTINCT account_id) AS accounts, count(DISTINCT client_id) AS clients
       FROM bills JOIN (SELECT account_id, client_id FROM accounts JOIN properties USING (property_id)) USING (account_id) WHERE total_amount > 0""",
)
def distinct_counts(spark, folder):
    return rp.distinct_counts(tables_of(spark, folder))


_PLACES = """(SELECT DISTINCT CAST(c_custkey % 131 AS DOUBLE) / 10 - 1.5 AS lat,
  CASE WHEN c_custkey % 3 = 0 THEN -179.9 ELSE CAST(c_custkey % 977 AS DOUBLE) / 3 - 20 END AS lon FROM customer)"""
_GRID = "(SELECT DISTINCT CAST(user_id % 10 AS DOUBLE) AS lat, CASE WHEN user_id % 7 = 0 THEN 179.75 ELSE CAST(user_id % 300 AS DOUBLE) END AS lon FROM events)"


@query(
    "lat:r6 lon:r6 point_lat:d point_lon:d distance_km:r4",
    f"""WITH asked AS {_PLACES}, grid AS {_GRID},
        pairs AS (SELECT a.lat, a.lon, g.lat AS point_lat, g.lon AS point_lon,
          12742.0 * asin(sqrt(least(1.0, sin(radians(g.lat - a.lat) / 2) * sin(radians(g.lat - a.lat) / 2)
            + cos(radians(a.lat)) * cos(radians(g.lat)) * sin(radians(g.lon - a.lon) / 2) * sin(radians(g.lon - a.lon) / 2)))) AS distance_km
          FROM asked a JOIN grid g ON abs(a.lat - g.lat) <= 0.75
            AND least(abs(a.lon - g.lon), 360 - abs(a.lon - g.lon)) <= 0.75),
        best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY lat, lon ORDER BY distance_km, point_lat, point_lon) = 1)
        SELECT a.lat, a.lon, point_lat, point_lon, distance_km FROM asked a LEFT JOIN best b ON a.lat = b.lat AND a.lon = b.lon""",
)
def nearest_weather(spark, folder):
    """The nearest grid point of every location, over the date line too; locations without one keep nulls."""
    asked, grid = (spark.sql(text.strip("()").replace("customer", f"parquet.`{folder}/customer.parquet`").replace("events", f"parquet.`{folder}/events.parquet`")) for text in (_PLACES, _GRID))
    return nearest(asked, grid, 0.75)


@query(
    "client_name:s findings:i recovery:d",
    f"""SELECT client_name, findings, recovery FROM ({_BY_CLIENT} WHERE NOT reviewed GROUP BY client_name)
        UNION ALL SELECT 'TOTAL', count(*), sum(potential_recovery) FROM finding_star WHERE NOT reviewed""",
)
def auditor_report(spark, folder):
    tables, found = findings_of(spark, folder)
    return rp.auditor_report(staged(found, "findings"), tables)


# --- ingest ----------------------------------------------------------------

def records_of(spark: Spark, folder: str) -> DataFrame:
    return ig.process(demo.extracted_json(spark, folder))


@query(
    "record_id:i source_file:s read_status:s provider_name:s issues:s",
    """SELECT record_id, source_file, CASE WHEN readable THEN 'read' ELSE fault END AS read_status,
       CASE WHEN readable THEN provider_name END AS provider_name,
       concat_ws(', ', CASE WHEN NOT readable OR provider_name IS NULL THEN 'missing provider_name' END,
         CASE WHEN NOT readable THEN 'missing account_number' END, CASE WHEN NOT readable THEN 'missing utility_type' END,
         CASE WHEN NOT readable THEN 'missing total_amount_due' END,
         CASE WHEN NOT readable THEN 'missing is_anomaly_detected' END,
         CASE WHEN readable AND sent_utility = 'Water' THEN 'unlisted utility_type' END,
         CASE WHEN readable AND sent_unit NOT IN ('kWh', 'Therms') THEN 'unlisted usage_unit' END) AS issues
       FROM records""",
)
def parse_records(spark, folder):
    rows = ig.conformance(ig.parse_records(demo.extracted_json(spark, folder)))
    return rows.withColumn("issues", F.array_join("conformance_issues", ", "))


@query(
    "record_id:i utility_type:s usage_unit:s account_number:s credits:d",
    """SELECT record_id, utility AS utility_type, CASE WHEN unit IN ('kWh', 'Therms') THEN unit ELSE 'Unknown' END AS usage_unit,
       account_number, credit AS credits FROM records WHERE readable""",
)
def normalise(spark, folder):
    rows = ig.coerce_codes(ig.normalise(ig.parse_records(demo.extracted_json(spark, folder))))
    return rows.filter("read_status = 'read'")


@query(
    "record_id:i charge_total:d discrepancy:d is_anomaly_detected:b anomaly_reason:s",
    """SELECT record_id, charge_total, discrepancy, discrepancy > 0.02 AS is_anomaly_detected,
       CASE WHEN discrepancy > 0.02 THEN 'MATH AUDIT FAILED. The charges come to $' || CAST(charge_total AS DECIMAL(18,2))
         || ' and the bill asks for $' || CAST(total_amount_due AS DECIMAL(18,2)) || '. Discrepancy of $'
         || CAST(discrepancy AS DECIMAL(18,2)) || '.' ELSE 'Charges and total agree.' END AS anomaly_reason
       FROM records WHERE readable""",
)
def math_audit(spark, folder):
    return records_of(spark, folder).filter("read_status = 'read'")


@query(
    "record_id:i form_total:d form_discrepancy:d form_verdict:s missing:s",
    """SELECT record_id, form_total, form_discrepancy,
       CASE WHEN total_amount_due <= 0 OR form_total <= 0 THEN 'not checkable'
            WHEN form_discrepancy > 0.02 THEN 'mismatch' ELSE 'agrees' END AS form_verdict,
       concat_ws(', ', CASE WHEN provider_name IS NULL THEN 'provider_name' END,
         CASE WHEN billing_date IS NULL THEN 'billing_date' END,
         CASE WHEN total_amount_due = 0 THEN 'total_amount_due' END) AS missing FROM records WHERE readable""",
)
def form_audit(spark, folder):
    rows = ig.form_audit(records_of(spark, folder)).filter("read_status = 'read'")
    return rows.withColumn("missing", F.array_join("missing_fields", ", "))


@query(
    "record_id:i status:s reasons:s",
    "SELECT record_id, CASE WHEN reasons = '' THEN 'accepted' ELSE 'rejected' END AS status, reasons FROM records",
)
def reject_gate(spark, folder):
    return records_of(spark, folder).withColumn("reasons", F.array_join("reject_reasons", ", "))


@query(
    "status:s records:i",
    """SELECT CASE WHEN reasons = '' THEN 'accepted' ELSE 'rejected' END AS status, count(*) AS records
       FROM records GROUP BY 1""",
)
def batch_summary(spark, folder):
    return ig.batch_summary(records_of(spark, folder))


@query(
    "record_id:i category:s total_price:d",
    """SELECT record_id, category, total_price FROM (
       SELECT record_id, reasons, unnest(['Fixed Monthly Charge', 'Delivery Charge', 'Supply Charge', 'Demand Charge',
         'Taxes and Surcharges', 'Credit']) AS category,
         unnest([fixed, delivery, supply, demand, taxes, -credit]) AS total_price FROM records)
       WHERE reasons = '' AND total_price <> 0""",
)
def line_items_explode(spark, folder):
    accepted = records_of(spark, folder).filter("status = 'accepted'").withColumn("bill_id", F.col("record_id"))
    return ig.line_items(accepted).withColumnRenamed("bill_id", "record_id")


_KNOWN_ACCOUNT = "account_id % 3 <> 0"


def _some_known(spark: Spark, folder: str) -> ig.Intake:
    """Intake against a store that knows some of the vendors and accounts."""
    tables = tables_of(spark, folder)
    vendors = tables.vendors.filter("vendor_id < 4").withColumn(
        "vendor_name", F.concat(F.lit("Vendor "), F.col("vendor_id"))
    )
    return ig.intake(records_of(spark, folder), vendors, tables.accounts.filter(_KNOWN_ACCOUNT), RUN_TIME)


@query(
    "kind:s name:s",
    f"""SELECT DISTINCT 'vendor' AS kind, provider_name AS name FROM records
        WHERE reasons = '' AND provider_name NOT IN (SELECT 'Vendor ' || vendor_id FROM vendors WHERE vendor_id < 4)
        UNION ALL SELECT DISTINCT 'account', account_number FROM records WHERE reasons = ''
        AND account_number NOT IN (SELECT account_number FROM accounts WHERE {_KNOWN_ACCOUNT})""",
)
def dim_upsert(spark, folder):
    parts = _some_known(spark, folder)
    return parts.new_vendors.select(F.lit("vendor").alias("kind"), F.col("vendor_name").alias("name")).unionByName(
        parts.new_accounts.select(F.lit("account").alias("kind"), F.col("account_number").alias("name"))
    )


@query(
    "source_file:s known_account:d utility_type:s billing_date:t total_amount:d is_anomaly_detected:b",
    f"""SELECT source_file, CASE WHEN CAST(account_number AS BIGINT) % 3 <> 0 THEN CAST(account_number AS BIGINT) END AS known_account,
        utility AS utility_type, billing_date, total_amount_due AS total_amount, discrepancy > 0.02 AS is_anomaly_detected
        FROM records WHERE reasons = ''""",
)
def bill_intake(spark, folder):
    known = tables_of(spark, folder).accounts.filter(_KNOWN_ACCOUNT).select("account_id")
    bills = _some_known(spark, folder).bills
    return bills.join(
        known.withColumn("known_account", F.col("account_id")), "account_id", "left"
    )


@query(
    "table_name:s rule:s column_name:s value:s violations:i",
    """SELECT 'line_items' AS table_name, 'UNIQUE' AS rule, 'item_id' AS column_name, CAST(item_id AS VARCHAR) AS value,
         count(*) AS violations FROM (SELECT item_id FROM line_items UNION ALL
           SELECT -item_id FROM line_items WHERE bill_id % 97 = 5) GROUP BY item_id HAVING count(*) > 1
       UNION ALL SELECT 'line_items', 'ALLOWED VALUES', 'category', 'Mystery ' || (bill_id % 3), count(*)
         FROM line_items WHERE bill_id % 97 = 5 GROUP BY bill_id % 3
       UNION ALL SELECT 'line_items', 'FOREIGN KEY', 'bill_id', CAST(-bill_id AS VARCHAR), count(*)
         FROM line_items WHERE bill_id % 97 = 5 GROUP BY bill_id""",
)
def constraint_violations(spark, folder):
    tables = tables_of(spark, folder)
    planted = tables.line_items.filter("bill_id % 97 = 5").withColumns(
        {
            "item_id": -F.col("item_id"),
            "category": F.concat(F.lit("Mystery "), F.col("bill_id") % 3),
            "bill_id": -F.col("bill_id"),
        }
    )
    tables.line_items = tables.line_items.unionByName(planted)
    return violations(tables.present())


@query("doc_id:i page_no:i is_billing:b", "SELECT * FROM judged_pages")
def page_filter(spark, folder):
    return demo.bill_pages(spark, folder).withColumn("is_billing", tx.is_billing_page(F.col("text")))


@query(
    "doc_id:i part:i pages:i included:i text:s",
    """SELECT doc_id, 0 AS part, count(*) AS pages, count(*) FILTER (is_billing) AS included,
       coalesce(string_agg(CASE WHEN is_billing THEN '--- PAGE ' || (page_no + 1) || ' ---' || chr(10) || text || chr(10) END,
         '' ORDER BY page_no), '') AS text FROM judged_pages GROUP BY doc_id""",
)
def document_assembly(spark, folder):
    return ig.assemble_documents(demo.bill_pages(spark, folder))


@query(
    "doc_id:i page_no:i route:s",
    f"SELECT doc_id, page_no, CASE WHEN length({o.trimmed('text')}) > 100 THEN 'digital' ELSE 'scan' END AS route FROM bill_pages",
)
def text_route(spark, folder):
    return demo.bill_pages(spark, folder).withColumn("route", tx.text_route(F.col("text")))


@query(
    "doc_id:i page_no:i cleaned:s",
    f"""SELECT doc_id, page_no, array_to_string(list_filter(list_transform(string_split(text, chr(10)),
        lambda y: {o.trimmed('y')}), lambda x: {o.KEPT_LINE}), chr(10)) AS cleaned FROM bill_pages""",
)
def line_cleaner(spark, folder):
    return demo.bill_pages(spark, folder).withColumn("cleaned", tx.clean_lines(F.col("text")))


@query(
    "doc_id:i page_no:i total_amount_due:d account_number:s",
    r"""SELECT doc_id, page_no, coalesce(TRY_CAST(nullif(regexp_extract(text, 'Total Amount Due \$([0-9.]+)', 1), '') AS DOUBLE), 0) AS total_amount_due,
       regexp_extract(text, 'Account Number ([0-9]+)', 1) AS account_number FROM bill_pages""",
)
def pattern_extract(spark, folder):
    pages = demo.bill_pages(spark, folder).withColumns(
        {"record_id": F.col("doc_id") * 4 + F.col("page_no"), "source_file": F.lit("")}
    )
    rows = ig.normalise(ig.parse_records(ig.extract(pages)))
    return rows.withColumns(
        {"doc_id": F.floor(F.col("record_id") / 4), "page_no": F.col("record_id") % 4}
    )


# --- documents to stored bills ---------------------------------------------

_PAPER_FIELDS = (
    "record_id:i provider_name:s account_number:s utility_type:s statement_date:s service_period_start:s service_period_end:s "
    "total_amount_due:d usage_volume:d usage_unit:s rate_code:s fixed_monthly_charge:d delivery_charge:d supply_charge:d "
    "demand_charge:d taxes_and_surcharges:d credits:d is_anomaly_detected:b"
)
_PAPER_SQL = """SELECT d AS record_id, provider AS provider_name, account_number, utility AS utility_type, month || '15' AS statement_date,
  month || '01' AS service_period_start, month || '14' AS service_period_end, total AS total_amount_due, usage AS usage_volume,
  CASE unit WHEN 'CCF' THEN 'Therms' ELSE unit END AS usage_unit, rate_code, basic AS fixed_monthly_charge, delivery AS delivery_charge,
  supply AS supply_charge, demand AS demand_charge, taxes AS taxes_and_surcharges, credits, false AS is_anomaly_detected FROM papers"""


def paper_texts(spark: Spark, folder: str) -> DataFrame:
    texts = bt.document_texts(demo.paper_bills(spark, folder))
    return texts.filter("doc_id % 12 <> 5").withColumn("record_id", F.col("doc_id"))


@query(_PAPER_FIELDS, f"{_PAPER_SQL} WHERE d % 12 <> 5")
def extractor_fields(spark, folder):
    """All fields that the default extractor reads, from every paper that holds a bill."""
    return ig.normalise(ig.parse_records(ig.extract(paper_texts(spark, folder))))


def read_paper(prompt: str, text: str) -> dict:
    """A small extractor of labelled lines; it fails on short account numbers."""
    found = dict(re.findall(r"(?m)^([A-Z][A-Za-z ]+?)(?::| \$) ?(.+)$", text[: text.index("Total Amount Due") + 60]))

    def money(name):
        return float(found[name].replace(",", ""))

    if len(found["Account Number"]) < 5:
        raise ValueError("no account")
    usage, unit = found["Usage"].replace(",", "").split()
    start, end = found["Service Period"].split(" to ")
    return {
        "provider_name": found.get("Provider"), "account_number": found["Account Number"], "utility_type": "Unknown",
        "statement_date": found["Statement Date"], "service_period_start": start, "service_period_end": end,
        "total_amount_due": money("Total Amount Due"), "usage_volume": float(usage), "usage_unit": unit, "rate_code": found["Rate Code"],
        "fixed_monthly_charge": money("Basic Service Charge"), "delivery_charge": money("Delivery Services"),
        "supply_charge": money("Supply Charge"), "demand_charge": money("Demand Charge"),
        "taxes_and_surcharges": money("Taxes and Surcharges"), "credits": -money("Credits"), "is_anomaly_detected": False,
    }


@query(
    f"read_status:s {_PAPER_FIELDS}",
    f"""SELECT 'read' AS read_status, * FROM ({_PAPER_SQL}) WHERE record_id % 12 NOT IN (5, 9)
        UNION ALL SELECT 'extractor_error', d, NULL, '', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
        FROM papers WHERE d % 12 = 9""",
)
def extractor_hook(spark, folder):
    """The same through a plugged-in extractor that fails on some papers."""
    importable(spark)
    answers = ig.extract(paper_texts(spark, folder), bt.row_extractor(read_paper))
    return ig.normalise(ig.parse_records(answers))


def papers_taken_in(spark: Spark, folder: str) -> tuple[str, bt.BatchResult]:
    """All papers in one batch, which is written twice, and a second one that delivers every seventh paper again."""
    root = f"{staging_root(spark)}/papers-{uuid.uuid4().hex}"
    prepare_store(spark, root)
    pages = demo.paper_bills(spark, folder)
    for _ in range(2):
        result = bt.take_in_documents(pages, 0, root, audit_time=RUN_TIME)
    bt.take_in_documents(pages.filter("doc_id % 7 = 0"), 1, root, audit_time=RUN_TIME)
    return root, result


@query(
    "source_file:s vendor_name:s account_number:s utility_type:s billing_date:t service_period_start:t service_period_end:t "
    "total_amount:d usage_volume:d usage_unit:s rate_code:s is_anomaly_detected:b items:i charged:d",
    """SELECT d || '.pdf' AS source_file, provider AS vendor_name, account_number, utility AS utility_type, CAST(month || '15' AS DATE) AS billing_date,
       CAST(month || '01' AS DATE) AS service_period_start, CAST(month || '14' AS DATE) AS service_period_end, total AS total_amount,
       usage AS usage_volume, CASE unit WHEN 'CCF' THEN 'Therms' ELSE unit END AS usage_unit, rate_code, total <> charged AS is_anomaly_detected,
       4 + CAST(demand > 0 AS INT) + CAST(credits > 0 AS INT) AS items, charged FROM papers WHERE reasons = ''""",
)
def document_intake(spark, folder):
    """Papers to stored bills with their vendors, accounts and items, read back from the store."""
    root, _ = papers_taken_in(spark, folder)
    bills, accounts, vendors, items = (read_table(spark, root, t) for t in ("bills", "accounts", "vendors", "line_items"))
    charged = items.groupBy("bill_id").agg(F.count("*").alias("items"), F.sum("total_price").alias("charged"))
    named = bills.join(accounts.select("account_id", "account_number", "vendor_id"), "account_id")
    return named.join(vendors, "vendor_id").join(charged, "bill_id")


@query(
    "batch_id:i record_id:i source_file:s route:s pages:i included:i answers:i status:s reasons:s stored:b",
    """SELECT batch_id, d AS record_id, '/papers/' || d || '.pdf' AS source_file, CASE WHEN d % 5 = 3 THEN 'scan' ELSE 'digital' END AS route,
       pages, CASE WHEN d % 5 = 3 THEN billing_pages ELSE pages END AS included, 1 AS answers,
       CASE WHEN reasons <> '' THEN 'rejected' WHEN batch_id = 0 THEN 'accepted' ELSE 'repeated' END AS status, reasons, reasons = '' AS stored
       FROM papers, (VALUES (0), (1)) AS batches(batch_id) WHERE batch_id = 0 OR d % 7 = 0""",
)
def document_status(spark, folder):
    """What became of every paper, batch by batch."""
    root, _ = papers_taken_in(spark, folder)
    status = read_batches(spark, root, "document_status")
    return status.withColumns({"reasons": F.array_join("reject_reasons", ", "), "stored": F.col("bill_id").isNotNull()})


@query(
    "counter:s value:i",
    """WITH good AS (SELECT * FROM papers WHERE reasons = '')
       SELECT 'documents' AS counter, count(*) AS value FROM papers UNION ALL SELECT 'answers', count(*) FROM papers
       UNION ALL SELECT 'digital', count(*) FROM papers WHERE d % 5 <> 3 UNION ALL SELECT 'scan', count(*) FROM papers WHERE d % 5 = 3
       UNION ALL SELECT 'accepted', count(*) FROM good UNION ALL SELECT 'bills', count(*) FROM good UNION ALL SELECT 'taken', count(*) FROM good
       UNION ALL SELECT 'rejected', count(*) FROM papers WHERE reasons <> '' UNION ALL SELECT 'quarantine', count(*) FROM papers WHERE reasons <> ''
       UNION ALL SELECT 'repeated', 0 UNION ALL SELECT 'unanswered', 0 UNION ALL SELECT 'vendors', count(DISTINCT provider) FROM good
       UNION ALL SELECT 'accounts', count(DISTINCT account_number) FROM good
       UNION ALL SELECT 'line_items', sum(4 + CAST(demand > 0 AS INT) + CAST(credits > 0 AS INT)) FROM good""",
)
def document_counters(spark, folder):
    """Counters taken while the batch was written, without another pass."""
    _, result = papers_taken_in(spark, folder)
    return spark.createDataFrame(sorted(result.counters.items()), "counter string, value long")


# --- model -----------------------------------------------------------------

def rule_frame(spark: Spark, folder: str) -> DataFrame:
    return with_history(scored_of(tables_of(spark, folder))).select(
        F.col("is_anomaly_detected").cast("double").alias("label"),
        F.col("ml_flagged").cast("double").alias("prediction"),
        F.abs("zscore_overall").alias("score"),
    )


@query(
    "label:d rows:i weight:r4",
    """SELECT CAST(truth AS INTEGER) AS label, count(*) AS rows,
       sum(count(*)) OVER () / (2.0 * count(*)) AS weight FROM held_out GROUP BY truth""",
)
def class_weights(spark, folder):
    return ml.class_weights(rule_frame(spark, folder))


@query("tn:i fp:i fn:i tp:i", "SELECT * FROM matrix")
def confusion(spark, folder):
    return ml.confusion(rule_frame(spark, folder))


@query(
    "class:s precision:r4 recall:r4 f1:r4 support:d",
    """WITH c AS (SELECT CAST(tn AS DOUBLE) AS tn, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, CAST(tp AS DOUBLE) AS tp FROM matrix),
       r AS (SELECT 'Normal' AS class, tn / (tn + fn) AS precision, tn / (tn + fp) AS recall, 2 * tn / (2 * tn + fn + fp) AS f1, tn + fp AS support FROM c
             UNION ALL SELECT 'Anomaly', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn FROM c)
       SELECT * FROM r UNION ALL SELECT 'accuracy', (tn + tp) / (tn + fp + fn + tp), (tn + tp) / (tn + fp + fn + tp),
         (tn + tp) / (tn + fp + fn + tp), tn + fp + fn + tp FROM c
       UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM r
       UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
         sum(f1 * support) / sum(support), sum(support) FROM r""",
)
def class_report(spark, folder):
    return ml.class_report(ml.confusion(rule_frame(spark, folder)))


@query(
    "bills:i anomalies:i caught:i missed:i false_alarms:i miss_rate_pct:r4 catch_rate_pct:r4 false_alarm_pct:r4",
    """SELECT tn + fp + fn + tp AS bills, fn + tp AS anomalies, tp AS caught, fn AS missed, fp AS false_alarms,
       100.0 * fn / (fn + tp) AS miss_rate_pct, 100.0 * tp / (fn + tp) AS catch_rate_pct,
       100.0 * fp / (tn + fp) AS false_alarm_pct FROM matrix""",
)
def business_metrics(spark, folder):
    return ml.business_metrics(ml.confusion(rule_frame(spark, folder)))


@query(
    "roc_auc:r4",
    """SELECT (sum(rk) FILTER (truth) - p * (p + 1) / 2.0) / (p * n) AS roc_auc FROM (
       SELECT truth, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk,
              count(*) FILTER (truth) OVER () AS p, count(*) FILTER (NOT truth) OVER () AS n FROM held_out)
       GROUP BY p, n""",
)
def roc_auc(spark, folder):
    area = ml.roc_auc(staged(rule_frame(spark, folder), "scores"))
    return spark.createDataFrame([(area,)], "roc_auc double")


@query(
    "bills:i flagged:i flagged_pct:r4 skipped:i",
    """SELECT count(*) AS bills, count(*) FILTER (ml_flagged) AS flagged,
       100.0 * count(*) FILTER (ml_flagged) / count(*) AS flagged_pct,
       count(*) FILTER (account_bill_count < 12) AS skipped FROM scored""",
)
def scoring_totals(spark, folder):
    return ml.scoring_totals(scored_of(tables_of(spark, folder)))


@query(
    "bills:i flagged:i flagged_pct:r4 skipped:i findings:i urgent:i high:i recovery:d stored:i",
    """SELECT * FROM (SELECT count(*) AS bills, count(*) FILTER (ml_flagged) AS flagged,
         100.0 * count(*) FILTER (ml_flagged) / count(*) AS flagged_pct, count(*) FILTER (account_bill_count < 12) AS skipped FROM scored),
       (SELECT count(*) AS findings, count(*) FILTER (severity = 'URGENT') AS urgent, count(*) FILTER (severity = 'HIGH') AS high,
         sum(potential_recovery) AS recovery, count(*) AS stored FROM findings)""",
)
def detection_counters(spark, folder):
    """What a run counts while its findings are written, beside what is stored."""
    root = f"{staging_root(spark)}/run-{uuid.uuid4().hex}"
    prepare_store(spark, root)
    tables = tables_of(spark, folder)
    totals = dt.record_findings(scored_of(tables), weather_of(spark, folder, tables), root, 0, RUN_TIME)
    stored = read_table(spark, root, "findings").agg(F.count("*").alias("stored"))
    return stored.select("stored", *[F.lit(value).alias(name) for name, value in totals.items()])


_DRAWN = "CAST('0x' || substr(md5(bill_id || ':{seed}'), 1, 15) AS BIGINT)"
_STRATA = f"""SELECT bill_id, CAST(is_anomaly_detected AS INT) AS label, count(*) OVER (PARTITION BY is_anomaly_detected) AS n,
  row_number() OVER (PARTITION BY is_anomaly_detected ORDER BY {_DRAWN.format(seed=42)}, bill_id) AS h,
  row_number() OVER (PARTITION BY is_anomaly_detected ORDER BY {_DRAWN.format(seed=43)}, bill_id) AS f
  FROM scored WHERE account_bill_count >= 12"""


@query(
    "bill_id:i label:d holdout:b fold:i",
    f"""SELECT bill_id, label, h <= (n * 20 + 50) // 100 AS holdout,
       CAST(f > n // 5 AS INT) + CAST(f > n * 2 // 5 AS INT) + CAST(f > n * 3 // 5 AS INT) + CAST(f > n * 4 // 5 AS INT) AS fold
       FROM ({_STRATA})""",
)
def holdout_split(spark, folder):
    return ml.training_frame(fe.coded_features(tables_of(spark, folder)))


@query(
    "part:s label:d rows:i",
    f"""SELECT part, label, count(*) AS rows FROM (
       SELECT label, 'held out' AS part FROM ({_STRATA}) WHERE h <= (n * 20 + 50) // 100
       UNION ALL SELECT label, 'fold ' || (CAST(f > n // 5 AS INT) + CAST(f > n * 2 // 5 AS INT)
         + CAST(f > n * 3 // 5 AS INT) + CAST(f > n * 4 // 5 AS INT)) FROM ({_STRATA})) GROUP BY part, label""",
)
def strata_sizes(spark, folder):
    """Rows of each class held out and in each fold."""
    frame = staged(ml.training_frame(fe.coded_features(tables_of(spark, folder))).drop("features"), "frame")
    held = frame.filter("holdout").select(F.lit("held out").alias("part"), "label")
    folds = frame.select(F.concat(F.lit("fold "), "fold").alias("part"), "label")
    return held.unionByName(folds).groupBy("part", "label").agg(F.count("*").alias("rows"))


@query("bill_id:i ml_anomaly_probability:r4 ml_flagged:b")
def rf_score(spark, folder):
    coded = fe.coded_features(tables_of(spark, folder))
    return ml.score_bills(coded, ml.train(ml.training_frame(coded)))


@query("feature:s title:s importance:r4")
def rf_importance(spark, folder):
    coded = fe.coded_features(tables_of(spark, folder))
    return ml.feature_importance(spark, ml.train(ml.training_frame(coded)))


@query("bills:i roc_auc:r4 mean_f1:r4 f1_spread:r4")
def rf_cv(spark, folder):
    frame = staged(ml.training_frame(fe.coded_features(tables_of(spark, folder))), "frame")
    held = ml.probabilities(ml.train(frame), frame.filter("holdout"))
    area, (mean, spread) = ml.roc_auc(held), ml.cross_validated_f1(frame)
    return frame.agg(F.count("*").alias("bills")).select(
        "bills", F.lit(area).alias("roc_auc"), F.lit(mean).alias("mean_f1"), F.lit(spread).alias("f1_spread")
    )


@query("detection_layer:s finding_type:s severity:s findings:i recovery:d")
def detection_run(spark, folder):
    run = dt.detect(tables_of(spark, folder), demo.weather_daily(spark, folder), run_time=RUN_TIME)
    return run.findings.groupBy("detection_layer", "finding_type", "severity").agg(
        F.count("*").alias("findings"), F.sum("potential_recovery").alias("recovery")
    )


# --- review and streaming --------------------------------------------------

def decided(spark: Spark, folder: str):
    """Confirm and dismiss by bill number, with repeats and unknown ids planted."""
    tables, found = findings_of(spark, folder)
    found = staged(found.withColumn("reviewed", F.lit(False)), "findings")
    key = F.col("analysis_id")
    named = found.select(
        (key * 10).alias("decision_no"), "analysis_id",
        F.when(key % 5 == 0, "confirm").when(key % 5 == 1, "dismiss").when(key % 5 == 2, "archive").alias("action"),
        F.when(key % 10 == 0, "checked").alias("note"),
    ).filter(key % 5 < 3)
    repeats = named.filter(key % 5 == 0).withColumns({"decision_no": F.col("decision_no") + 1, "action": F.lit("dismiss")})
    unknown = named.filter(key % 7 == 1).withColumn("analysis_id", -key)
    decisions = named.unionByName(repeats).unionByName(unknown)
    return apply_decisions(found, tables.bills, decisions, RUN_DATE)


@query(
    "analysis_id:i bill_id:i action:s note:s",
    """SELECT analysis_id, bill_id, CASE analysis_id % 5 WHEN 0 THEN 'confirm' ELSE 'dismiss' END AS action,
       CASE WHEN analysis_id % 10 = 0 THEN 'checked' END AS note FROM findings WHERE analysis_id % 5 IN (0, 1)""",
)
def review_decisions(spark, folder):
    return decided(spark, folder).log


@query("analysis_id:i reviewed:b", "SELECT analysis_id, analysis_id % 5 IN (0, 1) AS reviewed FROM findings")
def review_findings(spark, folder):
    return decided(spark, folder).findings


@query(
    "bill_id:i anomaly_status:s",
    """SELECT b.bill_id, CASE WHEN f.bill_id IS NULL THEN 'Unreviewed' WHEN b.bill_id % 5 = 0 THEN 'Confirmed'
       WHEN b.bill_id % 5 = 1 THEN 'Dismissed' ELSE 'Unreviewed' END AS anomaly_status
       FROM bills b LEFT JOIN findings f ON f.bill_id = b.bill_id""",
)
def review_bills(spark, folder):
    return decided(spark, folder).bills


@query(
    "bill_id:i claim_date:t claim_reason:s amount_disputed:d status:s",
    """SELECT bill_id, DATE '2024-06-01' AS claim_date, plain_english_reason || CASE WHEN bill_id % 10 = 0
       THEN ' Reviewer: checked' ELSE '' END AS claim_reason, potential_recovery AS amount_disputed, 'Open' AS status
       FROM findings WHERE bill_id % 5 = 0""",
)
def review_claims(spark, folder):
    return decided(spark, folder).new_claims


@query(
    "analysis_id:i error:s",
    """SELECT analysis_id, 'unknown action: archive' AS error FROM findings WHERE analysis_id % 5 = 2
       UNION ALL SELECT -analysis_id, CASE WHEN analysis_id % 5 = 2 THEN 'unknown action: archive' ELSE 'no such finding' END
       FROM findings WHERE analysis_id % 5 < 3 AND analysis_id % 7 = 1 AND analysis_id > 0""",
)
def review_errors(spark, folder):
    return decided(spark, folder).errors


def stored(spark: Spark, folder: str) -> AuditTables:
    """Bills, two detection runs and two review batches, written and read back; each batch is written twice."""
    root = f"{staging_root(spark)}/store-{uuid.uuid4().hex}"
    prepare_store(spark, root)
    tables, found = findings_of(spark, folder)
    for name in ("clients", "properties", "vendors", "accounts", "bills", "line_items"):
        write_batch(getattr(tables, name), root, name, 0)
    found = staged(found.withColumn("reviewed", F.lit(False)), "findings")  # derived once, written four times
    for run in (0, 1):
        fresh = found.withColumn("detected_at", F.col("detected_at") + F.expr(f"INTERVAL {run} DAY"))
        for _ in range(2):
            write_batch(fresh, root, "findings", run)
        current = read_tables(spark, root)
        decisions = current.findings.filter(f"analysis_id % 5 < {run + 1}").selectExpr(
            "analysis_id * 10 AS decision_no", "analysis_id",
            "IF(analysis_id % 5 = 0, 'confirm', 'dismiss') AS action", "CAST(NULL AS STRING) AS note",
        )
        reviewed = apply_decisions(current.findings, current.bills, decisions, RUN_DATE)
        for _ in range(2):
            write_review(reviewed, root, run)
    return read_tables(spark, root)


@query(
    "analysis_id:i detection_layer:s potential_recovery:d detected_at:t reviewed:b",
    "SELECT * EXCLUDE (reviewed), DATE '2024-06-02' AS detected_at, analysis_id % 5 < 2 AS reviewed FROM findings",
)
def findings_store(spark, folder):
    """The second run's findings, with its reviews laid over."""
    return stored(spark, folder).findings


@query(
    "bill_id:i amount_disputed:d run:i",
    """SELECT bill_id, potential_recovery AS amount_disputed, run FROM findings, (VALUES (0), (1)) AS runs(run)
       WHERE bill_id % 5 = 0""",
)
def claims_store(spark, folder):
    """Claims of both runs, each once."""
    claims = stored(spark, folder).audit_claims
    run = F.row_number().over(Window.partitionBy("bill_id").orderBy("claim_id")) - 1
    return claims.select("bill_id", "amount_disputed", run.alias("run"))


@query(
    "bill_id:i account_id:i billing_date:t billing_year:i total_amount:d anomaly_status:s",
    """SELECT b.*, year(b.billing_date) AS billing_year, CASE WHEN f.bill_id IS NULL OR b.bill_id % 5 > 1 THEN 'Unreviewed'
       WHEN b.bill_id % 5 = 0 THEN 'Confirmed' ELSE 'Dismissed' END AS anomaly_status
       FROM (SELECT * EXCLUDE (anomaly_status) FROM bills) b LEFT JOIN findings f ON f.bill_id = b.bill_id""",
)
def bills_store(spark, folder):
    """Bills by year, with the status of their last review."""
    return stored(spark, folder).bills


@query(
    "decision_no:i analysis_id:i action:s outcome:s",
    """WITH named AS (SELECT analysis_id, analysis_id * 10 AS decision_no,
         CASE analysis_id % 5 WHEN 0 THEN 'confirm' WHEN 1 THEN 'dismiss' ELSE 'archive' END AS action
         FROM findings WHERE analysis_id % 5 < 3)
       SELECT decision_no, analysis_id, action,
         CASE WHEN action = 'archive' THEN 'unknown action' ELSE 'applied' END AS outcome FROM named
       UNION ALL SELECT decision_no + 1, analysis_id, 'dismiss', 'repeated' FROM named WHERE analysis_id % 5 = 0
       UNION ALL SELECT decision_no, -analysis_id, action,
         CASE WHEN action = 'archive' THEN 'unknown action' ELSE 'no such finding' END
       FROM named WHERE analysis_id % 7 = 1""",
)
def review_outcomes(spark, folder):
    return decided(spark, folder).outcomes


@query(
    "bill_id:i decision_no:i run:s",
    """SELECT bill_id, bill_id * 10 AS decision_no, run FROM findings, (VALUES ('first'), ('second')) AS runs(run)
       WHERE bill_id % 5 = 0""",
)
def review_claims_of_two_runs(spark, folder):
    """Confirmed findings of two detection runs: each run's claims have ids of their own."""
    tables, found = findings_of(spark, folder)
    found = staged(found.withColumn("reviewed", F.lit(False)), "findings")
    decisions = found.filter("analysis_id % 5 = 0").selectExpr(
        "analysis_id * 10 AS decision_no", "analysis_id", "'confirm' AS action", "CAST(NULL AS STRING) AS note"
    )
    later = found.withColumn("detected_at", F.col("detected_at") + F.expr("INTERVAL 1 DAY"))
    claims = [
        apply_decisions(run, tables.bills, decisions, RUN_DATE).new_claims.withColumn("run", F.lit(name))
        for name, run in (("first", found), ("second", later))
    ]
    kept = claims[0].unionByName(claims[1]).dropDuplicates(["claim_id"])
    return kept.select("bill_id", (F.col("bill_id") * 10).alias("decision_no"), "run")


def in_order(spark: Spark, *folders: str) -> None:
    """Give an inbox's files the times of their order by name: which ones share a micro-batch depends on no writer's speed."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folders[0])
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [sorted((f for f in files.listStatus(spark._jvm.org.apache.hadoop.fs.Path(d)) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName()) for d in folders]
    listed = [f for part in found for f in part]
    first = min((f.getModificationTime() for f in listed), default=0)
    for k, f in enumerate(listed):
        files.setTimes(f.getPath(), first + k, -1)


@query(
    "kind:s rows:i total:d",
    """SELECT 'bills' AS kind, count(*) AS rows, sum(total_amount_due) AS total FROM records WHERE reasons = ''
       UNION ALL SELECT 'quarantine', count(*), NULL FROM records WHERE reasons <> ''
       UNION ALL SELECT 'vendors', count(DISTINCT provider_name), NULL FROM records WHERE reasons = ''
       UNION ALL SELECT 'accounts', count(DISTINCT account_number), NULL FROM records WHERE reasons = ''
       UNION ALL SELECT 'line_items', count(*), sum(price) FROM (SELECT reasons,
         unnest([fixed, delivery, supply, demand, taxes, -credit]) AS price FROM records) WHERE reasons = '' AND price <> 0""",
)
def stream_ingest(spark, folder):
    root = f"{staging_root(spark)}/stream-{uuid.uuid4().hex}"
    answers = demo.extracted_json(spark, folder).withColumn("record_id", F.col("record_id").cast("string"))
    more = demo.file_count(spark, folder, "orders", 4) // 4  # files for each of four, so that a batch is half of the inbox at any size
    with shuffles_dropped(spark):
        answers.repartition(4 * more).write.option("compression", "gzip").json(f"{root}/inbox")
    in_order(spark, f"{root}/inbox")
    drop_read(answers)
    start_intake(spark, f"{root}/inbox", f"{root}/store", f"{root}/checkpoint", files_per_batch=2 * more).awaitTermination()

    def stored(table, total):
        return read_table(spark, f"{root}/store", table).agg(
            F.lit(table).alias("kind"), F.count("*").alias("rows"), total.cast("double").alias("total")
        )

    none = F.lit(None)
    return (
        stored("bills", F.sum("total_amount"))
        .unionByName(stored("quarantine", none)).unionByName(stored("vendors", none))
        .unionByName(stored("accounts", none)).unionByName(stored("line_items", F.sum("total_price")))
    )


@query(
    "kind:s rows:i",
    """SELECT 'bills' AS kind, count(*) AS rows FROM records WHERE reasons = ''
       UNION ALL SELECT 'accepted', count(*) FROM records WHERE reasons = '' UNION ALL SELECT 'rejected', count(*) FROM records WHERE reasons <> ''
       UNION ALL SELECT 'repeated', count(*) FROM records WHERE reasons = '' AND record_id % 7 = 0""",
)
def stream_repeats(spark, folder):
    """Records that a later file delivers again are logged, not stored."""
    root = f"{staging_root(spark)}/stream-{uuid.uuid4().hex}"
    delivered = demo.extracted_json(spark, folder).withColumn("record_id", F.col("record_id").cast("string"))
    answers = staged(delivered, "answers")
    drop_read(delivered)
    again = answers.filter("CAST(record_id AS BIGINT) % 7 = 0").join(
        ig.process(answers).filter("status = 'accepted'").select("record_id"), "record_id", "left_semi"
    )
    more = demo.file_count(spark, folder, "orders", 4) // 4
    with shuffles_dropped(spark):
        answers.repartition(3 * more).write.option("compression", "gzip").json(f"{root}/inbox/first")
        second = again.withColumn("source_file", F.concat(F.lit("/again"), "source_file")).repartition(2 * more)
        second.write.option("compression", "gzip").json(f"{root}/inbox/second")
    in_order(spark, f"{root}/inbox/first", f"{root}/inbox/second")
    drop_read(answers)
    start_intake(spark, f"{root}/inbox/*", f"{root}/store", f"{root}/checkpoint", files_per_batch=2 * more).awaitTermination()
    log = spark.read.parquet(f"{root}/store/processed").groupBy(F.col("status").alias("kind")).agg(F.count("*").alias("rows"))
    return log.unionByName(read_table(spark, f"{root}/store", "bills").agg(F.lit("bills").alias("kind"), F.count("*").alias("rows")))


@query(
    "paper:i run:i status:s pages:i",
    """SELECT d AS paper, CAST(d % 2 AS INT) AS run, CASE WHEN reasons = '' THEN 'accepted' ELSE 'rejected' END AS status, 1 AS pages
       FROM papers WHERE d % 12 <> 5""",
)
def file_intake(spark, folder):
    """Text files found in a folder, in two runs; the second one finds what is new, a third one nothing."""
    root = f"{staging_root(spark)}/files-{uuid.uuid4().hex}"
    texts = staged(paper_texts(spark, folder).select("doc_id", F.col("text").alias("value")), "texts")
    # A batch of 1000 files, or a sixteenth of many; a run is as many batches as that takes.
    files, ends = max(1000, -(-demo.documents_count(spark, folder) // 64)), []
    for run in (0, 1):
        # One file for each paper.
        texts.filter(F.col("doc_id") % 2 == run).repartition("doc_id").write.mode("append").partitionBy("doc_id").text(f"{root}/inbox")
        start_document_intake(spark, f"{root}/inbox", f"{root}/store", f"{root}/checkpoint", files_per_batch=files).awaitTermination()
        ends.append(read_batches(spark, f"{root}/store", "document_status").agg(F.coalesce(F.max("batch_id"), F.lit(-1))).first()[0])
    start_document_intake(spark, f"{root}/inbox", f"{root}/store", f"{root}/checkpoint", files_per_batch=files).awaitTermination()
    status = read_batches(spark, f"{root}/store", "document_status")
    taken_by = sum((F.col("batch_id") > end).cast("long") for end in ends)
    return status.withColumns({"paper": F.regexp_extract("record_id", "doc_id=([0-9]+)", 1), "run": taken_by})
