"""Reports and look-ups over the audit tables and findings.

Group reports reduce the facts per account before they meet the dimensions, so
a hot account or client costs one row per task instead of its detail rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffscope.functions.dates import year_month
from tariffscope.functions.labels import FINDING_TITLES, LAYER_TITLES, titled
from tariffscope.functions.numeric import MONEY, mean_money, money_total
from tariffscope.functions.severity import ORDER, severity_rank
from tariffscope.operators import filters as where
from tariffscope.operators import periods
from tariffscope.operators.ordering import numbered
from tariffscope.operators.star import account_directory, bill_star, finding_star
from tariffscope.session import staged
from tariffscope.sources.tables import AuditTables




def _money(column: str, name: str) -> Column:
    return F.expr(f"{money_total(column)} AS {name}")


# --- clients and bills -----------------------------------------------------

def client_directory(tables: AuditTables) -> DataFrame:
    """Clients with their number of properties and accounts, 0 where none."""
    accounts = tables.accounts.groupBy("property_id").agg(F.count("*").alias("accounts"))
    sites = (
        tables.properties.select("client_id", "property_id")
        .join(accounts, "property_id", "left")
        .groupBy("client_id")
        .agg(F.count("*").alias("properties"), F.sum("accounts").alias("accounts"))
    )
    return (
        tables.clients.select("client_id", "client_name", "industry")
        .join(sites, "client_id", "left")
        .na.fill(0, ["properties", "accounts"])
        .orderBy("client_name")
    )


def _spending(bills: DataFrame) -> DataFrame:
    return (
        bills.groupBy("account_id", "utility_type")
        .agg(
            F.count("bill_id").alias("bill_count"),
            F.sum("total_amount").alias("spend"),
            F.count_if("is_anomaly_detected").alias("flagged"),
        )
        .selectExpr(
            "account_id", "utility_type", "bill_count", f"CAST(spend AS {MONEY}) AS total_spend",
            f"{mean_money('spend', 'bill_count')} AS avg_bill", "flagged",
        )
    )


def client_summary(tables: AuditTables, client_name: str = "") -> DataFrame:
    """Spend per account and utility with its site and vendor."""
    directory = where.where_all(account_directory(tables), where.contains("client_name", client_name))
    return (
        _spending(tables.bills)
        .join(directory, "account_id")
        .select(
            "client_name", "industry", "property_name", "address", "city", "account_number",
            "vendor_name", "utility_type", "bill_count", "total_spend", "avg_bill", "flagged",
        )
        .orderBy("property_name", "utility_type", "account_number")
    )


def flagged_bills(
    tables: AuditTables, client_name: str = "", status: str = "", utility_type: str = "", limit: int = 20
) -> DataFrame:
    """Newest flagged bills."""
    bills = where.where_all(
        tables.bills.filter("is_anomaly_detected"),
        where.equals("anomaly_status", status), where.equals("utility_type", utility_type),
    )
    return (
        where.where_all(bill_star(tables, bills), where.contains("client_name", client_name))
        .select(
            "client_name", "property_name", "vendor_name", "account_number", "utility_type",
            "billing_date", "total_amount", "anomaly_reason", "anomaly_status", "bill_id",
        )
        .orderBy(F.desc("billing_date"), "bill_id")
        .limit(limit)
    )


def bill_search(
    tables: AuditTables, account_number: str = "", client_name: str = "", utility_type: str = "",
    start_date: str = "", end_date: str = "", limit: int = 24,
) -> DataFrame:
    """Newest bills under optional filters."""
    bills = where.where_all(
        tables.bills, where.equals("utility_type", utility_type),
        where.between_days("billing_date", start_date, end_date), where.stored_years(tables.bills, start_date, end_date),
    )
    return (
        where.where_all(
            bill_star(tables, bills),
            where.equals("account_number", account_number), where.contains("client_name", client_name),
        )
        .select(
            "client_name", "property_name", "vendor_name", "account_number", "utility_type",
            "billing_date", "service_period_start", "service_period_end", "total_amount",
            "usage_volume", "usage_unit", "demand_read", "is_anomaly_detected", "anomaly_status", "bill_id",
        )
        .orderBy(F.desc("billing_date"), "bill_id")
        .limit(limit)
    )


def compare_periods(
    tables: AuditTables, first: tuple[str, str], second: tuple[str, str], account_number: str | None = None
) -> DataFrame:
    return periods.compare(tables.bills, tables.accounts, first, second, account_number)


def top_spenders(tables: AuditTables, utility_type: str = "", year: int = 0, limit: int = 10) -> DataFrame:
    """Accounts and utilities with the highest spend."""
    bills = where.where_all(
        tables.bills, where.equals("utility_type", utility_type), where.year_is("billing_date", year),
        where.stored_years(tables.bills, *[f"{year:04d}" if year else None] * 2),
    )
    return (
        _spending(bills)
        .join(account_directory(tables), "account_id")
        .select(
            "client_name", "property_name", "vendor_name", "account_number", "utility_type",
            "bill_count", "total_spend", F.col("avg_bill").alias("avg_monthly"), "flagged",
        )
        .orderBy(F.desc("total_spend"), "account_number", "utility_type")
        .limit(limit)
    )


def vendor_accounts(tables: AuditTables) -> DataFrame:
    """Every account with its vendor, including accounts without a property."""
    return tables.accounts.select("account_id", "vendor_id", "account_number").join(
        tables.vendors.select("vendor_id", "vendor_name"), "vendor_id"
    ).select("account_number", "vendor_name")


def all_bills(tables: AuditTables) -> DataFrame:
    return tables.bills.select(
        "bill_id", "account_id", "utility_type", "billing_date", "total_amount", "usage_volume",
        "usage_unit", "is_anomaly_detected", "anomaly_status",
    )


def monthly_trend(bills: DataFrame) -> DataFrame:
    """Bills and spend per month; undated bills are left out."""
    return (
        bills.filter("billing_date IS NOT NULL")
        .groupBy(F.expr(f"{year_month('billing_date')} AS month"))
        .agg(F.count("*").alias("bills"), _money("total_amount", "total_spend"))
        .orderBy("month")
    )


def database_counters(tables: AuditTables, findings: DataFrame) -> DataFrame:
    """One row: bills, clients, accounts and findings awaiting review."""
    counted = {
        "bills": tables.bills.select("bill_id"),
        "clients": tables.clients.select("client_id"),
        "accounts": tables.accounts.select("account_id"),
        "unreviewed": findings.filter(~F.col("reviewed")).select("analysis_id"),
    }
    counts = [df.agg(F.count("*").alias("n")).withColumn("what", F.lit(what)) for what, df in counted.items()]
    return reduce(DataFrame.unionByName, counts).agg(
        *[F.sum(F.when(F.col("what") == what, F.col("n"))).alias(what) for what in counted]
    )


# --- findings: totals ------------------------------------------------------

def _totals() -> list[Column]:
    return [F.count("*").alias("findings"), F.sum("potential_recovery").alias("recovery")]


def _scope(findings: DataFrame, unreviewed_only: bool) -> DataFrame:
    kept = findings.filter(~F.col("reviewed")) if unreviewed_only else findings
    return kept.select(
        "analysis_id", "bill_id", "detection_layer", "finding_type", "severity", "potential_recovery"
    )


def _per_account(findings: DataFrame, tables: AuditTables) -> DataFrame:
    bills = tables.bills.select("bill_id", "account_id")
    return findings.join(bills, "bill_id").groupBy("account_id").agg(
        *_totals(), F.count_if(F.col("severity") == "URGENT").alias("urgent")
    )


def _roll_up(per_account: DataFrame, *by: str) -> DataFrame:
    return per_account.groupBy(*by).agg(
        F.sum("findings").alias("findings"), _money("recovery", "recovery"),
        F.sum("urgent").alias("urgent"),
    )


def recovery_by_client(findings: DataFrame, tables: AuditTables, unreviewed_only: bool = True) -> DataFrame:
    return (
        _roll_up(
            _per_account(_scope(findings, unreviewed_only), tables).join(account_directory(tables), "account_id"),
            "client_name",
        )
        .orderBy(F.desc("recovery"), "client_name")
    )


def recovery_by_layer(findings: DataFrame, unreviewed_only: bool = True) -> DataFrame:
    return (
        _scope(findings, unreviewed_only)
        .groupBy("detection_layer")
        .agg(F.count("*").alias("findings"), _money("potential_recovery", "recovery"))
        .selectExpr("detection_layer", f"{titled('detection_layer', LAYER_TITLES)} AS method", "findings", "recovery")
        .orderBy(F.desc("recovery"), "detection_layer")
    )


def recovery_overall(findings: DataFrame, unreviewed_only: bool = True) -> DataFrame:
    return _scope(findings, unreviewed_only).agg(
        F.count("*").alias("total_findings"),
        _money("potential_recovery", "total_recovery"),
        F.count_if(F.col("severity") == "URGENT").alias("urgent"),
        F.count_if(F.col("severity") == "HIGH").alias("high"),
    )


@dataclass
class RecoverySummary:
    summary: DataFrame
    by_client: DataFrame
    by_method: DataFrame


def recovery_summary(findings: DataFrame, tables: AuditTables, unreviewed_only: bool = True) -> RecoverySummary:
    return RecoverySummary(
        recovery_overall(findings, unreviewed_only),
        recovery_by_client(findings, tables, unreviewed_only),
        recovery_by_layer(findings, unreviewed_only),
    )


def recovery_sections(findings: DataFrame, tables: AuditTables, unreviewed_only: bool = True) -> DataFrame:
    """The recovery summary as one flat frame: (section, name, findings, recovery, urgent, high)."""
    parts = recovery_summary(findings, tables, unreviewed_only)
    none = F.lit(None).cast("long")
    return reduce(
        DataFrame.unionByName,
        [
            parts.summary.select(
                F.lit("summary").alias("section"), F.lit("all").alias("name"),
                F.col("total_findings").alias("findings"), F.col("total_recovery").alias("recovery"), "urgent", "high",
            ),
            parts.by_client.select(
                F.lit("client").alias("section"), F.col("client_name").alias("name"), "findings", "recovery",
                "urgent", none.alias("high"),
            ),
            parts.by_method.select(
                F.lit("method").alias("section"), F.col("method").alias("name"), "findings", "recovery",
                none.alias("urgent"), none.alias("high"),
            ),
        ],
    )


def insights_by_type(findings: DataFrame) -> DataFrame:
    mean = mean_money("sum(potential_recovery)", "count(*)")
    return (
        findings.groupBy("finding_type")
        .agg(
            F.count("*").alias("findings"), _money("potential_recovery", "recovery"),
            F.expr(f"{mean} AS avg_recovery"),
        )
        .selectExpr("*", f"{titled('finding_type', FINDING_TITLES)} AS title")
        .orderBy(F.desc("recovery"), "finding_type")
    )


def insights_by_vendor(findings: DataFrame, tables: AuditTables) -> DataFrame:
    vendors = tables.accounts.select("account_id", "vendor_id").join(
        tables.vendors.select("vendor_id", "vendor_name"), "vendor_id"
    )
    return (
        _roll_up(_per_account(_scope(findings, False), tables).join(vendors, "account_id"), "vendor_name")
        .drop("urgent")
        .orderBy(F.desc("recovery"), "vendor_name")
    )


def insights_by_utility(findings: DataFrame, tables: AuditTables) -> DataFrame:
    return (
        _scope(findings, False)
        .join(tables.bills.select("bill_id", "utility_type"), "bill_id")
        .groupBy("utility_type")
        .agg(F.count("*").alias("findings"), _money("potential_recovery", "recovery"))
    )


def dashboard_header(findings: DataFrame) -> DataFrame:
    """One row: findings, recovery, findings per severity and unreviewed findings."""
    return findings.agg(
        F.count("*").alias("total"),
        _money("potential_recovery", "total_recovery"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in ORDER],
        F.count_if(~F.col("reviewed")).alias("unreviewed"),
    )


def clients_with_findings(findings: DataFrame, tables: AuditTables) -> DataFrame:
    """Names and industries of clients that have unreviewed findings."""
    accounts = _scope(findings, True).join(tables.bills.select("bill_id", "account_id"), "bill_id").select(
        "account_id"
    ).distinct()
    return (
        accounts.join(account_directory(tables), "account_id")
        .select("client_name", "industry")
        .distinct()
        .orderBy("client_name")
    )


# --- findings: listings ----------------------------------------------------

def _worst_first() -> list[Column]:
    return [F.expr(severity_rank("severity")), F.desc("potential_recovery"), F.col("analysis_id")]


def review_list(
    findings: DataFrame, tables: AuditTables, client_name: str = "", severity: str = "", show_reviewed: bool = False
) -> DataFrame:
    """Findings for review, worst first."""
    kept = where.where_all(findings, where.equals("severity", severity), where.unreviewed(show_reviewed))
    return (
        where.where_all(finding_star(kept, tables), where.equals("client_name", client_name))
        .select(
            "analysis_id", "severity", "detection_layer", "plain_english_reason", "potential_recovery",
            "reviewed", "utility_type", "billing_date", "total_amount", "bill_id", "property_name",
            "vendor_name", "client_name",
        )
        .orderBy(*_worst_first())
    )


def top_findings(findings: DataFrame, tables: AuditTables, limit: int = 10) -> DataFrame:
    """Unreviewed findings with the most money at stake."""
    return (
        finding_star(findings.filter(~F.col("reviewed")), tables)
        .selectExpr(
            "analysis_id", "severity", f"{titled('detection_layer', LAYER_TITLES)} AS detected_by",
            "potential_recovery", "utility_type", "billing_date", "total_amount", "client_name",
            "property_name", "vendor_name",
        )
        .orderBy(F.desc("potential_recovery"), "analysis_id")
        .limit(limit)
    )


def _listed(findings: DataFrame, tables: AuditTables, client_name: str = "") -> DataFrame:
    kept = finding_star(findings.filter(~F.col("reviewed")), tables)
    return where.where_all(kept, where.contains("client_name", client_name)).select(
        "client_name", "analysis_id", "severity", "detection_layer", "finding_type",
        "plain_english_reason", "potential_recovery", "utility_type", "billing_date", "total_amount",
        "property_name", "vendor_name",
    )


def dashboard(findings: DataFrame, tables: AuditTables, client_name: str = "") -> DataFrame:
    """Unreviewed findings in client order, worst first (a distributed sort)."""
    return _listed(findings, tables, client_name).orderBy("client_name", *_worst_first())


def dashboard_pages(
    findings: DataFrame, tables: AuditTables, client_name: str = "", page_size: int = 200
) -> DataFrame:
    """Nested dashboard: per client the totals and the ordered findings, in pages.

    (client_name, page, total_findings, potential_recovery, findings). Pages bound
    the size of a nested row; together they hold every finding.
    """
    rows = numbered(
        _listed(findings, tables, client_name).withColumn("severity_rank", F.expr(severity_rank("severity"))),
        [F.col("severity_rank"), F.desc("potential_recovery"), F.col("analysis_id")],
        within=["client_name"],
    )
    item = F.struct(
        "position", "analysis_id", "severity", "detection_layer", "plain_english_reason",
        "potential_recovery", "utility_type", "billing_date", "total_amount", "property_name", "vendor_name",
    )
    pages = rows.groupBy(
        "client_name", F.floor((F.col("position") - 1) / page_size).cast("long").alias("page")
    ).agg(F.array_sort(F.array_agg(item)).alias("findings"))
    totals = recovery_by_client(findings, tables).select(
        "client_name", F.col("findings").alias("total_findings"), F.col("recovery").alias("potential_recovery")
    )
    return (
        pages.join(totals, "client_name")
        .select("client_name", "page", "total_findings", "potential_recovery", "findings")
        .orderBy(F.desc("potential_recovery"), "client_name", "page")
    )


def group_order(findings: DataFrame, tables: AuditTables) -> DataFrame:
    """``client_name, first_position, client_rank``: clients in the order in which the listing first names them.

    Positions come from ``numbered``, so the listing is never gathered in one task.
    """
    listed = staged(_listed(findings, tables), "listing")
    first = numbered(listed, _worst_first()).groupBy("client_name").agg(F.min("position").alias("first_position"))
    return numbered(first, [F.col("first_position")], name="client_rank")


def distinct_counts(tables: AuditTables) -> DataFrame:
    """One row: bills with a price, and how many accounts and clients they belong to."""
    per_account = where.positive_total(tables.bills).groupBy("account_id").agg(F.count(F.lit(1)).alias("bills"))
    owned = per_account.join(account_directory(tables).select("account_id", "client_id"), "account_id")
    return owned.groupBy("client_id").agg(F.sum("bills").alias("bills"), F.count(F.lit(1)).alias("accounts")).agg(
        F.coalesce(F.sum("bills"), F.lit(0).cast("long")).alias("bills"),
        F.coalesce(F.sum("accounts"), F.lit(0).cast("long")).alias("accounts"), F.count(F.lit(1)).alias("clients"),
    )


def group_breaks(findings: DataFrame, tables: AuditTables) -> DataFrame:
    """The dashboard with ``is_group_start`` on the first finding of each client and severity.

    The first finding per group is a map-side minimum, joined back by the unique
    finding id, so no group is ever gathered in one task.
    """
    listed = _listed(findings, tables)
    order = F.struct((-F.col("potential_recovery")).alias("r"), F.col("analysis_id"))
    first = (
        listed.groupBy("client_name", "severity")
        .agg(F.min(order).alias("first"))
        .select(F.col("first.analysis_id").alias("analysis_id"), F.lit(True).alias("is_group_start"))
    )
    return (
        listed.join(first, "analysis_id", "left")
        .withColumn("is_group_start", F.coalesce("is_group_start", F.lit(False)))
        .orderBy("client_name", *_worst_first())
    )


def auditor_report(findings: DataFrame, tables: AuditTables) -> DataFrame:
    """Unreviewed findings and recovery per client, with the grand total as last row."""
    last = F.lit(False).alias("is_total")
    clients = recovery_by_client(findings, tables).select("client_name", "findings", "recovery", last)
    total = clients.agg(
        F.lit("TOTAL").alias("client_name"),
        F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"), _money("recovery", "recovery"),
        F.lit(True).alias("is_total"),
    )
    order = ["is_total", F.desc("recovery"), "client_name"]
    return clients.unionByName(total).orderBy(*order).drop("is_total")


