"""Joins around the bill star.

The dimension chain is resolved once per account and then joined to the facts
on account_id. No side is forced to broadcast: dimension tables grow with the
data, so Catalyst and adaptive execution decide from their measured sizes, and
a hot account is split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tariffscope.sources.tables import AuditTables


def account_directory(tables: AuditTables, include_unassigned: bool = False) -> DataFrame:
    """One row per account with vendor, property and client.

    Accounts without a property drop out, unless ``include_unassigned``.
    """
    how = "left" if include_unassigned else "inner"
    accounts = tables.accounts.select(
        "account_id", "property_id", "vendor_id", "account_number"
    )
    vendors = tables.vendors.select("vendor_id", "vendor_name")
    sites = tables.properties.select(
        "property_id", "client_id", "property_name", "address", "city", "state"
    ).join(tables.clients.select("client_id", "client_name", "industry"), "client_id")
    return accounts.join(vendors, "vendor_id").join(sites, "property_id", how)


def bill_star(
    tables: AuditTables, bills: DataFrame | None = None, include_unassigned: bool = False
) -> DataFrame:
    """Bills with their account, vendor, property and client."""
    facts = tables.bills if bills is None else bills
    return facts.join(account_directory(tables, include_unassigned), "account_id")


_BILL_FACTS = ("bill_id", "account_id", "utility_type", "billing_date", "total_amount")


def finding_bills(findings: DataFrame, tables: AuditTables) -> DataFrame:
    """Findings with the facts of their bill; the join key is unique on both sides."""
    return findings.join(tables.bills.select(*_BILL_FACTS), "bill_id")


def finding_star(findings: DataFrame, tables: AuditTables) -> DataFrame:
    """Findings with bill, account, vendor, property and client."""
    return finding_bills(findings, tables).join(account_directory(tables), "account_id")


def unassigned_accounts(tables: AuditTables) -> DataFrame:
    """Accounts whose bills stay out of the star because they have no property."""
    return tables.accounts.filter("property_id IS NULL")
