"""The callable surface: one function per tool, each returning DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tariffscope.plans import reports
from tariffscope.plans.review import Reviewed, apply_decisions
from tariffscope.schemas import DECISIONS
from tariffscope.sources.tables import AuditTables, read_only_sql


@dataclass
class AuditTools:
    """Questions an auditor asks, bound to one set of tables and findings."""

    spark: SparkSession
    tables: AuditTables
    findings: DataFrame

    def all_clients(self) -> DataFrame:
        return reports.client_directory(self.tables)

    def client_summary(self, client_name: str) -> DataFrame:
        return reports.client_summary(self.tables, client_name)

    def anomalies(self, client_name="", status="", utility_type="", limit=20) -> DataFrame:
        return reports.flagged_bills(self.tables, client_name, status, utility_type, limit)

    def bills(self, account_number="", client_name="", utility_type="", start_date="", end_date="", limit=24) -> DataFrame:
        return reports.bill_search(
            self.tables, account_number, client_name, utility_type, start_date, end_date, limit
        )

    def compare_periods(self, account_number, first: tuple[str, str], second: tuple[str, str]) -> DataFrame:
        return reports.compare_periods(self.tables, first, second, account_number)

    def top_spenders(self, utility_type="", year=0, limit=10) -> DataFrame:
        return reports.top_spenders(self.tables, utility_type, year, limit)

    def sql(self, query: str) -> DataFrame:
        return read_only_sql(self.spark, query, self.tables)

    def dashboard(self, client_name="") -> DataFrame:
        return reports.dashboard_pages(self.findings, self.tables, client_name)

    def recovery_summary(self) -> reports.RecoverySummary:
        return reports.recovery_summary(self.findings, self.tables)

    def confirm(self, analysis_id: int, notes: str = "") -> Reviewed:
        return self._decide(analysis_id, "confirm", notes)

    def dismiss(self, analysis_id: int, reason: str = "") -> Reviewed:
        return self._decide(analysis_id, "dismiss", reason)

    def insights(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return (
            reports.insights_by_type(self.findings),
            reports.insights_by_vendor(self.findings, self.tables),
            reports.insights_by_utility(self.findings, self.tables),
        )

    def _decide(self, analysis_id: int, action: str, note: str) -> Reviewed:
        decision = self.spark.createDataFrame([(1, analysis_id, action, note)], DECISIONS)
        return apply_decisions(self.findings, self.tables.bills, decision)
