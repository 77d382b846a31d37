import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tariffscope.operators import upsert
from tariffscope.operators.constraints import violations
from tariffscope.operators.encode import encode_labels, label_codes
from tariffscope.operators.ordering import numbered
from tariffscope.plans import reports as rp
from tariffscope.plans.review import apply_decisions
from tariffscope.plans.tools import AuditTools
from tariffscope.schemas import DECISIONS
from tariffscope.sources import sinks, store
from tariffscope.sources.tables import read_only_sql, read_tables
from tariffscope.sources.weather import daily_rows
from tests.test_features import bill


def test_positions_are_exact_when_one_group_dominates(spark):
    rng = random.Random(3)
    rows = [("hot" if n % 3 else f"g{n % 5}", rng.randint(0, 40), n) for n in range(3000)]
    frame = spark.createDataFrame(rows, "g string, v int, id long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbered(frame, [F.desc("v"), F.col("id")], within=["g"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    expected = {}
    for group in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == group), key=lambda r: (-r[1], r[2]))
        expected |= {r[2]: place for place, r in enumerate(ordered, 1)}
    assert {r["id"]: r["position"] for r in got} == expected


def test_labels_follow_sorted_order_with_null_last(spark):
    frame = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "x string")
    codes = {r["value"]: r["code"] for r in label_codes(frame, ["x"]).collect()}
    assert codes == {"a": 0.0, "b": 1.0, "c": 2.0, None: 3.0}
    assert sorted(r["k"] for r in encode_labels(frame, {"x": "k"}).collect()) == [0.0, 0.0, 1.0, 2.0, 3.0]


def test_first_writer_wins(spark):
    new = spark.createDataFrame([("k", 2, "late"), ("k", 1, "early"), ("known", 0, "x")], "key string, n int, who string")
    have = spark.createDataFrame([("known",)], "key string")
    rows = upsert.absent_rows(new, have, "key", "n").collect()
    assert [(r["key"], r["who"]) for r in rows] == [("k", "early")]


def test_violations_name_each_broken_rule(small_tables, make):
    tables = small_tables(
        [bill(1, 100, None, "5.00"), bill(1, 999, None, "5.00", utility_type="Steam")],
        [{"item_id": 1, "bill_id": 77, "category": "Gift", "total_price": None}],
    )
    tables.vendors = tables.vendors.unionByName(make("vendors", [{"vendor_id": 2, "vendor_name": None, "vendor_type": "Wind"}]))
    got = {(r["table_name"], r["rule"], r["column_name"], r["value"], r["violations"]) for r in violations(tables.present()).collect()}
    assert got == {
        ("bills", "UNIQUE", "bill_id", "1", 2), ("bills", "ALLOWED VALUES", "utility_type", "Steam", 1),
        ("bills", "FOREIGN KEY", "account_id", "999", 1), ("line_items", "ALLOWED VALUES", "category", "Gift", 1),
        ("line_items", "FOREIGN KEY", "bill_id", "77", 1), ("line_items", "NOT NULL", "total_price", None, 1),
        ("vendors", "NOT NULL", "vendor_name", None, 1), ("vendors", "ALLOWED VALUES", "vendor_type", "Wind", 1),
    }


def findings(make, *rows):
    base = {"finding_type": "USAGE_SPIKE", "detection_layer": "ML", "reviewed": False, "plain_english_reason": "High."}
    from decimal import Decimal

    return make("findings", [
        {**base, "analysis_id": i, "bill_id": i, "severity": s, "potential_recovery": Decimal(m), **more}
        for i, s, m, more in rows
    ])


@pytest.fixture
def reviewed_setup(small_tables, make):
    tables = small_tables([bill(n, 100 if n < 4 else 200, dt.date(2020, 1, n), "50.00") for n in range(1, 6)])
    found = findings(
        make, (1, "HIGH", "1500.00", {}), (2, "LOW", "10.00", {}), (3, "HIGH", "1200.00", {}),
        (4, "URGENT", "6000.00", {}), (5, "LOW", "1.00", {"reviewed": True}),
    )
    return tables, found


def test_decisions_apply_once(spark, reviewed_setup):
    tables, found = reviewed_setup
    rows = [(1, 1, "confirm", "seen"), (2, 1, "dismiss", None), (3, 2, "dismiss", None), (4, 5, "confirm", None),
            (5, 404, "confirm", None), (6, 3, "shred", None)]
    decisions = spark.createDataFrame(rows, DECISIONS)
    out = apply_decisions(found, tables.bills, decisions, "2024-05-01")
    assert {r["analysis_id"] for r in out.findings.filter("reviewed").collect()} == {1, 2, 5}
    assert {r["bill_id"]: r["anomaly_status"] for r in out.bills.collect()} == {
        1: "Confirmed", 2: "Dismissed", 3: "Unreviewed", 4: "Unreviewed", 5: "Unreviewed"
    }
    claim = out.new_claims.collect()
    assert len(claim) == 1 and claim[0]["claim_reason"] == "High. Reviewer: seen" and claim[0]["status"] == "Open"
    assert {r["analysis_id"]: r["error"] for r in out.errors.collect()} == {
        404: "no such finding", 3: "unknown action: shred"
    }
    again = apply_decisions(out.findings, out.bills, decisions, "2024-05-02")
    assert again.new_claims.count() == 0 and again.bills.exceptAll(out.bills).count() == 0


def test_reports_add_up(reviewed_setup):
    tables, found = reviewed_setup
    by_client = {r["client_name"]: (r["findings"], float(r["recovery"])) for r in rp.recovery_by_client(found, tables).collect()}
    assert by_client == {"Alma Clinic": (3, 2710.0), "Bolt Works": (1, 6000.0)}
    total = rp.recovery_overall(found).first()
    assert total["total_findings"] == 4 and float(total["total_recovery"]) == 8710.0
    assert rp.recovery_overall(found.limit(0)).first()["total_recovery"] == 0
    directory = {r["client_name"]: (r["properties"], r["accounts"]) for r in rp.client_directory(tables).collect()}
    assert directory == {"Alma Clinic": (1, 1), "Bolt Works": (1, 1), "Empty Co": (0, 0)}


def test_dashboard_pages_hold_every_finding_in_order(reviewed_setup):
    tables, found = reviewed_setup
    pages = rp.dashboard_pages(found, tables, page_size=2).collect()
    shown = [(p["client_name"], p["page"], [f["analysis_id"] for f in p["findings"]]) for p in pages]
    assert shown == [("Bolt Works", 0, [4]), ("Alma Clinic", 0, [1, 3]), ("Alma Clinic", 1, [2])]
    starts = [(r["analysis_id"], r["is_group_start"]) for r in rp.group_breaks(found, tables).collect()]
    assert starts == [(1, True), (3, False), (2, True), (4, True)]


def test_tool_surface(spark, reviewed_setup):
    tools = AuditTools(spark, *reviewed_setup)
    assert tools.all_clients().count() == 3
    assert tools.client_summary("alma").count() == 1
    assert tools.anomalies().count() == 0 and tools.bills(limit=2).count() == 2
    assert [r["bill_id"] for r in tools.bills(start_date="2020-01-02", end_date="2020-01-03").collect()] == [3, 2]
    row = tools.compare_periods("00000100", ("2020-01-01", "2020-01-01"), ("2020-01-02", "2020-01-03")).first()
    assert (row["p1_bills"], row["p2_bills"], row["spend_change_pct"], row["spend_trend"]) == (1, 2, 100.0, "UP")
    assert tools.top_spenders("Electric", 2020).first()["account_number"] == "00000100"
    assert tools.sql("select count(*) AS n from bills").first()["n"] == 5
    assert tools.dashboard("bolt").count() == 1
    assert tools.recovery_summary().by_method.count() == 1
    assert tools.confirm(1, "ok").new_claims.count() == 1
    assert tools.dismiss(9).errors.count() == 1
    assert [f.count() for f in tools.insights()] == [1, 1, 1]


@pytest.mark.parametrize("text", ["DELETE FROM bills", "WITH x AS (SELECT 1) SELECT 1", "SELECT 1; DROP", "SELECT nope FROM nowhere"])
def test_sql_guard_answers_with_an_error(spark, text):
    assert read_only_sql(spark, text).columns == ["error"]


def test_weather_response_days(spark):
    from tariffscope.schemas import WEATHER_RESPONSE

    rows = [(1.0, 2.0, (["2020-01-01", "2020-01-02"], [50.0, None], [30.0, 20.0])), (1.0, 2.0, ([], [], []))]
    assert [str(r["obs_date"]) for r in daily_rows(spark.createDataFrame(rows, WEATHER_RESPONSE)).collect()] == ["2020-01-01"]


def test_snapshot_can_replace_itself(spark, tmp_path):
    folder = str(tmp_path / "t")
    sinks.write_snapshot(spark.range(3).toDF("n"), folder)
    sinks.write_snapshot(sinks.read_snapshot(spark, folder).selectExpr("n + 1 AS n"), folder)
    assert sorted(r["n"] for r in sinks.read_snapshot(spark, folder).collect()) == [1, 2, 3]


def test_review_batch_is_stored(spark, reviewed_setup, tmp_path):
    tables, found = reviewed_setup
    folder = str(tmp_path)
    decisions = spark.createDataFrame([(1, 1, "confirm", None), (2, 2, "dismiss", None)], DECISIONS)
    store.prepare_store(spark, folder)
    store.write_batch(tables.bills, folder, "bills", 0)
    store.write_batch(found, folder, "findings", 0)
    for _ in range(2):  # a repeated batch leaves one claim
        store.write_review(apply_decisions(found, tables.bills, decisions, "2024-05-01"), folder, 0)
    stored = read_tables(spark, folder)
    assert stored.findings.filter("reviewed").count() == 3
    assert stored.bills.filter("anomaly_status = 'Dismissed'").count() == 1
    assert [r["bill_id"] for r in stored.audit_claims.collect()] == [1]


def test_bills_are_stored_by_year(spark, small_tables, tmp_path):
    tables = small_tables([bill(1, 100, dt.date(2020, 1, 1), "5.00"), bill(2, 100, None, "5.00")])
    store.prepare_store(spark, str(tmp_path))
    for _ in range(2):
        store.write_batch(tables.bills, str(tmp_path), "bills", 7)
    stored = store.read_batches(spark, str(tmp_path), "bills")
    assert stored.count() == 2 and stored.filter("billing_year = 2020").count() == 1
    plan = stored.filter("billing_year = 2020")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(billing_year" in plan
