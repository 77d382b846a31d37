import datetime as dt
import random
import statistics
from decimal import Decimal

import pytest

from tariffscope.plans import features as fe
from tariffscope.plans import findings as fd
from tariffscope.plans import weather as wx
from tariffscope.plans.audit_rules import failed_text
from tariffscope.schemas import WEATHER_DAILY


def bill(bill_id, account_id, day, total, usage=10.0, **more):
    row = {
        "bill_id": bill_id, "account_id": account_id, "utility_type": "Electric", "billing_date": day,
        "total_amount": Decimal(str(total)), "usage_volume": usage, "usage_unit": "kWh", "demand_read": 0.0,
        "is_anomaly_detected": False, "anomaly_reason": "", "anomaly_status": "Unreviewed",
        "audit_timestamp": dt.datetime(2024, 1, 1),
    }
    return {**row, **more}


def item(bill_id, category, price, item_id=0):
    return {"item_id": item_id, "bill_id": bill_id, "category": category, "total_price": Decimal(str(price))}


def test_features_match_brute_force(small_tables):
    rng = random.Random(7)
    bills, items = [], []
    for n in range(60):
        account = rng.choice([100, 100, 200, 300])
        day = None if n % 13 == 0 else dt.date(2020 + n % 3, 1 + n % 4, 5)
        usage = 0.0 if n % 7 == 0 else float(rng.randint(1, 50))
        bills.append(bill(n, account, day, f"{rng.randint(1000, 90000) / 100:.2f}", usage))
        items.append(item(n, "Delivery Charge", f"{rng.randint(100, 900) / 100:.2f}"))
        items.append(item(n, "Supply Charge", "1.00"))
        items.append(item(n, "Supply Charge", "2.50"))
    bills.append(bill(99, 100, dt.date(2020, 1, 1), "0.00"))
    got = {r["bill_id"]: r for r in fe.engineer(small_tables(bills, items)).collect()}

    kept = [b for b in bills if b["total_amount"] > 0 and b["account_id"] != 300]
    assert set(got) == {b["bill_id"] for b in kept}
    delivery = {i["bill_id"]: float(i["total_price"]) for i in items if i["category"] == "Delivery Charge"}
    for b in kept:
        r, total = got[b["bill_id"]], float(b["total_amount"])
        same = [x for x in kept if x["account_id"] == b["account_id"]]
        totals = [float(x["total_amount"]) for x in same]
        assert r["account_bill_count"] == len(same)
        assert r["zscore_overall"] == pytest.approx((total - statistics.mean(totals)) / statistics.stdev(totals))
        rates = [delivery[x["bill_id"]] / x["usage_volume"] for x in same if x["usage_volume"] > 0]
        rate = delivery[b["bill_id"]] / b["usage_volume"] if b["usage_volume"] > 0 else 0.0
        assert r["delivery_rate_ratio"] == pytest.approx(rate / statistics.mean(rates))
        assert r["supply_pct"] == pytest.approx(350.0 / total)
        if b["billing_date"] is None:
            assert r["monthly_mean"] is None and r["zscore_monthly"] is None and r["pct_above_monthly"] == 0
            continue
        month = [
            float(x["total_amount"]) for x in same
            if x["billing_date"] and x["billing_date"].month == b["billing_date"].month
        ]
        spread = statistics.stdev(month) if len(month) > 1 else 1.0
        assert r["monthly_mean"] == pytest.approx(statistics.mean(month))
        assert r["zscore_monthly"] == pytest.approx((total - statistics.mean(month)) / (spread or 1.0))


def test_equal_bills_have_unit_spread(small_tables):
    bills = [bill(n, 100, dt.date(2020, 1 + n % 12, 1), "100.10") for n in range(36)]
    for r in fe.engineer(small_tables(bills)).collect():
        assert r["overall_std"] == 1.0 and r["monthly_std"] == 1.0
        assert abs(r["zscore_overall"]) < 1e-9


def test_unassigned_accounts_can_be_included(small_tables):
    tables = small_tables([bill(1, 300, dt.date(2020, 1, 1), "5.00")])
    assert fe.engineer(tables).count() == 0
    assert fe.engineer(tables, include_unassigned=True).first()["client_name"] is None


def test_lazy_and_staged_features_agree(small_tables):
    tables = small_tables([bill(n, 100, dt.date(2020, 1 + n % 12, 1), f"{n + 1}.25") for n in range(30)])
    staged, lazy = fe.engineer(tables, stage_bills=True), fe.engineer(tables)
    assert sorted(staged.collect()) == sorted(lazy.select(*staged.columns).collect())


@pytest.mark.parametrize(
    "amount, level", [(5000, "URGENT"), (4999.99, "HIGH"), (1000, "HIGH"), (200, "MEDIUM"), (199.99, "LOW"), (0, "LOW")]
)
def test_severity_steps(spark, amount, level):
    from tariffscope.functions.severity import severity

    assert spark.range(1).selectExpr(f"{severity(f'{amount}BD')} AS s").first()["s"] == level


def daily(spark, rows):
    return spark.createDataFrame([(d, 42.89, -78.86, hi, lo) for d, hi, lo in rows], WEATHER_DAILY)


def test_degree_days_skip_incomplete_days(spark):
    frame = daily(spark, [
        (dt.date(2020, 1, 1), 40.0, 20.0), (dt.date(2020, 1, 2), 80.0, 70.0), (dt.date(2020, 1, 3), 90.0, None),
    ])
    row = wx.degree_days(frame).first()
    assert (float(row["hdd"]), float(row["cdd"]), row["days"], float(row["avg_temp"])) == (35.0, 10.0, 2, 52.5)


def finding_set(spark, small_tables, bills, days, flag="true"):
    tables = small_tables(bills)
    scored = fe.engineer(tables).selectExpr("*", f"{flag} AS ml_flagged", "0.8D AS ml_anomaly_probability")
    weather = wx.weather_table(tables.bills, daily(spark, days))
    return {r["bill_id"]: r for r in fd.findings(scored, weather, run_time="2024-01-01 00:00:00").collect()}


def year_of_bills(total="100.00"):
    return [bill(n, 100, dt.date(2019, 1 + n, 15), total) for n in range(12)]


def test_math_finding_wins_and_needs_an_amount(spark, small_tables):
    reason = spark.range(1).selectExpr(f"{failed_text('10.00BD', '1310.00BD')} AS t").first()["t"]
    bills = year_of_bills() + [
        bill(50, 100, dt.date(2020, 1, 15), "100.00", is_anomaly_detected=True, anomaly_reason=reason),
        bill(51, 100, dt.date(2020, 2, 15), "100.00", is_anomaly_detected=True,
             anomaly_reason="MATH AUDIT FAILED. Demand is odd."),
        bill(52, 100, dt.date(2020, 3, 15), "100.00", is_anomaly_detected=False, anomaly_reason=reason),
        bill(53, 100, None, "100.00", is_anomaly_detected=True, anomaly_reason=reason),
    ]
    found = finding_set(spark, small_tables, bills, [], flag="false")
    assert set(found) == {50, 53}
    undated = found[53]
    assert undated["expected_value"] is None and undated["deviation_pct"] is None and undated["weather_actual"] is None
    assert found[50]["detection_layer"] == "MATH" and found[50]["finding_type"] == "MATH_ERROR"
    assert found[50]["potential_recovery"] == Decimal("1300.00") and found[50]["severity"] == "HIGH"
    assert found[50]["anomaly_probability"] == 1.0


def test_history_gate_holds_for_flagged_bills(spark, small_tables):
    assert finding_set(spark, small_tables, year_of_bills()[:11], []) == {}
    assert len(finding_set(spark, small_tables, year_of_bills(), [])) == 12


def test_weather_changes_type_and_layer(spark, small_tables):
    # July 2020 is hotter than July 2019; the account is a clinic (electric weight 0.3).
    days = [(dt.date(2019, 7, 1), 80.0, 70.0), (dt.date(2020, 7, 1), 120.0, 100.0), (dt.date(2019, 1, 1), 30.0, 10.0),
            (dt.date(2020, 1, 1), 30.0, 10.0)]
    bills = year_of_bills() + [
        bill(60, 100, dt.date(2020, 7, 15), "110.00"), bill(61, 100, dt.date(2020, 1, 15), "900.00"),
    ]
    found = finding_set(spark, small_tables, bills, days)
    assert found[60]["finding_type"] == "WEATHER_DRIVEN" and found[60]["detection_layer"] == "ML"
    assert found[61]["finding_type"] == "USAGE_SPIKE" and found[61]["detection_layer"] == "COMBINED"
    assert found[61]["potential_recovery"] == Decimal("400.00")
    assert found[6]["finding_type"] == "WEATHER_UNEXPLAINED_DROP" or found[6]["finding_type"] == "USAGE_DROP"
    assert found[2]["finding_type"] == "USAGE_DROP"  # no weather in March, no change
    assert "2020" not in found[61]["plain_english_reason"] and "$900" in found[61]["plain_english_reason"]


def test_reviewed_marks_can_be_carried(spark, small_tables):
    tables = small_tables(year_of_bills())
    scored = fe.engineer(tables).selectExpr("*", "true AS ml_flagged", "0.8D AS ml_anomaly_probability")
    fresh = fd.findings(scored, wx.weather_table(tables.bills, daily(spark, [])), run_time="2024-01-01 00:00:00")
    old = fresh.selectExpr(*[c if c != "reviewed" else "bill_id = 3 AS reviewed" for c in fresh.columns])
    marks = {r["bill_id"]: r["reviewed"] for r in fd.carry_reviewed(fresh, old).collect()}
    assert marks[3] is True and marks[4] is False and len(marks) == 12
