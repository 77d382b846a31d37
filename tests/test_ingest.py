import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tariffscope.plans import ingest as ig
from tariffscope.sources import documents

GOOD = {
    "provider_name": "Volt", "account_number": "1234-5678", "utility_type": "Gas", "statement_date": "2024-02-01",
    "total_amount_due": 100.0, "usage_unit": "kWh", "delivery_charge": 60.0, "supply_charge": 50.0,
    "credits": -10.0, "is_anomaly_detected": True,
}


def run(spark, *payloads):
    rows = [(str(n), f"/in/{n}.pdf", p if isinstance(p, str) else json.dumps(p)) for n, p in enumerate(payloads)]
    answers = spark.createDataFrame(rows, "record_id string, source_file string, payload string")
    return ig.process(answers)


def test_good_record_is_normalised_and_audited(spark):
    row = run(spark, "```json\n" + json.dumps(GOOD) + "\n```").first()
    assert row["status"] == "accepted" and row["reject_reasons"] == []
    assert row["account_number"] == "12345678" and row["utility_type"] == "Electric" and row["credits"] == 10.0
    assert row["is_anomaly_detected"] is False and row["discrepancy"] == 0
    assert row["source_file"] == "0.pdf"


@pytest.mark.parametrize("due, failed", [(100.02, False), (100.03, True), (99.98, False), (99.97, True)])
def test_tolerance_is_strict(spark, due, failed):
    row = run(spark, {**GOOD, "total_amount_due": due}).first()
    assert row["is_anomaly_detected"] is failed
    assert ("Discrepancy of $0.03" in row["anomaly_reason"]) is failed


@pytest.mark.parametrize(
    "payload, reasons",
    [
        ("{broken", ["malformed"]),
        ({"error": "no model"}, ["extractor_error"]),
        ({**GOOD, "provider_name": "UNKNOWN"}, ["no provider"]),
        ({**GOOD, "provider_name": None}, ["no provider"]),
        ({**GOOD, "account_number": "12 34"}, ["bad account number"]),
        ({**GOOD, "account_number": "12345A"}, ["bad account number"]),
        ({**GOOD, "total_amount_due": 0}, ["no positive total"]),
        ({"provider_name": "", "total_amount_due": -1}, ["no provider", "bad account number", "no positive total"]),
    ],
)
def test_rejects(spark, payload, reasons):
    row = run(spark, payload).first()
    assert row["status"] == "rejected" and row["reject_reasons"] == reasons


def test_codes_and_conformance(spark):
    row = run(spark, {**GOOD, "usage_unit": "CCF", "utility_type": "Water"}).first()
    assert row["usage_unit"] == "Therms" and row["utility_type"] == "Gas"
    assert row["conformance_issues"] == ["unlisted utility_type", "unlisted usage_unit"]
    row = run(spark, {**GOOD, "usage_unit": "m3", "utility_type": "Water"}).first()
    assert row["usage_unit"] == "Unknown" and row["utility_type"] == "Unknown"


def test_form_names_are_accepted(spark):
    form = {k: v for k, v in GOOD.items() if k != "statement_date"}
    form |= {"billing_date": "2024-03-01", "taxes_surcharges": 5.0, "due_date": "2024-03-20"}
    row = run(spark, form).first()
    assert row["statement_date"] == "2024-03-01" and row["taxes_and_surcharges"] == 5.0 and row["due_date"]


def test_form_audit_leaves_out_the_fixed_charge(spark):
    rows = ig.form_audit(run(
        spark, {**GOOD, "fixed_monthly_charge": 7.0}, {**GOOD, "delivery_charge": 0, "supply_charge": 0},
        {**GOOD, "total_amount_due": 90, "provider_name": "", "statement_date": ""},
    )).orderBy("record_id").collect()
    assert [r["form_verdict"] for r in rows] == ["agrees", "not checkable", "mismatch"]
    assert rows[2]["missing_fields"] == ["provider_name", "billing_date"]


def test_intake_splits_whole_batch_and_keeps_known_ids(spark, make):
    batch = run(
        spark, GOOD, {**GOOD, "account_number": "99999999", "provider_name": "Heat"},
        {**GOOD, "account_number": "99999999", "provider_name": "Volt"}, "{broken",
        {**GOOD, "provider_name": "Rejected Co", "total_amount_due": 0},
    )
    vendors = make("vendors", [{"vendor_id": 1, "vendor_name": "Volt"}])
    accounts = make("accounts", [{"account_id": 7, "vendor_id": 1, "account_number": "12345678"}])
    parts = ig.intake(batch, vendors, accounts, "2024-01-01 00:00:00")
    bills = parts.bills.orderBy("source_file").collect()
    assert len(bills) == 3 and parts.quarantine.count() == 2
    assert bills[0]["account_id"] == 7 and bills[1]["account_id"] == bills[2]["account_id"] != 7
    assert [r["vendor_name"] for r in parts.new_vendors.collect()] == ["Heat"]  # not from rejected rows
    new = parts.new_accounts.collect()
    assert len(new) == 1 and new[0]["vendor_id"] == parts.new_vendors.first()["vendor_id"]  # first writer wins
    assert bills == ig.intake(batch, vendors, accounts, "2024-01-01 00:00:00").bills.orderBy("source_file").collect()
    items = parts.line_items.filter(F.col("bill_id") == bills[0]["bill_id"]).collect()
    assert {(i["category"], i["total_price"]) for i in items} == {
        ("Delivery Charge", Decimal("60.00")), ("Supply Charge", Decimal("50.00")), ("Credit", Decimal("-10.00")),
    }


def test_documents_are_assembled_in_parts(spark):
    pages = [(1, n, f"page {n} $1.00" if n != 2 else "notes") for n in range(5)] + [(2, 0, "notes")]
    frame = spark.createDataFrame(pages, "doc_id long, page_no int, text string").repartition(3)
    rows = ig.assemble_documents(frame, pages_per_part=3).orderBy("doc_id", "part").collect()
    assert [(r["doc_id"], r["part"], r["pages"], r["included"]) for r in rows] == [(1, 0, 3, 2), (1, 1, 2, 2), (2, 0, 1, 0)]
    assert rows[0]["text"] == "--- PAGE 1 ---\npage 0 $1.00\n--- PAGE 2 ---\npage 1 $1.00\n"
    assert rows[2]["text"] == ""


def test_pattern_and_custom_extractors(spark):
    text = "Provider: Volt\nAccount Number: 1234-5678\nDelivery Services $60.00\nTotal Amount Due $1,060.00\nUsed 5 kWh"
    docs = spark.createDataFrame([("1", "a", text)], "record_id string, source_file string, text string")
    row = ig.process(ig.extract(docs)).first()
    assert (row["provider_name"], row["account_number"], row["total_amount_due"], row["delivery_charge"]) == (
        "Volt", "12345678", 1060.0, 60.0
    )

    def answer(batches):
        for batch in batches:
            batch["payload"] = batch["prompt"].map(lambda p: json.dumps({**GOOD, "rate_code": str("1,060.00" in p)}))
            yield batch[["record_id", "source_file", "payload"]]

    row = ig.process(ig.extract(docs, answer)).first()
    assert row["status"] == "accepted" and row["rate_code"] == "True"


def test_documents_are_read_whole(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text("three")
    rows = {r["source_file"]: r["text"] for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert rows == {"a.txt": "one\ntwo", "b.txt": "three"}
    assert documents.discover(spark, str(tmp_path), "*.txt").count() == 2


def test_extractor_gets_the_whole_raw_text(spark):
    raw = "".join(f"line {k}: 1.00\n" for k in range(100)) + "  |  late note \u00a7\n-\n"
    docs = spark.createDataFrame([(1, "a.pdf", raw)], "record_id long, source_file string, text string")

    def answer(batches):
        for batch in batches:
            yield batch.assign(payload=batch["text"])[["record_id", "source_file", "payload"]]

    assert ig.extract(docs, answer).first()["payload"] == raw


def test_an_error_key_is_found_however_it_is_spelled(spark):
    payloads = ['{"error": 1}', '{"\\u0065rror": null}', '{"provider_name": "error"}', '{"note": {"error": 1}}', '{"provider_name": "V\\n"}', None, "error"]
    rows = spark.createDataFrame([(str(k), "f", p) for k, p in enumerate(payloads)], "record_id string, source_file string, payload string")
    found = {int(r["record_id"]): r["read_status"] for r in ig.parse_records(rows).collect()}
    assert [found[k] for k in range(7)] == ["extractor_error", "extractor_error", "read", "read", "read", "malformed", "malformed"]
