"""Documents to stored bills, nearest grid points, the guard of ad-hoc SQL, and pruning of stored bills."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tariffscope.operators.nearest import nearest
from tariffscope.plans import batch as bt
from tariffscope.plans import reports as rp
from tariffscope.plans.weather import unmatched_locations, weather_table
from tariffscope.session import importable
from tariffscope.sources import demo
from tariffscope.sources.store import prepare_store, read_batches, read_table, write_batch
from tariffscope.sources.tables import read_only_sql, read_tables
from tests.test_plans import plan_of

PAGES = "doc_id string, page_no int, source_file string, text string, ocr_text string"
LONG = "a digital page with more than a hundred characters " * 3


def test_digital_documents_keep_all_pages_and_scans_their_billing_pages(spark):
    rows = [
        ("d", 1, "/x/d.pdf", "second", "ignored $1.00"), ("d", 0, "/x/d.pdf", LONG, None),
        ("s", 2, "s.pdf", None, "Total $12.34"), ("s", 10, "s.pdf", None, "later $5.00"), ("s", 1, "s.pdf", " ", "no amount here"),
        ("e", 0, None, None, None),
    ]
    found = {r["doc_id"]: r.asDict() for r in bt.document_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert found["d"]["route"] == "digital" and found["d"]["text"] == f"{LONG}\nsecond\n" and found["d"]["included"] == 2
    assert found["s"]["text"] == "--- PAGE 3 ---\nTotal $12.34\n--- PAGE 11 ---\nlater $5.00\n" and found["s"]["pages"] == 3
    assert found["e"] == {"doc_id": "e", "source_file": None, "route": "scan", "pages": 1, "included": 0, "text": ""}
    assert bt.document_texts(spark.createDataFrame([], PAGES)).count() == 0


def test_hook_failures_and_missing_answers_have_a_status(spark, tmp_path):
    importable(spark)

    def read(prompt, text):
        if "boom" in text:
            raise RuntimeError("unreadable")
        return {"provider_name": "V", "account_number": "12345", "utility_type": "Gas", "total_amount_due": 5.0, "delivery_charge": 5.0}

    hook = bt.row_extractor(read)

    def without_last(batches):
        for b in hook(batches):
            yield b[b["record_id"] != "z"]

    rows = [(d, 0, f"{d}.pdf", f"{d} {LONG} {'boom' if d == 'b' else ''}", None) for d in "abz"]
    store = str(tmp_path / "store")
    prepare_store(spark, store)
    done = bt.take_in_documents(spark.createDataFrame(rows, PAGES), 0, store, without_last)
    status = {r["record_id"]: r for r in read_batches(spark, store, "document_status").collect()}
    assert {k: r["status"] for k, r in status.items()} == {"a": "accepted", "b": "rejected", "z": "unanswered"}
    assert status["b"]["reject_reasons"] == ["extractor_error"] + status["b"]["reject_reasons"][1:] and status["a"]["bill_id"] is not None
    assert done.counters["accepted"] == 1 and done.counters["unanswered"] == 1 and done.counters["line_items"] == 1
    empty = bt.take_in_documents(spark.createDataFrame([], PAGES), 1, store)
    assert set(empty.counters.values()) == {0} and read_table(spark, store, "bills").count() == 1


def plain_distance(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1, x)))


@pytest.mark.parametrize("within", [0.5, 7.0, 100.0])
def test_nearest_point_matches_brute_force(spark, within):
    """Cells that don't divide the circle, the date line, the poles, nulls and equal points."""
    draw = random.Random(within)
    spot = lambda: (round(draw.uniform(-90, 90), 1), round(draw.choice([draw.uniform(-180, 180), 180.0, -180.0, 179.9, -179.8]), 1))
    points = [spot() for _ in range(300)]
    asked = [spot() for _ in range(120)] + points[:5] + [(None, 1.0), (90.0, 0.0)]
    frames = [spark.createDataFrame(x, "lat double, lon double") for x in (asked + asked[:3], points + [(None, None)])]
    found = nearest(*frames, within)
    assert found.count() == len(asked) + 3
    got = {(r["lat"], r["lon"]): (r["distance_km"], r["point_lat"], r["point_lon"]) for r in found.collect()}
    for a in asked:
        turn = lambda b: min(abs(a[1] - b[1]), 360 - abs(a[1] - b[1]))  # noqa: B023, E731
        near = [b for b in points if a[0] is not None and abs(a[0] - b[0]) <= within and turn(b) <= within]
        if not near:
            assert got[a] == (None, None, None)
        else:
            assert got[a][0] == pytest.approx(min(plain_distance(a, b) for b in near), abs=1e-6) and (got[a][1], got[a][2]) in near


def test_weather_of_the_neighbouring_grid_point(spark, sample):
    tables, daily = demo.audit_tables(spark, sample), demo.weather_daily(spark, sample)
    moved = daily.withColumns({"lat": F.col("lat") + 0.11, "lon": F.col("lon") - 0.2}).unionByName(
        daily.withColumns({"lat": F.col("lat") + 0.2, "tmax": F.col("tmax") + 50})
    )
    mine, other = (sorted(map(tuple, weather_table(tables.bills, d).collect())) for d in (daily, moved))
    assert mine == other or len(mine) == len(other)
    nearer = moved.filter("tmax < 200")
    assert sorted(map(tuple, weather_table(tables.bills, nearer.filter("lat < 43.05")).collect())) == mine
    far = spark.createDataFrame([(1, 42.9, -78.9), (2, 10.0, 10.0)], "place int, lat double, lon double")
    assert [r["place"] for r in unmatched_locations(far, daily).collect()] == [2]
    assert weather_table(tables.bills, daily, 10.0, 10.0).count() == 0


def test_stored_bills_are_pruned_by_year(spark, sample, tmp_path):
    store = str(tmp_path / "store")
    prepare_store(spark, store)
    tables = demo.audit_tables(spark, sample)
    for name in ("clients", "properties", "vendors", "accounts", "bills"):
        write_batch(getattr(tables, name), store, name, 0)
    stored = read_tables(spark, store)
    for asked, report in [
        ((1996, 1996), lambda t: rp.top_spenders(t, year=1996)),
        ((1995, 1997), lambda t: rp.bill_search(t, start_date="1995-06-01", end_date="1997-02-01")),
    ]:
        plan = plan_of(report(stored))
        line = next(x for x in plan.splitlines() if "PartitionFilters" in x and "billing_year" in x)
        assert f"billing_year" in line and f">= {asked[0]}" in line and f"<= {asked[1]}" in line
        assert sorted(map(tuple, report(stored).collect()), key=repr) == sorted(map(tuple, report(tables).collect()), key=repr)


@pytest.mark.parametrize("text", [
    "SELECT java_method('java.lang.Math', 'random') AS x", "SELECT * FROM csv.`/etc/passwd`", "SELECT * FROM range(3)", "SET x = 1",
    "SELECT 1 AS a) INSERT INTO bills (SELECT 1", "SELECT bill_id FROM other_view", "SELECT bill_id + 1 / 0 AS x FROM bills",
    "SELECT (SELECT count(*) FROM other_view) AS n", "SELECT * FROM (WITH c AS (SELECT * FROM other_view) SELECT c.bill_id FROM c JOIN bills USING (bill_id))",
    "SELECT explode(sequence(1, 1000000000)) AS x", "SELECT bill_id FROM bills WHERE EXISTS (SELECT 1 FROM other_view)", "SELECT 'a' AS x, 'b' AS x",
])
def test_guard_refuses(spark, sample, text):
    tables = demo.audit_tables(spark, sample)
    tables.bills.createOrReplaceTempView("other_view")
    answer = read_only_sql(spark, text, tables)
    assert answer.columns == ["error"] and answer.count() == 1 and answer.first()["error"]


@pytest.mark.parametrize("text", [
    "SELECT ';' AS x, bill_id FROM bills WHERE anomaly_reason LIKE '%;%' OR total_amount BETWEEN 1 AND 100",
    "SELECT * FROM (WITH a AS (SELECT account_id, sum(total_amount) AS t FROM bills GROUP BY 1) SELECT * FROM a WHERE t > (SELECT avg(t) FROM a));",
    "SELECT category, round(avg(total_price), 2) AS m, percent_rank() OVER (ORDER BY avg(total_price)) AS p FROM line_items GROUP BY category HAVING count(*) > 1",
    "SELECT upper(client_name) AS c FROM clients UNION SELECT lower(vendor_name) FROM vendors ORDER BY c LIMIT 5",
    "SELECT date_format(billing_date, 'yyyy-MM') AS m, count(DISTINCT account_id) AS n FROM bills WHERE billing_date >= DATE '1995-01-01' GROUP BY 1",
    "SELECT b.bill_id FROM bills b LEFT JOIN line_items i ON b.bill_id = i.bill_id WHERE i.item_id IS NULL",
])
def test_guard_answers(spark, sample, text):
    answer = read_only_sql(spark, text, demo.audit_tables(spark, sample))
    assert answer.columns != ["error"], answer.first()


def test_a_document_is_read_once(spark, tmp_path):
    """Looking for a record's first answer doesn't ask the extractor again."""
    importable(spark)
    asked = spark.sparkContext.accumulator(0)
    hook = bt.row_extractor(lambda prompt, text: {"provider_name": "V", "account_number": "12345", "utility_type": "Gas", "total_amount_due": 5.0})

    def counting(batches):
        for b in batches:
            asked.add(len(b))
            yield from hook(iter([b]))

    store = str(tmp_path / "store")
    prepare_store(spark, store)
    bt.take_in_documents(spark.createDataFrame([(d, 0, f"{d}.pdf", LONG, None) for d in "abc"], PAGES), 0, store, counting)
    assert asked.value == 3
