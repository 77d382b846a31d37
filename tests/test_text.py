import pytest
from pyspark.sql import functions as F

from tariffscope.functions import text as tx


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).first()["x"]


KEPT = ["Total due", "45.94", "$ 12", "Meter read 17", "Rate class SC1", "  Delivery charge 3 "]
DROPPED = [
    "", "   ", "0.079489 x 304 kWh", "Jan 2023 450 kWh", "12345 678", "Pay at www.utility.com total 12.00",
    "HTTP://rate", "1-800-555-1234 amount due", "A line of plain prose",
]


@pytest.mark.parametrize("line", KEPT)
def test_kept_lines(spark, line):
    assert one(spark, line, tx.clean_lines) == line.strip()


@pytest.mark.parametrize("line", DROPPED)
def test_dropped_lines(spark, line):
    assert one(spark, line, tx.clean_lines) == ""


def test_long_digit_line_needs_a_billing_word(spark):
    assert one(spark, "1234567890 1234567890 12", tx.clean_lines) == ""
    assert one(spark, "1234567890 1234567890 12.50", tx.clean_lines) == "1234567890 1234567890 12.50"


def test_order_and_breaks_survive(spark):
    assert one(spark, "total 1\r\nprose\n\nsupply 2\n\ttax 3 ", tx.clean_lines) == "total 1\nsupply 2\ntax 3"


@pytest.mark.parametrize(
    "page, expected",
    [
        ("pay $73.54 now", True), ("pay $ 73.54", True), ("pay $73 now", False),
        ("27.60 for account 12345", True), ("27.60 for account 1234", False), ("account 123456", False),
        ("27.605 for account 12345", False),
    ],
)
def test_billing_page(spark, page, expected):
    assert one(spark, page, tx.is_billing_page) is expected


def test_route_counts_trimmed_characters(spark):
    assert one(spark, " " * 50 + "x" * 100, tx.text_route) == "scan"
    assert one(spark, "x" * 101, tx.text_route) == "digital"


def test_fences_names_and_accounts(spark):
    assert one(spark, '```json\n{"a": 1}\n```', tx.strip_fences) == '{"a": 1}'
    assert one(spark, "/in/box/b.pdf", tx.base_name) == "b.pdf"
    assert one(spark, " 12-34 567 ", tx.plain_account_number) == "1234567"
    assert one(spark, "12345", tx.is_account_number) and not one(spark, "1234", tx.is_account_number)
    assert not one(spark, "12345\n", tx.is_account_number) and not one(spark, None, tx.is_account_number)


def test_contains_pattern_treats_wildcards_and_backslash(spark):
    assert one(spark, "Alma Clinic", lambda c: tx.contains_pattern(c, "CLIN"))
    assert one(spark, "Alma Clinic", lambda c: tx.contains_pattern(c, "a%c"))
    assert one(spark, "a\\b", lambda c: tx.contains_pattern(c, "\\"))
    assert not one(spark, "Alma", lambda c: tx.contains_pattern(c, "bolt"))
