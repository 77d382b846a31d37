"""Bill-text rules over whole texts, as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text patterns that decide what counts as billing data.
# (?U) makes digit, space and word classes follow Unicode.
DOLLAR_WITH_CENTS = r"(?U)\$\s*\d+\.\d{2}"
TWO_DECIMALS = r"(?U)\b\d+\.\d{2}\b"
FIVE_DIGITS = r"(?U)\b\d{5,}\b"
UNIT_RATE = r"(?U)\d+\.\d{5,}\s*x"
MONTH_ROW = r"(?U)^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d+"
DIGITS_ONLY = r"(?U)^[\d\s]+\z"
PHONE = r"(?U)^1-\d{3}-\d{3}-\d{4}"
ANY_AMOUNT = r"(?U)\$\s*\d+\.?\d*|\b\d+\.\d{2}\b"
WEB_MARKS = ("www.", "http")

# Words that keep a line.
BILLING_WORDS = (
    "total", "amount due", "account number", "billing period",
    "service period", "date bill issued", "balance forward",
    "current charges", "rate", "meter", "usage", "kwh", "therms",
    "basic service", "delivery", "supply", "demand", "tax",
    "surcharge", "adjustment", "credit", "please pay by",
    "national grid", "conedison", "con edison", "keyspan",
    "rg&e", "pg&e", "provider", "utility",
)

# The white space that trimming removes.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
DIGITAL_MIN_CHARS = 100


def trim_all(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_billing_page(text: Column) -> Column:
    """A dollar amount with cents, or a two-decimal number plus a long digit run."""
    return text.rlike(DOLLAR_WITH_CENTS) | (text.rlike(TWO_DECIMALS) & text.rlike(FIVE_DIGITS))


def text_route(text: Column) -> Column:
    """'digital' if the text layer is rich enough, else 'scan'."""
    return F.when(F.length(trim_all(text)) > DIGITAL_MIN_CHARS, "digital").otherwise("scan")


def _is_noise(line: Column, lowered: Column) -> Column:
    web = lowered.contains(WEB_MARKS[0]) | lowered.contains(WEB_MARKS[1])
    return (
        (line.contains("x") & line.rlike(UNIT_RATE))
        | line.rlike(MONTH_ROW)
        | (line.rlike(DIGITS_ONLY) & (F.length(line) < 20))
        | web
        | line.rlike(PHONE)
    )


def _is_billing_line(line: Column, lowered: Column) -> Column:
    """An amount or a billing word; plain searches go before the pattern."""
    words = reduce(or_, [lowered.contains(word) for word in BILLING_WORDS])
    amount = (line.contains("$") | line.contains(".")) & line.rlike(ANY_AMOUNT)
    return words | amount


def keeps_line(line: Column, lowered: Column) -> Column:
    """Few lines hold billing data, so that is asked first."""
    return (line != "") & _is_billing_line(line, lowered) & ~_is_noise(line, lowered)


def clean_lines(text: Column) -> Column:
    """Text reduced to its billing lines, order kept."""
    lines = F.transform(F.split(text, "\n", -1), trim_all)
    # Each line is lowered once, not once per word it is searched for.
    paired = F.transform(lines, lambda x: F.struct(x.alias("line"), F.lower(x).alias("lowered")))
    kept = F.filter(paired, lambda p: keeps_line(p["line"], p["lowered"]))
    return F.array_join(kept["line"], "\n")


def strip_fences(text: Column) -> Column:
    """Drop Markdown code fences around a JSON answer."""
    return trim_all(F.regexp_replace(text, "```json|```", ""))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def plain_account_number(text: Column) -> Column:
    return trim_all(F.regexp_replace(F.coalesce(text, F.lit("")), "[- ]", ""))


def is_account_number(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[0-9]{5,}\z"), F.lit(False))


def dollars(value: str, decimals: int = 0) -> str:
    """SQL text for '$1,234' or '$1,234.50'."""
    return f"concat('$', format_number({value}, {decimals}))"


def contains_pattern(column: Column, wanted: str) -> Column:
    """Case-insensitive 'contains'; % and _ in ``wanted`` act as wildcards."""
    pattern = "%" + wanted.replace("\\", "\\\\") + "%"
    return F.like(F.lower(column), F.lower(F.lit(pattern)))
