"""Personal data in documents: patterns propose spans, checksums confirm, context adjusts the score.

Base kinds (email, ip, card, phone) are found by their fixed grammar and always
kept once they are valid. The method adds bank account numbers (IBAN, mod-97)
and national ids, which need a checksum or telling words nearby. Every span has
a score, so a user can redact by any threshold.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffscope.llm.common import add_columns

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "national_id")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
CALL = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Words within ``NEAR`` characters that raise the score of a kind.
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "credit", "visa", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "national_id": ("ssn", "social security", "tax id", "national id"),
}
NEAR = 40
#: Score by the pattern (and its checksum) alone, and what context adds.
START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "national_id": 0.3}
CONTEXT_GAIN = 0.3
ACCEPT = 0.5

COLUMNS = (
    "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
    "scores array<double>, redacted string"
)


@dataclass(frozen=True, order=True)
class Span:
    kind: int
    start: int
    end: int

    def text(self) -> str:
        return f"{KINDS[self.kind]}:{self.start}:{self.end}"


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """An IBAN's letters become numbers, its first four characters go last; the rest must be 1."""
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each ``@`` with local characters before it and a dotted domain after it; linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Groups of four numbers in a dotted run, from its left; a group over 255 is dropped whole."""
    for run in DOTTED.finditer(text):
        parts = run.group().split(".")
        at = run.start()
        for first in range(0, len(parts) - 3, 4):
            group = parts[first : first + 4]
            length = sum(map(len, group)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in group):
                yield at, at + length
            at += length + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for run in DIGITS.finditer(text):
        if run.end() - run.start() < 13:
            continue
        digits = run.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield run.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for run in CALL.finditer(text):
        if 9 <= sum(c in "0123456789" for c in run.group()) <= 15:
            yield run.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest prefix of a run of groups that passes mod-97."""
    for run in IBAN.finditer(text):
        code = run.group()
        for length in range(len(code), 14, -1):
            bare = code[:length].replace(" ", "")
            if len(bare) >= 15 and code[length - 1] != " " and (length == len(code) or code[length] == " ") and mod97(bare):
                yield run.start(), run.start() + length
                break


def national_ids(text: str) -> Iterator[tuple[int, int]]:
    return (run.span() for run in NATIONAL.finditer(text))


FINDERS = (emails, addresses, cards, phones, ibans, national_ids)


def score(kind: str, text: str, start: int, end: int) -> float:
    near = (text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]).lower()
    return min(1.0, START[kind] + CONTEXT_GAIN * any(word in near for word in CONTEXT[kind]))


def find(text: str) -> tuple[list[Span], list[float]]:
    """Accepted spans by kind and start, with their scores; positions are code points."""
    spans, scores = [], []
    for number, (kind, finder) in enumerate(zip(KINDS, FINDERS, strict=True)):
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text:
            continue
        for start, end in finder(text):
            value = score(kind, text, start, end)
            if kind in BASE_KINDS or value >= ACCEPT:
                spans.append(Span(number, start, end))
                scores.append(value)
    return spans, scores


def redact(text: str, spans: list[Span]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first one."""
    pieces, done = [], 0
    for span in sorted(spans, key=lambda s: (s.start, -s.end)):
        if span.start >= done:
            pieces += [text[done : span.start], f"[{KINDS[span.kind].upper()}]"]
        done = max(done, span.end)
    return "".join([*pieces, text[done:]])


def inspect(bodies: pa.Array, with_redacted: bool) -> dict[str, object]:
    made: dict[str, list] = {name.split()[0]: [] for name in COLUMNS.split(", ")}
    for body in bodies:
        text = body.as_py().decode()
        spans, scores = find(text)
        for number, kind in enumerate(BASE_KINDS):
            made[f"n_{kind}"].append(sum(s.kind == number for s in spans))
        base = ",".join(s.text() for s in spans if s.kind < len(BASE_KINDS))
        made["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
        made["spans"].append(",".join(s.text() for s in spans))
        made["scores"].append(scores)
        made["redacted"].append(redact(text, spans) if with_redacted else None)
    return made | {"scores": pa.array(made["scores"], pa.list_(pa.float64())), "redacted": pa.array(made["redacted"], pa.string())}


def detect(docs: DataFrame, with_redacted: bool = True) -> DataFrame:
    """Every input row as ``row`` with counts, spans, scores and the redacted text.

    A null text counts as empty and has no spans; overlapping spans of different
    kinds are all reported and redacted once. Repeated rows are treated one by
    one, extra columns stay inside ``row``, an empty table gives an empty result.
    """
    return add_columns(docs, COLUMNS, lambda bodies: inspect(bodies, with_redacted))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with the accepted spans replaced in ``text``, and ``n_chars`` (if there is one) counted anew.

    Null texts stay null; every row stays.
    """
    text = F.when(F.col("row.text").isNotNull(), F.col("redacted"))
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row = row.withField("n_chars", F.when(F.col("row.text").isNotNull(), F.char_length(text)).otherwise(F.col("row.n_chars")).cast(kind))
    return detect(docs).select(row.alias("row")).select("row.*")
