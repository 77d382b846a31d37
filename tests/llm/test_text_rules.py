"""Quality rules, personal data, token counts and sharding against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from tariffscope.llm import pii, quality, sharding, tokencount

HARD = ["", None, "   ", "word", "a b c " * 40, "x" * 5000, "é ü ß ç " * 30, "line one here\n\nline one here\n \nother\n" * 9,
        "#*$ %&|<> \x0b\x0c tab\ttab", "same same same same same"]


def longest_repeats(words):
    """Longest repeat that starts at each word, by comparing all pairs of starts."""
    best = [0] * len(words)
    for i in range(len(words)):
        for j in range(i + 1, len(words)):
            k = 0
            while j + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            best[i], best[j] = max(best[i], k), max(best[j], k)
    return best


def measures(text, rules):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    longest = longest_repeats(words)

    def cover(least):
        return len({p for i, n in enumerate(longest) if n >= least for p in range(i, i + n)})

    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeat = len({p for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for p in range(i, i + 3)})
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, passages, top = len(words), cover(rules.min_repeat), max(longest, default=0)
    failed = n < 50 or 100 * repeat > 50 * n
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeat, "covered_words": passages, "longest_repeat": top,
        "base_failed": failed, "kept": not failed and passages <= rules.max_covered_share * n and top <= rules.max_longest,
    }


def test_quality_matches_brute_force(docs):
    draw = random.Random(5)
    texts = HARD + [" ".join(draw.choice("abcdefghijkl") for _ in range(draw.randint(0, 150))) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "word"), (None, "a b")]
    found = quality.judge(docs(rows)).select("row.doc_id", "row.text", *[c.split()[0] for c in quality.COLUMNS.split(", ")]).collect()
    assert len(found) == len(rows)
    for row in found:
        want = measures(row["text"], quality.Rules())
        assert {k: row[k] for k in want} == want, row["text"]


def test_quality_verdict_and_columns(docs):
    draw = random.Random(6)
    fresh = " ".join(f"w{draw.randrange(10**6)}" for _ in range(300))
    passage = " ".join(f"p{k}" for k in range(120))
    table = docs([(1, fresh), (2, f"{passage} {fresh} {passage}"), (3, "short text"), (4, None)])
    kept = quality.keep_good(table)
    assert kept.columns == table.columns
    assert [r["doc_id"] for r in kept.collect()] == [1]
    assert quality.keep_good(docs([])).count() == 0


def spans_by_regex(text):
    """Base kinds by their grammar as one regular expression each."""
    grammar = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(re.sub(r"\D", "", s)) <= 19 and pii.luhn(re.sub(r"\D", "", s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub(r"\D", "", s)) <= 15),
    )
    return [f"{kind}:{m.start()}:{m.end()}" for kind, p, ok in grammar for m in re.finditer(p, text) if ok(m.group())]


PRIVATE = [
    "write to a.b+c@mail.example.com, or x@y or @z.com or a@b.c@d.e and é@x.yy q@-.-",
    "hosts 10.0.0.1 256.1.1.1 1.2.3.4.5.6.7.8 1.2.3 0000255.1.1.1 9.9.9.9.9",
    "cards 4041894974608795 4041 8949 7460 8795 4041-8949-7460-8796 4041  894974608795",
    "call +1 (988) 555-2485 or +49 30 123 or +123456789012345678 or +1........2 +1+2",
    "bank account GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33",
    "social security 123-45-6789" + " but" * 20 + " part 987-65-4321 alone",
    "1" * 3000, "1." * 500, "+" * 50 + "@" * 50, "a" * 2000 + "@",
]


def test_personal_data_base_spans(docs):
    draw = random.Random(8)
    noise = ["".join(draw.choice("a1.@+ -0(2%") for _ in range(120)) for _ in range(150)]
    texts = PRIVATE + noise + [None, ""]
    for row in pii.detect(docs(texts)).select("row.text", "*").collect():
        base = spans_by_regex(row["text"] or "")
        assert row["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), row["text"]
        assert [row[f"n_{k}"] for k in pii.BASE_KINDS] == [sum(s.startswith(k + ":") for s in base) for k in pii.BASE_KINDS]
        assert [s for s in row["spans"].split(",") if s.split(":")[0] in pii.BASE_KINDS] == base


def test_personal_data_checksums_and_context(docs):
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    spans, scores = pii.find(PRIVATE[4])
    assert [pii.KINDS[s.kind] for s in spans] == ["iban"] and scores == [1.0]
    spans, _ = pii.find(PRIVATE[5])
    assert [(pii.KINDS[s.kind], s.start) for s in spans] == [("national_id", 16)]
    table = docs([(1, "mail a@b.cc now"), (2, None), (2, None), (3, "clean")])
    changed = pii.redacted(table)
    assert changed.columns == table.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in changed.collect()) == [(1, "mail [EMAIL] now"), (2, ""), (2, ""), (3, "clean")]


def brute_tokens(model, word):
    text = tokencount.WORD_START + word
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        size = len(text[end - 1].encode())
        options = [(best[end - 1][0] + size * model.byte_score, best[end - 1][1] - size)]
        options += [
            (best[s][0] + model.score[text[s:end]], best[s][1] - 1) for s in range(end) if text[s:end] in model.score
        ]
        best.append(max(options))
    return -best[-1][1]


def test_token_counts_share_prefixes(docs):
    from tariffscope.llm.queries import PIECES

    model = tokencount.Unigram.from_file(PIECES)
    assert math.isclose(sum(map(math.exp, model.score.values())), 1, abs_tol=0.05)
    texts = ["the theory of their thermal theses", "", None, "aaaaaaaaaaaaaaaaaaaaaaaaa", "日本語 é x " * 5, "z" * 3000, "the the the"]
    for row in tokencount.count_tokens(docs(texts), PIECES).select("row.text", "n_tokens").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", row["text"] or "")
        assert row["n_tokens"] == sum(brute_tokens(model, w) for w in words)


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(tokencount, "REMEMBERED", 3)
    model = tokencount.Unigram({"▁a": -1.0, "b": -1.0}, -5.0)
    assert [model.totals([t]) for t in (b"a ab abb", b"b bb bbb", b"a ab abb abbb")] == [[6], [15], [10]]
    assert len(model.known) <= 4


def test_permutation_table():
    names = [f"s{k}" for k in range(7)]
    table = sharding.fill(names, 101)
    sizes = Counter(table)
    assert set(table) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.fill(names[:-1], 101)
    assert sum(a != b and a != 6 for a, b in zip(table, fewer, strict=True)) < 30
    with pytest.raises(ValueError):
        sharding.fill(["a", "a"])


def test_sharding_of_rows(docs):
    rows = [(k, "t") for k in range(200)] + [(3, "other"), (None, "x"), (None, None)]
    names = ["a", "b", "c"]
    table = sharding.fill(names, 1009)
    found = sharding.assign(docs(rows), names, slots=1009).select("row.doc_id", "slot", "shard").collect()
    assert len(found) == len(rows)
    for row in found:
        key = "" if row["doc_id"] is None else str(row["doc_id"])
        assert row["slot"] == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 1009
        assert row["shard"] == names[table[row["slot"]]]
    assert sharding.assign(docs([]), names).count() == 0
