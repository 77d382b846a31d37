"""Near copies by signatures, spelling variants and collocations against brute force on small tables."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tariffscope.llm import bbit, collocations, spelling

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLD = str.maketrans(UPPER, UPPER.lower())


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + 3]) for i in range(max(len(w) - 2, 1))} if w else set()


def plain_components(rows):
    sets, name = [plain_set(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                name = [name[a] if x == name[b] else x for x in name]
    least = {n: min(rows[k][0] for k in range(len(rows)) if name[k] == n) for n in set(name)}
    return [(rows[k][0], len(sets[k]), least[name[k]], rows[k][0] == least[name[k]]) for k in range(len(rows))]


def family(seed):
    """One large group whose members lie at all distances of each other, small ones, tiny and empty texts."""
    draw = random.Random(seed)
    texts = ["", None, "one", "ONE", "one two", "one two three", " \n ", "É1 é1", "a b c d e f g", "a b c d e f g h"]
    for size, copies in [(120, 60), (40, 8), (300, 5), (9, 4), (12, 4), (25, 4)]:
        base = [f"w{draw.randrange(10**6)}" for _ in range(size)]
        for _ in range(copies):
            copy = list(base)
            for _ in range(draw.randint(0, max(1, size // 24))):
                copy[draw.randrange(size)] = f"e{draw.randrange(10**6)}"
            texts.append(" ".join(copy).upper() if draw.random() < 0.1 else " ".join(copy))
    draw.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "bucket", "cluster"), [(1, 8192, 1 << 21), (2, 7, 900)])
def test_signatures_find_all_near_copies(docs, monkeypatch, seed, bucket, cluster):
    """The same with buckets and clusters dealt over pairs of parts."""
    monkeypatch.setattr(bbit, "BUCKET_PART", bucket)
    monkeypatch.setattr(bbit, "CLUSTER_PART", cluster)
    rows = family(seed)
    assert sorted(map(tuple, bbit.near_copies(docs(rows)).collect())) == sorted(plain_components(rows))


def test_near_copies_of_odd_rows(docs):
    text = " ".join(f"t{k}" for k in range(30))
    rows = [(7, text), (7, text), (3, text.upper()), (None, text), (None, None), (9, None), (None, "x y z"), (None, "X y z")]
    found = sorted(map(tuple, bbit.near_copies(docs(rows)).collect()), key=repr)
    want = [(7, 28, 3, False), (7, 28, 3, False), (3, 28, 3, True), (None, 28, 3, False), (9, 0, 9, True)]
    assert found == sorted([*want, (None, 0, None, True), *[(None, 1, None, True)] * 2], key=repr)
    assert bbit.near_copies(docs([])).count() == 0


def test_estimate_is_corrected_for_chance():
    draw = np.random.default_rng(3)
    hashes = draw.integers(1, 1 << 63, 3000, dtype=np.uint64)
    sets = [np.sort(hashes[:2000]), np.sort(hashes[1000:]), np.sort(hashes[:1000]), np.sort(hashes[2000:])]
    rows = bbit.packed(bbit.minima(np.concatenate(sets), np.cumsum([0, *map(len, sets)])))
    for one, other, true in [(0, 0, 1), (0, 1, 1 / 3), (0, 2, 0.5), (2, 3, 0)]:
        assert abs(bbit.estimate(bbit.agreements(rows[one], rows[other])) - true) < 0.12
    plain = [[int(w) >> s & 15 for w in row for s in range(0, 64, 4)] for row in rows]
    assert bbit.agreements(rows[0], rows[1]) == sum(a == b for a, b in zip(plain[0], plain[1], strict=True))


def plain_variants(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            k = h % len(word)
            counts[word[:k] + word[k + 1 :] if h % 31 == 0 else word] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near = defaultdict(set)
    for a in n:
        for b in n:
            if len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1 or any(a[:i] + a[i + 1 :] == b for i in range(len(a))):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n.get(form[w], 0)) for w in n)


def shown(df):
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in df.collect())


def test_variants_match_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 50)
    draw = random.Random(5)
    stems = ["wanderung", "aaaaaaa", "aaaaaaaa", "abababab", "élèveçon", "Àbcdefgh", "zzzzzzzzz" * 9]
    words = list(stems)
    for _ in range(150):
        w = list(draw.choice(stems))
        for _ in range(draw.randint(1, 2)):
            at = draw.randrange(len(w))
            w[at : at + draw.randint(0, 1)] = draw.choice(["", "a", "b", "z", "é", "ab"])
        words.append("".join(w))
    rows = []
    for k in range(120):
        chosen = [draw.choice(words[: draw.choice([2, 4, 7, 40, len(words)])]) for _ in range(60)]
        rows.append((draw.choice([k, k, None]), draw.choice([" ", "_", "1", "þā", ", "]).join(w.upper() if draw.random() < 0.1 else w for w in chosen)))
    rows += [(500, None), (501, ""), (502, "×÷" * 4), rows[0], rows[0]]
    want = plain_variants(rows)
    assert sum(1 for w in want if w[1]) > 10 and any(w[1] and w[2] != w[1] for w in want)
    assert shown(spelling.variants(docs(rows))) == want
    assert spelling.variants(docs([])).count() == 0


def test_runs_of_broken_bytes_and_long_words(spark, docs):
    rows = [(1, "x" * 5000 + " " + "y" * 4999), (2, "x" * 5000), (3, "x" * 4999), (4, "x" * 4999)]
    frame = docs(rows).selectExpr("doc_id", "text", "lang AS word", "n_words AS id")
    assert [w[:1] + w[3:5] for w in shown(spelling.variants(frame))] == [w[:1] + w[3:5] for w in plain_variants(rows)]
    broken = spark.sql("SELECT 1L AS doc_id, CAST(X'61626364656667C3206162636465666768FF6162636465666720616263646566676820' AS STRING) AS text")
    assert {w[0] for w in shown(spelling.variants(broken))} == {"abcdefg", "abcdefgh"}


def plain_phrases(rows, top, least):
    grams, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for size in range(1, 5):
                grams[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    made = []
    for lang, f in grams.items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in good.items():
            if any(100 * b >= 80 * a for q, b in good.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            made.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(made)


@pytest.mark.parametrize(("top", "least", "ahead", "held"), [(5, 3, 1, 100), (12, 2, 2, 10**6), (10**6, 2, 2, 500)])
def test_collocations_match_brute_force(spark, docs, monkeypatch, top, least, ahead, held):
    """Few phrases wanted, so that bounds decide; all of them; one node more at a time."""
    monkeypatch.setattr(collocations, "AHEAD", ahead)
    monkeypatch.setattr(collocations, "HELD", held)
    draw = random.Random(top)
    pool = [f"v{k}" for k in range(30)] + ["Été", "d'un", "(a)"]
    fixed = [[draw.choice(pool) for _ in range(draw.randint(2, 6))] for _ in range(12)]
    rows = []
    for k in range(150):
        parts = [draw.choice(fixed) if draw.random() < 0.6 else [draw.choice(pool) for _ in range(draw.randint(1, 5))] for _ in range(12)]
        text = "".join(" ".join(p) + draw.choice([" ", "\t ", ", ", "\n", "! ", "\x0b"]) for p in parts)
        rows.append((k, text.upper() if draw.random() < 0.1 else text, draw.choice(["en", "en", "fr", None, "und", "x'y"])))
    rows += [(900, None, "en"), (901, "", "xx"), (902, " . ,", None), rows[0]]
    found = collocations.collocations(docs(rows), top, least)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == plain_phrases([(r[2], r[1]) for r in rows], top, least)


def test_scores_beyond_64_bits(spark):
    a = 3 * 10**18
    row = spark.range(1).select(*[collocations.whole_score(*[collocations.F.lit(x) for x in t]).alias(str(k)) for k, t in enumerate([(a, a + 1, a), (a, a, a), (1, 3, 4)])])
    assert tuple(row.first()) == (2_000_000 * a // (2 * a + 1), 1_000_000, 285714)


def test_collocations_of_empty_tables_and_clashing_hashes(docs, monkeypatch):
    assert collocations.collocations(docs([])).count() == 0
    assert collocations.collocations(docs([(1, "only words", "en")])).count() == 0
    keys = [np.array([5, 7, 5, 7, 5], np.uint64), np.array([1, 2, 1, 2, 3], np.uint64)]
    monkeypatch.setattr(collocations, "phrase_key", lambda parts: np.zeros(len(parts[0]), np.uint64))
    columns, n = collocations.grouped(keys, np.arange(1, 6))
    assert sorted(zip(*[c.tolist() for c in columns], n.tolist(), strict=True)) == [(5, 1, 4), (5, 3, 5), (7, 2, 6)]
