"""Near copies, long repeats and benchmark leaks against brute force on small tables."""

import hashlib
import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tariffscope.llm import arrays, decontaminate, graph, jaccard, suffixes


def words(draw, n, pool=10**6):
    return [f"w{draw.randrange(pool)}" for _ in range(n)]


def families(seed, groups=12):
    """Texts with exact copies, near copies at all distances, shared passages, tiny and empty ones."""
    draw = random.Random(seed)
    passage = words(draw, 40)
    texts = ["", None, "one two", "ONE  two", "one two three", "x", " \n ", "Éa éa b c d"]
    for _ in range(groups):
        base = words(draw, draw.randint(8, 160)) + (passage if draw.random() < 0.5 else [])
        for _ in range(draw.randint(1, 6)):
            copy = list(base)
            for _ in range(draw.randint(0, 5)):
                copy[draw.randrange(len(copy))] = f"e{draw.randrange(10**6)}"
            texts.append(" ".join(w.upper() if draw.random() < 0.1 else w for w in copy))
    draw.shuffle(texts)
    return texts


def shingles(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    name = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                name = [name[a] if x == name[b] else x for x in name]
    least = {n: min(rows[k][0] for k in range(len(rows)) if name[k] == n) for n in set(name)}
    return [(rows[k][0], len(sets[k]), least[name[k]]) for k in range(len(rows))]


@pytest.mark.parametrize(("seed", "part", "shingles_"), [(1, 1 << 21, 1 << 21), (2, 700, 1 << 21), (3, 1 << 21, 150), (5, 500, 100)])
def test_near_copies_match_brute_force(docs, monkeypatch, seed, part, shingles_):
    """Whole blocks and clusters, and ones dealt as pairs of parts."""
    monkeypatch.setattr(jaccard, "PART", part)
    monkeypatch.setattr(jaccard, "CLUSTER_PART", shingles_)
    rows = list(enumerate(families(seed)))
    found = jaccard.near_copies(docs(rows)).collect()
    assert sorted(map(tuple, found)) == sorted(brute_components(rows))


@pytest.mark.parametrize("size", [1, 2, 16, 17, 300, 700])
def test_tree_leaves_what_the_bound_leaves(size):
    draw = np.random.default_rng(size)
    base = draw.poisson(1.0, (5, jaccard.GROUPS))
    points = np.sort(base[draw.integers(0, 5, size)] + draw.poisson(0.05, (size, jaccard.GROUPS)), axis=0).astype(np.int32)
    points = points[draw.permutation(size)]
    sizes = points.sum(1)
    fits = draw.random((size, size)) < 0.8
    bound = np.minimum(points[:, None], points).sum(2)
    expected = fits & jaccard.enough(bound, sizes, sizes[:, None])
    assert (jaccard.Tree(sizes, points).passing(np.arange(size), fits) == expected).all()


def test_trees_of_long_and_short_sets_lose_no_link():
    """Points of one and of twice as many coordinates meet, and unrelated long sets don't pass."""
    draw = np.random.default_rng(4)
    pool = draw.integers(0, 1 << 63, (3, 5000), dtype=np.uint64) * np.uint64(2)
    sets = [np.unique(pool[k % 3, : draw.integers(200, 5000)]) for k in range(120)]
    sizes = np.array([len(x) for x in sets])
    first = np.concatenate(([0], np.cumsum(sizes)))
    trees = jaccard.Trees(sizes, jaccard.counted(np.concatenate(sets), first))
    passing = trees.passing(np.arange(120), np.ones((120, 120), bool))
    overlap = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    linked = jaccard.enough(overlap, sizes, sizes[:, None])
    assert (passing | ~linked).all() and not passing[overlap == 0].any()
    packed = jaccard.points_of(np.concatenate(sets), first)
    assert all((a == b).all() for a, b in zip(jaccard.unpacked(packed, sizes), jaccard.counted(np.concatenate(sets), first), strict=True))


def test_common_shingles_lose_no_link(docs, monkeypatch):
    """With every shingle called common, salted blocks still meet."""
    monkeypatch.setattr(jaccard, "SALTS", 3)
    real = jaccard.rarity_levels
    monkeypatch.setattr(jaccard, "rarity_levels", lambda s: real(s) * 0 + 3)
    rows = list(enumerate(families(4)))
    assert sorted(map(tuple, jaccard.near_copies(docs(rows)).collect())) == sorted(brute_components(rows))


def test_near_copies_of_odd_rows(docs):
    text = " ".join(f"t{k}" for k in range(30))
    rows = [(7, text), (7, text), (3, text.upper()), (None, text), (None, None), (9, None)]
    found = sorted(map(tuple, jaccard.near_copies(docs(rows)).collect()), key=repr)
    assert found == sorted([(7, 26, 3), (7, 26, 3), (3, 26, 3), (None, 26, 3), (None, 0, None), (9, 0, 9)], key=repr)
    table = docs([(7, text), (7, text), (8, text + " more"), (1, "else"), (1, "else")])
    kept = jaccard.one_of_each(table)
    assert kept.columns == table.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 7]
    assert jaccard.near_copies(docs([])).count() == 0


def test_one_of_each_loses_no_unlinked_text(docs):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (2, a), (2, a), (None, c), (None, c.upper()), (None, b), (4, None), (4, ""), (4, " . "), (None, None), (5, c + " d")]
    kept = jaccard.one_of_each(docs(rows)).collect()
    texts = sorted(((r["doc_id"] or 0), (r["text"] or "").lower()) for r in kept)
    assert [t for t in texts if t[1].strip(" .")] == [(1, a), (1, b), (5, c + " d")]
    assert sorted(t[0] for t in texts if not t[1].strip(" .")) == [0, 4, 4]
    assert jaccard.one_of_each(docs([])).count() == 0


def test_components(spark):
    draw = random.Random(3)
    pairs = [(k, k + 1) for k in range(40)] + [(draw.randrange(100, 160), draw.randrange(100, 160)) for _ in range(40)] + [(200, k) for k in range(201, 260)]
    parent = {x: x for p in pairs for x in p}
    for a, b in pairs:
        low, high = sorted((parent[a], parent[b]))
        parent = {x: low if r == high else r for x, r in parent.items()}
    found = graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["u"]: r["v"] for r in found} == {x: r for x, r in parent.items() if x != r}


def brute_cut(texts, length):
    bodies = [(t or "").encode() for t in texts]
    places = defaultdict(int)
    for b in bodies:
        for i in range(len(b) - length + 1):
            places[b[i : i + length]] += 1
    made = []
    for b in bodies:
        mask = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if places[b[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        kept = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        runs = sum(mask[k] and not (k and mask[k - 1]) for k in range(len(mask)))
        made.append((len(b), sum(mask), runs, hashlib.sha256(kept).hexdigest()))
    return made


def repeating(seed):
    draw = random.Random(seed)

    def text(n):
        return "".join(draw.choice("abcdeé ") for _ in range(n))

    passage, line = text(700), text(399)
    texts = [None, "", text(350), "z" * 1500, "zy" * 600, passage, passage[100:520], passage[300:], line, line + text(30)]
    for _ in range(14):
        cut = draw.randrange(300)
        texts.append(text(draw.randrange(200)) + passage[cut : cut + draw.randrange(380, 700)] + text(draw.randrange(200)))
    base = text(2500)
    for _ in range(6):
        edited = list(base)
        edited[draw.randrange(len(base))] = "X"
        texts.append("".join(edited))
    return [*texts, base, base + base[:450]]


@pytest.mark.parametrize(("seed", "size", "together"), [(1, 20_000, 2_000), (2, 3, 4), (3, 1, 1)])
def test_long_repeats_match_brute_force(docs, monkeypatch, seed, size, together):
    """The same with classes that are split by distance, down to counted starts."""
    monkeypatch.setattr(suffixes, "CLASS", size)
    monkeypatch.setattr(suffixes, "TOGETHER", together)
    texts = repeating(seed)
    left = suffixes.without_repeats(docs(texts)).collect()
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in left}
    assert [found[k] for k in range(len(texts))] == brute_cut(texts, suffixes.LENGTH)


def test_long_repeats_of_odd_rows(docs):
    text = "".join(random.Random(9).choice("abcdef") for _ in range(600))
    rows = [(1, text), (1, text), (None, text[:450]), (4, "short"), (4, "short")]
    found = sorted((r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffixes.without_repeats(docs(rows)).collect())
    assert found == [(5, 0, 0), (5, 0, 0), (450, 450, 1), (600, 600, 1), (600, 600, 1)]
    assert suffixes.without_repeats(docs([])).count() == 0


def test_long_repeats_take_bounded_memory(monkeypatch):
    """A class of the largest size that is sorted together: arrays in proportion to its starts, not to a hash's steps."""
    monkeypatch.setattr(arrays, "_POWERS", {})
    draw = np.random.default_rng(5)
    strings = [draw.integers(97, 123, suffixes.LENGTH + 100, np.uint8).tobytes() for _ in range(suffixes.CLASS - 1)]
    column = pa.array([*strings, strings[7][10:]], pa.binary())
    tracemalloc.start()
    try:
        owner, start, stop = suffixes.repeated_runs(column)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [*zip(owner, start, stop, strict=True)] == [(7, 10, 101), (suffixes.CLASS - 1, 0, 91)]
    assert peak < 160 << 20
    assert max(map(len, arrays._POWERS.values())) <= 1 << 20


BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [w for w in BETWEEN.split(lower) if w]


def brute_contamination(rows, items):
    windows = defaultdict(set)
    for item, text in items:
        w = plain_words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    made = []
    for doc, text in rows:
        w, hit, which = plain_words(text), set(), set()
        for i in range(len(w)):
            for n in range(1, 11):
                found = windows.get(tuple(w[i : i + n])) if i + n <= len(w) else None
                if found:
                    hit |= set(range(i, i + n))
                    which |= found
        digest = hashlib.sha256(",".join(sorted(which)).encode()).hexdigest()
        made.append((doc, len(w), len(hit), len(which), digest, bool(hit)))
    return made


@pytest.mark.parametrize("bound", [500_000, 0])
def test_leaks_match_brute_force(spark, docs, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", bound)
    draw = random.Random(11)
    pool = [f"v{k}" for k in range(40)] + ["É1", "日本"]
    items = [(k, " ".join(draw.choice(pool) for _ in range(n))) for k, n in enumerate((30, 12, 10, 9, 4, 4, 25))]
    items += [(50, None), (51, "!!"), (52, items[0][1]), (None, "q1 q2 q3")]
    rows = [(1, None), (2, ""), (3, "Q1-q2,q3"), (4, "é1 " * 20)]
    for k in range(40):
        item = draw.choice(items[:7])[1].split()
        part = item[draw.randrange(3) :][: draw.randint(3, 20)]
        text = [draw.choice(pool) for _ in range(draw.randint(0, 30))]
        at = draw.randrange(len(text) + 1)
        rows.append((10 + k, ", ".join(text[:at] + part + text[at:]).upper()))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    items = [("" if i is None else i, t) for i, t in items]
    found = decontaminate.contamination(docs(rows), benchmark).collect()
    want = brute_contamination(rows, [(i, t) for i, t in items if i != ""])
    got = {r["doc_id"]: tuple(r) for r in found}
    for row in want:
        if row[0] == 3:  # only a null item occurs there: hit, but without a name
            assert got[3][2] == 3 and got[3][3] == 0
        else:
            assert got[row[0]] == row
    clean = decontaminate.clean(docs(rows), benchmark)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r in found if not r["contaminated"])


def test_leaks_of_odd_rows(spark, docs):
    item = "a b c d e f g h i j k"
    benchmark = spark.createDataFrame([(1, item), (1, item)], "item_id long, text string")
    rows = [(5, f"x {item} y"), (5, "other text"), (None, item), (6, item), (6, item)]
    found = sorted((r["doc_id"] or 0, r["n_hit"], r["n_items"]) for r in decontaminate.contamination(docs(rows), benchmark).collect())
    assert found == [(0, 11, 1), (5, 0, 0), (5, 11, 1), (6, 11, 1), (6, 11, 1)]
    assert [(r["doc_id"], r["text"]) for r in decontaminate.clean(docs(rows), benchmark).collect()] == [(5, "other text")]
    assert decontaminate.contamination(docs([]), benchmark).count() == 0
    empty = benchmark.filter("item_id > 1")
    assert [r["contaminated"] for r in decontaminate.contamination(docs(rows), empty).collect()] == [False] * 5


def test_many_windows_send_no_words_of_documents(spark, docs, monkeypatch):
    """With more windows than are broadcast: a shuffle carried the whole text once for each stride before."""
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(decontaminate, "WINDOW_FILTER_BITS", 128, raising=False)  # full, so that the joins decide
    draw = random.Random(3)
    items = [(k, " ".join(f"w{draw.randrange(900)}" for _ in range(n))) for k, n in enumerate([14] * 40 + [4] * 5)]
    rows = [(k, " ".join(f"w{draw.randrange(900)}" for _ in range(2000)) + f" {items[k][1]} ") for k in range(4)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    windows = decontaminate.item_windows(benchmark)
    hits = decontaminate.occurrences(docs(rows), ["doc_id"], windows.drop("item_id"), [4, 10], 10, False)
    sent, todo = [], [hits._jdf.queryExecution().sparkPlan()]
    while todo:
        node = todo.pop()
        below = [node.children().apply(k) for k in range(node.children().size())]
        todo += below
        if "Join" in node.nodeName() and "Broadcast" not in node.nodeName():
            sent += [child.schema().simpleString() for child in below]
    assert sent and not any("array" in schema for schema in sent)
    want = brute_contamination(rows, items)
    got = sorted(tuple(r) for r in decontaminate.contamination(docs(rows), benchmark).collect())
    assert got == sorted(want) and all(r[3] for r in got)
