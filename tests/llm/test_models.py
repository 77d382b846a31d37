"""Context-tree weighting against the sequential definition, language id by held-out accuracy, the pipeline end to end."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tariffscope.llm import ctw, jaccard, langid, packing, pii, quality
from tariffscope.llm.common import body_bytes


def remainder(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def weighted_root(texts, extra=()):
    """Natural log of the root's weighted probability of all symbols, by the recursive definition.

    ``extra`` has symbols to count once more, each as (two bytes before, byte).
    """
    counts = defaultdict(lambda: [0, 0])

    def add(before, byte):
        node = 1
        for bit in range(7, -1, -1):
            one = byte >> bit & 1
            for depth in range(3):
                counts[before[2 - depth :], node][one] += 1
            node = node * 2 + one

    for text in texts:
        data = bytes([ctw.END, ctw.END]) + text + bytes([ctw.END])
        for at in range(2, len(data)):
            add(data[at - 2 : at], data[at])
    for before, byte in extra:
        add(before, byte)

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(before, node):
        own = log_kt(*counts[before, node])
        if len(before) == 2:
            return own
        longer = [bytes([x]) + before for x in range(256)]
        deeper = sum(weighted(b, node) for b in longer if (b, node) in counts)
        high = max(own, deeper)
        return high + math.log((math.exp(own - high) + math.exp(deeper - high)) / 2)

    return sum(weighted(b"", node) for node in range(1, 256) if (b"", node) in counts)


TRAIN = [b"abracadabra", b"abracadab", b"banana band", b""]
TRAIN_IDS = [k for k in range(200) if remainder(k, 10)][:4]
HELD = [k for k in range(200) if not remainder(k, 10)]


def test_byte_model_is_the_conditional_of_the_tree(docs):
    given = docs(list(zip(TRAIN_IDS, (t.decode() for t in TRAIN), strict=True)))
    given = given.selectExpr("doc_id", "CAST(text AS BINARY) AS text", "false AS held_out")
    rows, logs = ctw.byte_model(ctw.corpus_counts(given))
    assert np.allclose((10.0 ** logs.astype(float)).sum(1), 1, atol=1e-4)
    base = weighted_root(TRAIN)
    for before in (b"\xff\xff", b"ab", b"na", b"qa", b"zq"):
        row = logs[rows[before[0] * 256 + before[1]]]
        for symbol in (97, 98, 120, 255):
            gain = weighted_root(TRAIN, [(before, symbol)]) - base
            assert math.isclose(row[symbol] * math.log(10), gain, rel_tol=1e-3), (before, symbol)


def test_scores_and_base(docs):
    rows = list(zip(TRAIN_IDS, (t.decode() for t in TRAIN), strict=True))
    rows += [(HELD[0], "Banana  abra ÉA"), (HELD[1], None), (HELD[2], ""), (HELD[3], "q " * 500), (TRAIN_IDS[0], "abracadabra")]
    found = ctw.score(docs(rows), part_bytes=100).collect()
    assert len(found) == len(rows)
    train = Counter()
    for i, t in rows:
        if remainder(i, 10):
            train.update([*(t or "").lower().split(), ""])
    n, v = sum(train.values()), len(train)
    got = defaultdict(list)
    for r in found:
        got[r["doc_id"]].append(r)
    for i, t in rows:
        own = [*re.sub("[A-Z]", lambda m: m.group().lower(), t or "").split(), ""]
        want = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        for r in got[i]:
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not remainder(i, 10), len(own), sum(w in train for w in own), n)
            assert math.isclose(r["base_score"], want, rel_tol=1e-12)
            assert r["score"] < 0
    assert got[HELD[1]][0]["score"] == got[HELD[2]][0]["score"]
    assert ctw.score(docs([])).count() == 0
    untrained = ctw.score(docs([(HELD[0], "ab")])).collect()[0]
    assert untrained["train_tokens"] == 0 and math.isclose(untrained["score"], -3 * math.log10(256), rel_tol=1e-3)


def test_score_is_the_conditional_of_the_whole_tree(docs):
    """Bytes far behind count: each byte's gain by the recursive definition over all contexts of up to ``DEPTH`` bytes."""
    depth = ctw.DEPTH
    assert depth > 2
    train = [b"abracadabra", b"abracadab", b"banana band xyzab", b""]
    counts = defaultdict(lambda: [0, 0])

    def symbols(text):
        data = bytes([ctw.END] * depth) + text + bytes([ctw.END])
        return [(data[at - depth : at], data[at]) for at in range(depth, len(data))]

    def path(byte):
        return [((1 << (7 - bit)) | (byte >> (bit + 1)), byte >> bit & 1) for bit in range(7, -1, -1)]

    for text in train:
        for before, byte in symbols(text):
            for node, one in path(byte):
                for d in range(depth + 1):
                    counts[before[depth - d :], node][one] += 1
    contexts = defaultdict(set)
    for before, node in counts:
        if before:
            contexts[before[1:], node].add(before)

    def weighted(before, node, added):
        a, b = counts[before, node] if (before, node) in counts else (0, 0)
        at, one = added
        if at.endswith(before):
            a, b = a + (one == 0), b + (one == 1)
        own = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
        if len(before) == depth:
            return own
        below = set(contexts.get((before, node), ()))
        if at.endswith(before) and one is not None:
            below.add(at[depth - len(before) - 1 :])
        deeper = sum(weighted(c, node, added) for c in below)
        high = max(own, deeper)
        return high + math.log((math.exp(own - high) + math.exp(deeper - high)) / 2)

    def log10_of(text):
        gains = [weighted(b"", node, (before, one)) - weighted(b"", node, (before, None)) for before, byte in symbols(text) for node, one in path(byte)]
        return sum(gains) / math.log(10)

    held = [b"abracadabra", b"anana xyz\xc3\xa9", b"", b"qab"]
    rows = list(zip(TRAIN_IDS, train, strict=True)) + list(zip(HELD, held, strict=False))
    for part_bytes in (1 << 20, 20):
        got = {r["doc_id"]: r["score"] for r in ctw.score(docs([(i, t.decode()) for i, t in rows]), part_bytes=part_bytes).collect()}
        for i, text in rows:
            assert math.isclose(got[i], log10_of(text), rel_tol=1e-5), (text, part_bytes)


def test_log_gamma():
    x = np.array([0.5, 1.0, 3.5, 100.5, 1e9])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-10)


def test_gradients_by_differences():
    network = langid.Network(["a", "b"], langid.Settings(hidden=3))
    for layer in (network.forth, network.rear):
        layer.table, layer.mix, layer.bias = (getattr(layer, n).astype(np.float64) for n in layer.NAMES)
    x = np.random.default_rng(1).integers(97, 103, (6, 4)).astype(np.uint8)
    label = np.array([0, 1, 1, 0])
    _, grads = network.gradients(x, label)
    for owner, name, g in grads:
        value = getattr(owner, name)
        for at in list(zip(*np.nonzero(np.abs(g) > np.abs(g).max() / 2), strict=True))[:3]:
            kept = float(value[at])
            value[at] = kept + 1e-3
            up = network.gradients(x, label)[0]
            value[at] = kept - 1e-3
            down = network.gradients(x, label)[0]
            value[at] = kept
            assert math.isclose((up - down) / 2e-3, g[at], rel_tol=0.03, abs_tol=1e-4), (name, at)


def test_language_of_held_out_documents(sample_docs):
    docs = sample_docs.select("doc_id", "text", "lang")
    network = langid.train(docs, langid.Settings(steps=150))
    rows = langid.predict(docs, network).select("row.doc_id", "row.lang", "lang_pred", "score").collect()
    held = [r for r in rows if r["lang"] and not remainder(r["doc_id"], 5)]
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.9 * len(held)


def test_language_of_odd_rows(docs):
    table = docs([(k, "the cat sat" if k % 2 else "der hund saß", "en" if k % 2 else "de") for k in range(40)])
    network = langid.train(table, langid.Settings(steps=60))
    odd = docs([None, "", "123 !?", "the cat " * 3000, "the cat", "the cat"])
    found = {r["doc_id"]: r for r in langid.predict(odd, network).select("row.doc_id", "lang_pred", "score").collect()}
    assert [found[k]["lang_pred"] for k in range(6)] == ["und"] * 3 + ["en"] * 3
    assert [found[k]["score"] for k in range(3)] == [0.0] * 3
    nothing = langid.train(docs([(1, "text")]))
    assert nothing is None
    assert [r["lang_pred"] for r in langid.predict(docs(["text"]), nothing).collect()] == ["und"]
    assert langid.predict(docs([]), network).count() == 0


def test_labels_do_not_depend_on_the_batch():
    network = langid.Network(["a", "b", "c"], langid.Settings())
    texts = [b"one text", b"", b"another " * 100, "ü".encode() * 300]
    together = langid.label(pa.array(texts, pa.binary()), network)["score"]
    alone = [langid.label(pa.array([t], pa.binary()), network)["score"][0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5)


def test_pipeline_stages(spark, sample, sample_docs):
    """Every stage does on its own input what its operator says, and all rows that pass go on."""
    benchmark = spark.read.parquet(f"{sample}/benchmark.parquet").collect()
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "PII", "packing"]
    docs = sample_docs.cache()
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = stages["quality rules"](spark, docs, sample).cache()
    bodies = pa.array([t.encode() for t in before.values()], pa.binary())
    verdict = dict(zip(before, quality.measure(bodies, quality.Rules())["kept"], strict=True))
    assert {r["doc_id"] for r in kept.collect()} == {d for d, ok in verdict.items() if ok}
    one = stages["n-gram Jaccard join"](spark, kept, sample).cache()
    named = jaccard.near_copies(kept).collect()
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({r["component_id"] for r in named})
    clean = stages["benchmark decontamination"](spark, one, sample).cache()

    def plain(text):
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text)
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower) if w]

    windows = set()
    for item in benchmark:
        w = plain(item["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(len(w) - 9, 1))}
    lengths = {len(w) for w in windows}

    def leaks(text):
        w = plain(text)
        return any(tuple(w[i : i + n]) in windows for n in lengths for i in range(len(w) - n + 1))

    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in one.collect() if not leaks(r["text"])}
    private = stages["PII"](spark, clean, sample).cache()
    assert private.columns == docs.columns and private.dtypes == docs.dtypes
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    for r in private.collect():
        assert r["text"] == pii.redact(texts[r["doc_id"]], pii.find(texts[r["doc_id"]])[0]) and r["n_chars"] == len(r["text"])
    last = stages["packing"](spark, private, sample).collect()
    whole = corpus_pipeline.run(spark, sample).collect()
    key = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    assert sorted(tuple(r[c] for c in key) for r in last) == sorted(tuple(r[c] for c in key) for r in whole)
    assert {r["doc_id"] for r in last} == set(texts)
    assert max(r["offset"] + r["length"] for r in last) <= packing.SEQUENCE


def test_words_and_strings_of_texts_are_counted_as_arrays():
    """Counts equal plain ones, and the words of a run of texts are no Python objects, which took most of the time."""
    draw = random.Random(8)
    texts = ["", " \n\t", *(" ".join(draw.choice(["A\x0bb", "É", "é", "ab", "AB", f"w{draw.randrange(3000)}"]) for _ in range(4000)) for _ in range(4))]
    column = pa.array([t.encode() for t in texts], pa.binary())
    plain = Counter(w for t in texts for w in t.encode().lower().split()) + Counter({b"": len(texts)})
    tracemalloc.start()
    try:
        _, n, found = ctw.summed_words(ctw.words_of(column.slice(0, 4)) + ctw.words_of(column.slice(4)))
        blocks = sum(s.count for s in tracemalloc.take_snapshot().statistics("filename"))
    finally:
        tracemalloc.stop()
    assert dict(zip(found.to_pylist(), n.tolist(), strict=True)) == plain
    assert len(plain) > 1000 > 4 * blocks
    known = ctw.Known(pa.table({"key": found.slice(1), "c": n[1:]}), 10.0)
    gone = found[0].as_py()
    tokens, hits, base = known.base(*body_bytes(column))
    for k, text in enumerate(texts):
        own = [*text.encode().lower().split(), b""]
        logs = [math.log10(((plain[w] if w != gone else 0) + ctw.SMOOTHING) / 10.0) for w in own]
        assert (tokens[k], hits[k]) == (len(own), sum(w != gone for w in own))
        assert math.isclose(base[k], math.fsum(logs), rel_tol=1e-12)
    keys, runs = ctw.part_strings(pa.table({"text": column}))
    every = [k for run in [ctw.strings_of(*body_bytes(column))[0]] for k in run.tolist()]
    assert keys.tolist() == sorted(set(every))
    assert np.concatenate([ctw.dealt_back(own, n, order) for own, n, order, _ in runs]).tolist() == every
    assert ctw.words_of(pa.array([], pa.binary()))[0][1].tolist() == [0]


def test_strings_of_held_out_texts_are_asked_but_not_counted():
    texts = [b"abcabc", b"", b"abcx", b"abcabc"]
    held_out = [False, True, True, False]
    given = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(held_out)], names=["text", "held_out"])
    keys, n = ctw.flagged_counts(given.slice(0, 4))
    own = [ctw.strings_of(*body_bytes(pa.array([t], pa.binary())))[0].tolist() for t in texts]
    trained = Counter(k for k, out in zip(own, held_out, strict=True) if not out for k in k)
    assert keys.tolist() == sorted({k for ks in own for k in ks})
    assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == {k: trained[k] for k in keys.tolist()}
    assert 0 in n.tolist()
