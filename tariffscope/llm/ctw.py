"""Language-model scores by context-tree weighting over bytes, beside a word unigram base.

Each byte is eight binary decisions; a decision's node has counts for every
context of 0 to ``DEPTH`` preceding bytes. Krichevsky-Trofimov estimates of all
depths are mixed by their posterior weights, computed bottom-up. Byte
``END`` (never part of UTF-8) stands before and after each text.

Training counts of words and of byte strings grow with the corpus and reach the
documents by a join per part of the corpus. Only the tree's top, of at most
256**TOP contexts, is broadcast. Below it, all contexts that end with the same
``TOP + 1`` bytes are one task's work: at most 256**(DEPTH - TOP) counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffscope.llm.arrays import FOLD, byte_values, mix, prefix_hash, run_hash, words
from tariffscope.llm.common import body_bytes, remainder, slices, staged

#: Context bytes of the tree; at most 6, as contexts, the next byte and a mark are one 64-bit key.
DEPTH = 5
#: Context bytes of its broadcast top: at most 256**TOP rows of 255 nodes with three float32.
TOP = 2
END = 0xFF
#: Text bytes of one part of the corpus, whose words are looked up together.
PART_BYTES = 16 << 20
#: Distinct keys a task counts before it passes them on.
HELD = 300_000
#: Distinct byte strings a task counts before it passes them on.
HELD_STRINGS = 4_000_000
SMOOTHING = 0.1
WORD, BYTES = 0, 1
_NODES = 255


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps up; x > 0."""
    shift = np.zeros_like(x)
    for step in range(8):
        shift += np.log(x + step)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - shift


def log_kt(counts: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability for counts[..., 2]."""
    a, b = counts[..., 0], counts[..., 1]
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - math.log(math.pi)


def decisions(symbols: np.ndarray) -> np.ndarray:
    """Counts of bytes [..., 256] as counts of the 255 binary nodes [..., 255, 2], the first bit's node first."""
    made = np.empty((*symbols.shape[:-1], _NODES, 2))
    for bit in range(8):
        halves = symbols.reshape(*symbols.shape[:-1], 1 << bit, 2, -1).sum(-1)
        made[..., (1 << bit) - 1 : (2 << bit) - 1, :] = halves
    return made


def log_symbols(shares: np.ndarray) -> np.ndarray:
    """Log10 probability of each byte from the nodes' shares [..., 255, 3], if nothing deeper is known."""
    p = np.log10(shares[..., :2] + shares[..., 2:] / 2)
    logs = np.zeros((*p.shape[:-2], 1))
    for bit in range(8):
        pair = p[..., (1 << bit) - 1 : (2 << bit) - 1, :]
        logs = (logs[..., None] + pair).reshape(*p.shape[:-2], -1)
    return logs


def estimate(counts: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov probabilities of a 0 and a 1."""
    return (counts + 0.5) / (counts.sum(-1, keepdims=True) + 1.0)


def with_node(shares: np.ndarray, counts: np.ndarray, own: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Shares [..., 3] one depth further down: probabilities of a 0 and a 1 gathered so far, and the weight left for what is deeper."""
    gathered = shares[..., :2] + (shares[..., 2] * own)[..., None] * estimate(counts)
    return np.concatenate([gathered, (shares[..., 2] * rest)[..., None]], -1)


def mixed(own: np.ndarray, deeper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posterior weight of a node's own estimate, and its weighted log probability."""
    return 1 / (1 + np.exp(np.clip(deeper - own, -700, 700))), np.logaddexp(own, deeper) - math.log(2)


def triples(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys ``before-last byte, last byte, byte`` at every byte and end of each text, and where texts start in them."""
    documents = len(offsets) - 1
    start = offsets + 3 * np.arange(documents + 1)
    spread = np.full(len(data) + 3 * documents, END, np.uint32)
    where = np.ones(len(spread), bool)
    where[start[:-1]] = where[start[:-1] + 1] = where[start[1:] - 1] = False
    spread[where] = data
    keys = (spread[:-2] << np.uint32(16)) | (spread[1:-1] << np.uint32(8)) | spread[2:]
    real = np.ones(len(keys), bool)
    real[start[1:-1] - 1] = real[start[1:-1] - 2] = False
    return keys[real], offsets + np.arange(documents + 1)


def strings_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys ``last byte, ..., DEPTH-th last byte, byte`` at every byte and end of each text, and where texts start in them."""
    documents = len(offsets) - 1
    start = offsets + (DEPTH + 1) * np.arange(documents + 1)
    spread = np.full(len(data) + (DEPTH + 1) * documents, END, np.uint8)
    where = np.ones(len(spread), bool)
    where[start[1:] - 1] = False
    real = np.ones(len(spread) - DEPTH, bool)
    for back in range(DEPTH):
        where[start[:-1] + back] = False
        real[start[1:-1] - 1 - back] = False
    spread[where] = data
    padded = np.append(np.full(8 - DEPTH, END, np.uint8), spread)
    # The eight bytes before each place as one number, the last byte highest.
    before = np.ndarray(len(real), "<u8", padded, strides=(1,))
    keys = before >> np.uint64(8 * (8 - DEPTH))
    keys <<= np.uint64(8)
    keys |= padded[8:]
    return keys[real], offsets + np.arange(documents + 1)


def heads(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal ones starts in sorted keys."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


def distinct(keys: np.ndarray) -> np.ndarray:
    """Distinct keys, sorted; sorts ``keys`` in place, in a fifth of the time of ``np.unique``'s hash table."""
    keys.sort()
    return keys[heads(keys)]


def gathered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sorted, how often each occurs, and the order that sorts all."""
    order = np.argsort(keys).astype(np.int32)
    keys = keys[order]
    head = heads(keys)
    return keys[head], np.diff(np.append(head, len(keys))), order


def dealt_back(values: np.ndarray, n: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The value of each key where ``gathered`` found it."""
    made = np.empty(len(order), values.dtype)
    made[order] = np.repeat(values, n)
    return made


def shortened(keys: np.ndarray, depth: int) -> np.ndarray:
    """Keys with ``depth`` context bytes of keys with ``DEPTH``."""
    return (keys >> np.uint64(8 * (DEPTH + 1 - depth)) << np.uint64(8)) | (keys & np.uint64(255))


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that deals sorted keys to buckets by their last ``TOP + 1`` context bytes, and where each bucket starts in it."""
    bucket = mix(keys >> np.uint64(8 * (DEPTH - TOP))) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))


def packed(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte, the lowest bytes of all first; sorted ones compress well that way."""
    return numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()


def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their summed counts; empties ``held``, whose arrays are large."""
    keys, n = (np.concatenate(column) for column in zip(*held, strict=True))
    held.clear()
    order = np.argsort(keys).astype(np.int32)
    keys, n = keys[order], n[order]
    del order
    head = heads(keys)
    return keys[head], np.add.reduceat(n, head)


def flagged_counts(texts: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Distinct byte strings of some texts, sorted, and how often each occurs in those that aren't held out."""
    keys, first = strings_of(*body_bytes(texts.column("text")))
    training = ~texts.column("held_out").to_numpy(zero_copy_only=False)
    # A key has one free bit at least, so one sort serves strings and counts.
    keys <<= np.uint64(1)
    keys |= np.repeat(training.astype(np.uint64), np.diff(first))
    keys.sort()
    n = keys & np.uint64(1)
    keys >>= np.uint64(1)
    head = heads(keys)
    return keys[head], np.add.reduceat(n, head).astype(np.int64)


def part_counts(dealt: DataFrame, buckets: int) -> DataFrame:
    """``part, bucket, keys, n``: the byte strings of each part and their counts in its training texts, packed by bucket."""

    def count(texts: pa.Table) -> pa.Table:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in texts.to_batches():
            for run in slices(batch, "text"):
                held.append(flagged_counts(run))
                if sum(len(k) for k, _ in held) > HELD_STRINGS:
                    held = [summed(held)]
        keys, n = summed(held)
        order, bounds = by_bucket(keys, buckets)
        cuts = [(b, order[bounds[b] : bounds[b + 1]]) for b in np.flatnonzero(np.diff(bounds))]
        return pa.table({
            "part": pa.array([texts.column("part")[0].as_py()] * len(cuts), pa.int32()), "bucket": pa.array([b for b, _ in cuts], pa.int32()),
            "keys": pa.array([packed(keys[c]) for _, c in cuts], pa.binary()), "n": pa.array([packed(n[c]) for _, c in cuts], pa.binary()),
        })

    return dealt.select("part", "text", "held_out").groupBy("part").applyInArrow(count, "part int, bucket int, keys binary, n binary")


def string_counts(partial: DataFrame) -> DataFrame:
    """``bucket, keys, n``: one row per bucket with the byte strings of training texts and their counts, packed."""

    def together(table: pa.Table) -> pa.Table:
        pairs = zip(table.column("keys").to_pylist(), table.column("n").to_pylist(), strict=True)
        keys, n = summed([(unpacked(k), unpacked(c)) for k, c in pairs])
        keys, n = keys[n > 0], n[n > 0]
        made = pa.table({"bucket": table.column("bucket").slice(0, 1), "keys": pa.array([packed(keys)], pa.binary()), "n": pa.array([packed(n)], pa.binary())})
        return made.slice(0, min(len(n), 1))

    return partial.select("bucket", "keys", "n").groupBy("bucket").applyInArrow(together, "bucket int, keys binary, n binary")


def lower_tree(keys: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, dict[int, tuple], np.ndarray, np.ndarray]]:
    """For each bit of the next byte, the nodes below the top with counts: by depth their sorted ids, counts, own weight and the rest.

    An id is the context, last byte first, and the bits before. Also the ids at
    depth ``TOP`` that the nodes of the next depth belong to, and their weighted
    log probabilities. Without counts a node's probability is one half whatever
    its weight, so that it needs no entry.
    """
    levels = {DEPTH: (keys, n.astype(np.float64))}
    for depth in range(DEPTH - 1, TOP, -1):
        short, back = np.unique(shortened(keys, depth), return_inverse=True)
        levels[depth] = short, np.bincount(back, levels[DEPTH][1], len(short))
    for bit in range(8):
        nodes: dict[int, tuple] = {}
        above, weighted = keys[:0], np.zeros(0)
        for depth in range(DEPTH, TOP, -1):
            own_keys, own_n = levels[depth]
            cell = own_keys >> np.uint64(8 - bit)
            head = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            one = (own_keys >> np.uint64(7 - bit) & np.uint64(1)).astype(np.float64)
            counts = np.stack([np.add.reduceat(own_n * (1 - one), head), np.add.reduceat(own_n * one, head)], -1)
            cell, own = cell[head], log_kt(counts)
            if depth == DEPTH:
                nodes[depth] = cell, counts, np.ones(len(cell)), np.zeros(len(cell))
                weighted = own
            else:
                deeper = np.bincount(np.searchsorted(cell, above), weighted, len(cell))
                nodes[depth] = cell, counts, mixed(own, deeper)[0], mixed(deeper, own)[0]
                weighted = mixed(own, deeper)[1]
            above = (cell >> np.uint64(bit + 8) << np.uint64(bit)) | (cell & np.uint64((1 << bit) - 1))
        yield bit, nodes, above, weighted


def below_top(counts: DataFrame) -> DataFrame:
    """``last, before, node, weighted``: for each node of the deepest contexts of the top, the sum over their longer contexts."""

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for keys, n in zip(batch.column("keys").to_pylist(), batch.column("n").to_pylist(), strict=True):
                for bit, _, above, weighted in lower_tree(unpacked(keys), unpacked(n)):
                    cell, back = np.unique(above, return_inverse=True)
                    context = (cell >> np.uint64(bit)).astype(np.int64)
                    node = (1 << bit) - 1 + (cell & np.uint64((1 << bit) - 1)).astype(np.int64)
                    last = pa.array([bytes([c]) for c in context >> 8], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [last, pa.array(context & 255), pa.array(node), pa.array(np.bincount(back, weighted, len(cell)))],
                        names=["last", "before", "node", "weighted"],
                    )

    partial = counts.mapInArrow(work, "last binary, before long, node long, weighted double")
    return partial.groupBy("last", "before", "node").agg(F.sum("weighted").alias("weighted"))


def log_strings(wanted: np.ndarray, keys: np.ndarray, n: np.ndarray, rows: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Log10 probability of the last byte of each wanted key after the others; ``keys`` has the counts of its bucket."""
    context = (wanted >> np.uint64(8 * (DEPTH + 1 - TOP))).astype(np.int64)
    row = rows[(context & 255) * 256 + (context >> 8)]
    byte = (wanted & np.uint64(255)).astype(np.int64)
    logs = np.zeros(len(wanted))
    tree = lower_tree(keys, n) if len(keys) else ((bit, {}, None, None) for bit in range(8))
    for bit, nodes, _, _ in tree:
        shares = top[row, (1 << bit) - 1 + (byte >> (8 - bit))].astype(np.float64)
        for depth in sorted(nodes):
            cell, counts, own, rest = nodes[depth]
            own_cell = shortened(wanted, depth) >> np.uint64(8 - bit)
            at = np.minimum(np.searchsorted(cell, own_cell), len(cell) - 1)
            hit = np.flatnonzero(cell[at] == own_cell)
            at = at[hit]
            shares[hit] = with_node(shares[hit], counts[at], own[at], rest[at])
        p = shares[:, :2] + shares[:, 2:] / 2
        logs += np.log10(np.where(byte >> (7 - bit) & 1, p[:, 1], p[:, 0]))
    return logs


Words = tuple[np.ndarray, np.ndarray, pa.Array]


def words_of(column: pa.Array) -> list[Words]:
    """Hashes, counts and lower-cased spelling of the distinct words of some texts, and the same of the ends (the empty word)."""
    data, offsets = body_bytes(column)
    found = words(data, offsets, fold=True)
    own, n, order = gathered(found.hash)
    ends = np.zeros(1, np.uint64), np.array([len(column)]), pa.array([b""], pa.binary())
    if not len(own):
        return [ends]
    edges = np.stack([found.start, found.stop], -1).astype(np.int32).ravel()
    # Every second value is a word, the others are what stands between two.
    values = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(FOLD[data])])
    return [ends, (own, n, values.take(pa.array(2 * order[np.cumsum(n) - n].astype(np.int64))))]


def summed_words(held: list[Words]) -> Words:
    """Distinct words of several tables of them, and their summed counts."""
    hashes, times, order = gathered(np.concatenate([h for h, _, _ in held]))
    first = np.cumsum(times) - times
    n = np.add.reduceat(np.concatenate([n for _, n, _ in held])[order], first)
    return hashes, n, pa.concat_arrays([w for _, _, w in held]).take(pa.array(order[first]))


class Known:
    """Log10 probabilities of words by the hash of the word (0: the end), from a table of ``key`` and ``c``."""

    def __init__(self, table: pa.Table, floor: float) -> None:
        self.unknown = math.log10(SMOOTHING / floor)
        hashes, logs = [np.zeros(0, np.uint64)], [np.zeros(0)]
        for batch in table.select(["key", "c"]).to_batches():
            for run in slices(batch, "key"):
                data, offsets = body_bytes(run.column("key"))
                hashes.append(run_hash(prefix_hash(byte_values(data)), offsets[:-1], offsets[1:]))
                logs.append(np.log10((run.column("c").to_numpy() + SMOOTHING) / floor))
        hashed, order = np.concatenate(hashes), np.argsort(np.concatenate(hashes))
        self.hashes, self.logs = hashed[order], np.concatenate(logs)[order]

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logs of words, and which words are known."""
        if not len(self.hashes):
            return np.full(len(hashes), self.unknown), np.zeros(len(hashes), bool)
        own, n, order = gathered(hashes)
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        hit = self.hashes[at] == own
        return dealt_back(np.where(hit, self.logs[at], self.unknown), n, order), dealt_back(hit, n, order)

    def base(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, known tokens and the sum of logs of each text, with the end that each has."""
        found, texts = words(data, offsets, fold=True), len(offsets) - 1
        logs, hit = self.of(found.hash)
        end, end_known = self.of(np.zeros(1, np.uint64))
        known = np.bincount(found.doc[hit], minlength=texts) + int(end_known[0])
        return np.diff(found.first) + 1, known, np.bincount(found.doc, logs, texts) + end[0]


def corpus_counts(docs: DataFrame) -> DataFrame:
    """``kind, key, n`` over training texts: words and the end mark (empty key), and byte strings with their contexts."""

    def word_rows(held: list[Words]) -> pa.RecordBatch:
        _, n, keys = summed_words(held)
        kinds = np.full(len(n), WORD, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(kinds), keys, pa.array(n)], names=["kind", "key", "n"])

    def byte_rows(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        seen, n = summed(held)
        keys = seen.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()
        keys = pa.Array.from_buffers(pa.binary(3), len(seen), [None, pa.py_buffer(keys)]).cast(pa.binary())
        kinds = np.full(len(seen), BYTES, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(kinds), keys, pa.array(n)], names=["kind", "key", "n"])

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Words] = []
        strings: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in source:
            for run in slices(batch, "text"):
                column = run.column("text")
                held.extend(words_of(column))
                strings.append(np.unique(triples(*body_bytes(column))[0], return_counts=True))
                if sum(len(k) for k, _ in strings) > 2 * HELD:
                    strings = [summed(strings)]
                    if len(strings[0][0]) > HELD:
                        yield byte_rows(strings)
                if sum(len(h) for h, _, _ in held) > 2 * HELD:
                    held = [summed_words(held)]
                    if len(held[0][0]) > HELD:
                        yield word_rows(held)
                        held = []
        if held:
            yield word_rows(held)
        if strings:
            yield byte_rows(strings)

    training = docs.filter(~F.col("held_out")).select("text")
    partial = training.mapInArrow(count, "kind int, key binary, n long")
    return partial.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _grouped(table: pa.Table) -> tuple[int, np.ndarray]:
    """Last context byte of a group of byte strings, and counts [before-last byte, byte]."""
    keys = np.frombuffer(b"".join(table.column("key").to_pylist()), np.uint8).reshape(-1, 3)
    counts = np.zeros((256, 256))
    np.add.at(counts, (keys[:, 0], keys[:, 2]), table.column("n").to_numpy())
    return int(keys[0, 1]), counts


def top_model(counts: DataFrame, deeper: DataFrame | None) -> tuple[np.ndarray, np.ndarray]:
    """Row of each context of ``TOP`` bytes, and rows of the 255 nodes' shares down to there.

    ``deeper`` has the sums over longer contexts; without it the tree ends here.
    Each group of contexts with the same last byte (at most 65,536 counts) is
    one task's work; the root mixes 255 sums over at most 256 groups.
    """
    ends = deeper is None
    if deeper is None:
        deeper = counts.sparkSession.createDataFrame([], "last binary, before long, node long, weighted double")
    grouped = counts.filter(F.col("kind") == BYTES).groupBy(F.substring("key", 2, 1).alias("last")).cogroup(deeper.groupBy("last"))

    def nodes_of(table: pa.Table, below: pa.Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        last, found = _grouped(table)
        sums = np.zeros((256, _NODES))
        sums[below.column("before").to_numpy(), below.column("node").to_numpy()] = below.column("weighted").to_numpy()
        nodes = decisions(found)
        own = log_kt(nodes)
        return last, found, nodes, own, sums

    def weigh(table: pa.Table, below: pa.Table) -> pa.Table:
        _, found, _, deepest, sums = nodes_of(table, below)
        own = decisions(found.sum(0))
        under = (deepest if ends else mixed(deepest, sums)[1]).sum(0)
        return pa.table({"node": np.arange(_NODES), "zeros": own[:, 0], "ones": own[:, 1], "weighted": mixed(log_kt(own), under)[1]})

    sums = grouped.applyInArrow(weigh, "node long, zeros double, ones double, weighted double")
    root_rows = sums.groupBy("node").agg(F.sum("zeros"), F.sum("ones"), F.sum("weighted")).collect()
    root = np.zeros((_NODES, 3))
    for row in root_rows:
        root[row[0]] = row[1:]
    root_own = log_kt(root[:, :2])
    start = np.broadcast_to(np.array([0.0, 0.0, 1.0]), (_NODES, 3))
    at_root = with_node(start, root[:, :2], mixed(root_own, root[:, 2])[0], mixed(root[:, 2], root_own)[0])

    def predict(table: pa.Table, below: pa.Table) -> pa.Table:
        last, found, nodes, deepest, sums = nodes_of(table, below)
        own = decisions(found.sum(0))
        log_own, under = log_kt(own), (deepest if ends else mixed(deepest, sums)[1]).sum(0)
        short = with_node(at_root, own, mixed(log_own, under)[0], mixed(under, log_own)[0])
        seen = np.flatnonzero(found.sum(1))
        weight = np.ones((len(seen), _NODES)) if ends else mixed(deepest[seen], sums[seen])[0]
        rest = 0 * weight if ends else mixed(sums[seen], deepest[seen])[0]
        full = with_node(np.broadcast_to(short, (len(seen), _NODES, 3)), nodes[seen], weight, rest)
        shares = [*full, short]
        context = np.concatenate([seen * 256 + last, [-1 - last]])
        return pa.table({"context": context, "shares": pa.array([row.astype("<f4").tobytes() for row in shares], pa.binary())})

    predicted = grouped.applyInArrow(predict, "context long, shares binary").collect()
    table = [at_root.astype("<f4"), *(np.frombuffer(r["shares"], "<f4").reshape(_NODES, 3) for r in predicted)]
    rows = np.zeros((256, 256), np.int32)
    for number, row in enumerate(predicted, 1):
        if row["context"] < 0:
            rows[:, -1 - row["context"]] = number
    for number, row in enumerate(predicted, 1):
        if row["context"] >= 0:
            rows[row["context"] // 256, row["context"] % 256] = number
    return rows.reshape(-1), np.stack(table)


def byte_model(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The tree that ends at its top: row of each two-byte context, and rows of log10 probabilities of the next byte."""
    rows, shares = top_model(counts, None)
    return rows, log_symbols(shares.astype(np.float64)).astype("<f4")


def part_strings(texts: pa.Table) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """Distinct byte strings of a part, sorted, and for each run of texts its own, their counts and order, and where texts start."""
    runs = []
    for batch in texts.to_batches():
        for run in slices(batch, "text"):
            keys, first = strings_of(*body_bytes(run.column("text")))
            own, n, order = gathered(keys)
            runs.append((own, n.astype(np.int32), order, first))
    return distinct(np.concatenate([own for own, *_ in runs])), runs


def part_of(parts: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")


def score(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per input row: held_out, tokens, known tokens, training tokens, base and model scores.

    A null text counts as empty: one token, the end. A null id counts as empty
    text when the training rows are chosen. Repeated rows are counted and scored
    one by one, extra columns are ignored, an empty table gives an empty result.
    Without training texts every word is unknown and all bytes are equally
    likely. Texts are scored whole.
    """
    given = docs.select(
        "doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
        (remainder(F.col("doc_id"), 10) == 0).alias("held_out"),
    )
    counts = staged(corpus_counts(given), "corpus-counts")
    known = counts.filter((F.col("kind") == WORD) & (F.col("n") > 0)).select("key", F.col("n").alias("c"))
    size = given.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    total = known.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    tokens, distinct_words = total["n"] or 0, total["v"]
    parts = buckets = max(1, -(-size // part_bytes))
    dealt = given.withColumn("part", part_of(parts)).repartition(parts, "part")
    partial = staged(part_counts(dealt, buckets), "part-counts")
    strings = staged(string_counts(partial), "string-counts")
    model = docs.sparkSession.sparkContext.broadcast(top_model(counts, below_top(strings)))

    def vocabulary(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Words]] = {}
        for batch in source:
            for part in batch.column("part").unique().to_pylist():
                for run in slices(batch.filter(pc.equal(batch.column("part"), part)), "text"):
                    held.setdefault(part, []).extend(words_of(run.column("text")))
            if sum(len(h) for own in held.values() for h, _, _ in own) > 4 * HELD:
                held = {part: [summed_words(own)] for part, own in held.items()}
                if sum(len(own[0][0]) for own in held.values()) > 2 * HELD:
                    yield from _pairs(held)
                    held = {}
        yield from _pairs(held)

    wanted = dealt.mapInArrow(vocabulary, "part int, key binary")
    found = wanted.join(known, "key").select("part", "key", "c")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = [unpacked(k) for k in left.column("keys").to_pylist()]
        wanted = np.unique(np.concatenate(asked)) if asked else np.zeros(0, np.uint64)
        found = [unpacked(right.column(c)[0].as_py()) if len(right) else np.zeros(0, np.uint64) for c in ("keys", "n")]
        logs = log_strings(wanted, *found, *model.value).astype("<f4")
        given_back = pa.array([logs[np.searchsorted(wanted, k)].tobytes() for k in asked], pa.binary())
        return pa.table({"part": left.column("part"), "bucket": left.column("bucket"), "logs": given_back})

    answers = partial.select("part", "bucket", "keys").groupBy("bucket").cogroup(strings.groupBy("bucket")).applyInArrow(answer, "part int, bucket int, logs binary")
    found = found.unionByName(answers, allowMissingColumns=True)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        strings_right = right.filter(pc.is_valid(right.column("logs"))).sort_by("bucket")
        known_words = Known(right.filter(pc.is_valid(right.column("key"))), tokens + SMOOTHING * (distinct_words + 1))
        base = [known_words.base(*body_bytes(run.column("text"))) for batch in left.to_batches() for run in slices(batch, "text")]
        n_tokens, n_known, base_score = (np.concatenate(column) for column in zip(*base, strict=True))
        keys, runs = part_strings(left)
        logs = np.zeros(len(keys))
        logs[by_bucket(keys, buckets)[0]] = np.frombuffer(b"".join(strings_right.column("logs").to_pylist()), "<f4")
        sums = [np.add.reduceat(dealt_back(logs[np.searchsorted(keys, own)], n, order), first[:-1]) for own, n, order, first in runs]
        return pa.table({
            "doc_id": left.column("doc_id"), "held_out": left.column("held_out"),
            "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
            "train_tokens": pa.array([tokens] * len(left), pa.int64()),
            "base_score": pa.array(base_score, pa.float64()), "score": pa.array(np.concatenate(sums), pa.float64()),
        })

    kind = given.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(
        finish,
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )


def _pairs(held: dict[int, list[Words]]) -> Iterator[pa.RecordBatch]:
    for part, own in held.items():
        keys = summed_words(own)[2]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), part, np.int32)), keys], names=["part", "key"])
