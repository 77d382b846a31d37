"""Near copies by b-bit MinHash: packed low bits of minima, bands, clusters, confirmed links.

1. Texts with equal shingle sets form a class; only classes go on. A class keeps
   ``BANDS * ROWS`` minima of its set as ``BITS`` low bits each, packed into words,
   and one key per band, a hash of the band's whole minima.
2. Classes with a band key in common form a bucket. Within it the packed signatures
   are compared by counting equal bit fields; the least count that passes allows
   for fields that agree by chance, as ``estimate`` does. A bucket hands on the links
   of a spanning forest, at most one for each member, not its pairs. Buckets of the
   same members are looked at once.
3. What these connect is a cluster; every pair that shares a bucket and passes the
   estimate lies within one. Each cluster's full sets meet once, and pairs of them
   that pass the estimate are confirmed on the sets. Again a forest is handed on.
4. All links give the components.

Buckets and clusters above a size are dealt over tasks as pairs of parts, so no
task gets more than two parts whatever the group, and no pair is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffscope.llm.arrays import mix, prefix_hash, run_hash, words
from tariffscope.llm.common import body_bytes, flagged, slices, staged
from tariffscope.llm.graph import components

SHINGLE = 3
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: A pair at the limit shares no band with probability (1 - 0.85 ** ROWS) ** BANDS = 1.4e-10.
BANDS, ROWS = 48, 6
#: Low bits kept of each minimum.
BITS = 4
#: Chance that a pair at the limit fails the estimate.
MISS = 1e-10
#: Signatures of a bucket, and shingles of a cluster, that make one part.
BUCKET_PART, CLUSTER_PART = 8192, 1 << 21

#: Signatures that are compared in one go.
TOGETHER = 1 << 16

MINIMA = BANDS * ROWS
_WORDS = MINIMA * BITS // 64
_ONES = np.uint64(0x1111111111111111)
_SECOND = np.uint64(0x5851F42D4C957F2D)
_DRAW = np.random.default_rng(11).integers(1, 1 << 63, MINIMA, dtype=np.uint64) | np.uint64(1)


def shingle_sets(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and where each begins."""
    data, offsets = body_bytes(bodies)
    w = words(data, offsets, fold=True)
    n = np.diff(w.first)
    each = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), each)
    start = w.first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    hashes = run_hash(prefix_hash(w.hash), start, np.minimum(start + SHINGLE, w.first[doc + 1]))
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.searchsorted(doc[new], np.arange(len(n) + 1))


def set_hash(hashes: np.ndarray, first: np.ndarray, salt: np.uint64) -> np.ndarray:
    """Hash of each set as a signed 64-bit number; of an empty set 0."""
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ salt))))
    return mix(sums[first[1:]] - sums[first[:-1]]).view(np.int64)


def minima(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``MINIMA`` rows of each set's least value under as many multiplicative hashes; sets must not be empty."""
    found = np.empty((MINIMA, len(first) - 1), np.uint64)
    for row, factor in zip(found, _DRAW, strict=True):
        np.minimum.reduceat(hashes * factor, first[:-1], out=row)
    return mix(found)


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of each set's minima, packed into 64-bit words: one row per set."""
    low = (least & np.uint64((1 << BITS) - 1)).T.reshape(least.shape[1], _WORDS, -1)
    return np.bitwise_or.reduce(low << (np.arange(low.shape[2], dtype=np.uint64) * np.uint64(BITS)), axis=2)


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key per band and set, made of the band's whole minima."""
    rows = least.reshape(BANDS, ROWS, -1)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64)[:, None], rows.shape[::2])
    for step in range(ROWS):
        keys = mix(keys * np.uint64(31) ^ rows[:, step])
    return keys.view(np.int64)


def agreements(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many bit fields signatures share (their words are the last axis), by counting bits of what differs."""
    differ = one ^ others
    differ |= differ >> np.uint64(2)
    differ |= differ >> np.uint64(1)
    return MINIMA - np.bitwise_count(differ & _ONES).sum(-1, dtype=np.int64)


def estimate(agree: np.ndarray) -> np.ndarray:
    """Similarity from the share of equal fields, corrected for those that agree by chance, 2 ** -BITS of the others."""
    return (agree / MINIMA - 2.0**-BITS) / (1 - 2.0**-BITS)


def least_fields() -> int:
    """Equal fields of which a pair at the limit has fewer with a chance of at most ``MISS``."""
    p = PERCENT / 100
    p += (1 - p) * 2.0**-BITS
    below, fields = 0.0, 0
    while (below := below + math.comb(MINIMA, fields) * p**fields * (1 - p) ** (MINIMA - fields)) <= MISS:
        fields += 1
    return fields


LEAST_FIELDS = least_fields()


def enough(overlap: np.ndarray, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
    """100 * overlap >= PERCENT * union, for sets of sizes a and b."""
    return (100 + PERCENT) * overlap >= PERCENT * (a + b)


def describe(docs: DataFrame) -> DataFrame:
    """``doc_id, key, n, class, check, bands, signature`` of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for run in slices(batch, "body"):
                hashes, first = shingle_sets(run.column("body"))
                filled = np.flatnonzero(np.diff(first))
                least = minima(hashes, np.append(first[filled], len(hashes))) if len(filled) else np.zeros((MINIMA, 0), np.uint64)
                blobs: dict[str, list[bytes | None]] = {"bands": [None] * run.num_rows, "signature": [None] * run.num_rows}
                for name, rows in (("bands", band_keys(least).T), ("signature", packed(least))):
                    for k, row in zip(filled, np.ascontiguousarray(rows), strict=True):
                        blobs[name][k] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [run.column("doc_id"), run.column("key"), pa.array(np.diff(first)),
                     pa.array(set_hash(hashes, first, np.uint64(0))), pa.array(set_hash(hashes, first, _SECOND)),
                     *(pa.array(blobs[name], pa.binary()) for name in ("bands", "signature"))],
                    names=["doc_id", "key", "n", "class", "check", "bands", "signature"],
                )

    return docs.select("doc_id", "key", "body").mapInArrow(
        work, f"doc_id {kind}, key long, n long, class long, check long, bands binary, signature binary"
    )


def band_rows(classes: DataFrame) -> DataFrame:
    """``key, class``: one row for each class and band."""

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column("class").to_numpy(), BANDS))], names=["key", "class"])

    return classes.select("class", "bands").mapInArrow(work, "key long, class long")


def in_parts(members: DataFrame, group: str, parts: Column) -> DataFrame:
    """Members with ``left, right, side``: their group's one part, or every pair of parts that holds theirs."""
    own = F.pmod(F.xxhash64("class"), parts)
    other = F.sequence(F.lit(0).cast("long"), parts - 1)
    pairs = F.transform(
        other, lambda x: F.struct(F.least(own, x).alias("left"), F.greatest(own, x).alias("right"), own.alias("side"))
    )
    return members.select(F.col(group).alias("group"), "class", "n", "payload", F.inline(pairs))


class Signatures:
    """Members of one group, the smallest set first, compared by their packed signatures."""

    def __init__(self, sizes: np.ndarray, payloads: list[bytes]):
        self.sizes = sizes
        self.rows = self.signatures(payloads)

    def signatures(self, payloads: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(payloads), np.uint64).reshape(-1, _WORDS)

    def passing(self, of: np.ndarray) -> np.ndarray:
        """For each of some members, which ones pass the estimate and the bound on sizes."""
        fits = 100 * np.minimum(self.sizes, self.sizes[of, None]) >= PERCENT * np.maximum(self.sizes, self.sizes[of, None])
        return fits & (agreements(self.rows[of, None], self.rows) >= LEAST_FIELDS)

    def confirmed(self, q: int, at: np.ndarray) -> np.ndarray:
        """Those of the passing ``at`` that count as linked with member ``q``."""
        return at


class Sets(Signatures):
    """The same with payloads that are full sets, on which links are confirmed."""

    def signatures(self, payloads: list[bytes]) -> np.ndarray:
        self.first = np.concatenate(([0], np.cumsum(self.sizes)))
        hashes = np.concatenate([np.frombuffer(p, np.uint64) for p in payloads])
        self.ids = np.unique(hashes, return_inverse=True)[1]
        self.marked = np.zeros(self.ids.max() + 1, bool)
        return packed(minima(hashes, self.first))

    def confirmed(self, q: int, at: np.ndarray) -> np.ndarray:
        own = self.ids[self.first[q] : self.first[q + 1]]
        each = self.sizes[at]
        begin = np.cumsum(each) - each
        places = np.repeat(self.first[at] - begin, each) + np.arange(each.sum())
        self.marked[own] = True
        overlap = np.add.reduceat(self.marked[self.ids[places]], begin, dtype=np.int64)
        self.marked[own] = False
        return at[enough(overlap, self.sizes[q], each)]


def forest(group: Signatures, side: np.ndarray | None) -> list[np.ndarray]:
    """Links as pairs of positions that connect a group's members wherever linked ones are; with ``side``, only across."""
    size = len(group.sizes)
    label = np.arange(size)
    unseen = np.ones(size, bool)
    hub = size // 2
    unseen[hub] = False
    at = np.flatnonzero(group.passing(np.array([hub]))[0] & unseen)
    at = group.confirmed(hub, at) if len(at) else at
    links = [np.stack([np.full(len(at), hub), at])]
    label[at] = hub
    # Pairs that the hub connects need no look; all others have a member that it doesn't.
    rest = np.flatnonzero(label != hub)
    step = max(1, TOGETHER // size)
    for start in range(0, len(rest) if size > 2 else 0, step):
        block = rest[start : start + step]
        for q, row in zip(block, group.passing(block), strict=True):
            unseen[q] = False
            at = np.flatnonzero(row & unseen & (label != label[q]))
            at = at if side is None else at[side[at] != side[q]]
            at = group.confirmed(q, at) if len(at) else at
            for to in at[np.unique(label[at], return_index=True)[1]] if len(at) else ():
                links.append(np.array([[q], [to]]))
                label[label == label[to]] = label[q]
    return links


def forests(members: DataFrame, kind: type[Signatures]) -> DataFrame:
    """``u, v``: links that connect the members of each group wherever those of ``kind`` do; at most one for each member."""

    def of(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        n, side, own, left, right = (table.column(c).to_numpy() for c in ("n", "side", "class", "left", "right"))
        payloads = table.column("payload").to_pylist()
        links = [np.zeros((2, 0), np.int64)]
        for start, stop in zip(starts[:-1], starts[1:], strict=True):
            if stop - start > 1:
                group = kind(n[start:stop], payloads[start:stop])
                across = side[start:stop] if left[start] != right[start] else None
                links += [own[start + pairs] for pairs in forest(group, across)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(links, 1)], names=["u", "v"])

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in source:
            table = pa.Table.from_batches([*held, batch])
            keys = np.stack([table.column(c).to_numpy() for c in ("group", "left", "right")])
            starts = np.append(0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1)
            if starts[-1]:
                yield of(table.slice(0, starts[-1]), starts)
            held = table.slice(starts[-1]).to_batches()
        if held:
            table = pa.Table.from_batches(held)
            yield of(table, np.array([0, table.num_rows]))

    block = ["group", "left", "right"]
    return members.repartition(*block).sortWithinPartitions(*block, "n", "class").mapInArrow(work, "u long, v long").distinct()


def clusters(classes: DataFrame) -> DataFrame:
    """``class, cluster`` of the classes that share a band with one they may be linked to."""
    rows = band_rows(classes)
    print_of = [F.bit_xor(F.xxhash64("class")).alias("x"), F.sum(F.hash("class").cast("long")).alias("s"), F.min("class").alias("low")]
    shared = rows.groupBy("key").agg(F.count("*").alias("members"), *print_of).filter("members > 1")
    shared = staged(shared.groupBy("members", "x", "s", "low").agg(F.min("key").alias("key")).select("key", "members"), "buckets")
    members = flagged(rows, shared.select("key")).filter("maybe").join(shared, "key")
    given = members.join(classes.select("class", "n", F.col("signature").alias("payload")), "class")
    parts = F.ceil(F.col("members") / BUCKET_PART)
    links = staged(forests(in_parts(given, "key", parts), Signatures), "candidates")
    found = components(links)
    names = found.select(F.col("u").alias("class"), F.col("v").alias("cluster"))
    return staged(names.union(found.select("v", "v").distinct()), "clusters")


def with_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (with ``key``) and the set of each, its sorted hashes as ``payload``."""
    names = wanted.columns
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema)

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for run in slices(batch, "body"):
                hashes, first = shingle_sets(run.column("body"))
                blobs = [hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(run.column(c) for c in names), pa.array(blobs, pa.binary())], names=[*names, "payload"])

    # Rows of one id and text have one key: any of them will do, and one of each task is enough.
    chosen = flagged(docs.select("key", "body"), wanted.select("key")).filter("maybe").groupBy("key").agg(F.first("body").alias("body"))
    return chosen.join(wanted, "key").select(*names, "body").mapInArrow(work, f"{fields}, payload binary")


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``u, v``: confirmed links that connect each component of similar classes."""
    named = clusters(classes).join(classes.select("class", "key", "n"), "class")
    sizes = named.groupBy("cluster").agg(F.ceil(F.sum("n") / CLUSTER_PART).alias("parts"))
    given = with_sets(docs, staged(named.join(sizes, "cluster"), "wanted"))
    return staged(forests(in_parts(given, "cluster", F.col("parts")), Sets), "links")


def near_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every input row.

    Null texts and texts without words have no shingles and are linked with
    nothing; texts of fewer than three words are one shingle. Equal sets are one
    class, so repeated rows and ties cost nothing more. The smallest id of a
    component names it, and rows of that id are kept; a null id names only a
    component without others, whose rows are all kept. Extra columns are ignored;
    an empty table gives an empty result. A clash of two sets' 64-bit hashes is
    found by a second hash and stops the job.
    """
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    given = docs.select("doc_id", body.alias("body"), F.xxhash64("doc_id", body).alias("key"))
    rows = staged(describe(given), "signatures")
    same = F.assert_true(F.min("check") == F.max("check"), F.lit("two shingle sets have one hash"))
    described = F.min(F.struct("key", "n", "bands", "signature")).alias("least")
    classes = rows.filter("n > 0").groupBy("class").agg(described, same.alias("same")).filter("same IS NULL")
    classes = staged(classes.select("class", "least.*"), "classes")
    found = components(links(given, classes))

    rooted = rows.join(found.select(F.col("u").alias("class"), F.col("v").alias("root")), "class", "left")
    rooted = rooted.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "class").alias("root"))
    least = rooted.filter("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    named = rooted.join(least, "root", "left")
    name = F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id"))
    return named.select("doc_id", "n_shingles", name.alias("component_id"), F.col("doc_id").eqNullSafe(name).alias("kept"))
