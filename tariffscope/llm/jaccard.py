"""Near copies by Jaccard similarity of word shingles, with a count-vector R-tree.

1. Texts with equal shingle sets form a class; only classes go on.
2. Two sets of similarity t share a shingle among the first ``n - ceil(t n) + 1``
   of each in any common order. Common shingles (seen by a fixed-size sketch)
   stand last in that order. Classes with a first shingle in common form a block;
   blocks of the same members are looked at once, at their first shingle.
3. Shingles are hashed into groups and each class is a point of group counts, with
   groups in proportion to the set: a power of two, folded down for a smaller partner. In
   every block an R-tree over the points bounds the overlap of two classes by
   ``sum(min(count, count))``; before that, the places of the block's shingle in both
   orders bound it by what stands behind it, which is exact for the first shingle that
   two sets share. A block hands on a spanning forest of the pairs that pass, at
   most one link for each member, not the pairs.
4. What these connect is a cluster; every pair that passes lies within one. Each
   cluster's sets meet once, and pairs that an R-tree over them leaves, of members not
   connected yet, are verified on the sets. Again a forest is handed on.
5. All links give the components.

Blocks and clusters above a size are dealt over tasks as pairs of parts, so no task
gets more than two parts whatever the group, and no pair is left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffscope.llm.arrays import mix, prefix_hash, run_hash, words
from tariffscope.llm.bbit import forests, in_parts
from tariffscope.llm.common import body_bytes, flagged, slices, staged
from tariffscope.llm.graph import components

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Counters of the sketch of common shingles: bounds what reaches the driver and is broadcast.
COUNTERS = 1 << 21
#: Tasks that add up sketches before the last one.
ADDERS = 16
#: Tasks that share the rows of one common shingle.
SALTS = 64
#: Least coordinates of a point (a power of two), and shingles for each coordinate that more are taken for.
GROUPS, FILL = 256, 4
#: Points of a leaf, and nodes of a node above.
LEAF = 16
#: Coordinates of a block's points, and shingles of a cluster, that make one part.
PART, CLUSTER_PART = 1 << 21, 1 << 21
#: Coordinates that are compared in one go.
TOGETHER = 1 << 22
#: A first shingle's ``place`` is its level times this, plus its rank.
RANKS = 1 << 40

_SECOND = np.uint64(0x5851F42D4C957F2D)


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


def prefix_order(hashes: np.ndarray, first: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of each set's first shingles in the common order (rare first), their sets and their ranks."""
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes.view(np.int64), rarity[hashes % np.uint64(COUNTERS)], doc))
    rank = np.arange(len(doc)) - first[doc]
    chosen = rank <= n[doc] * (100 - PERCENT) // 100
    return order[chosen], doc[chosen], rank[chosen]


def bits_of(n: np.ndarray) -> np.ndarray:
    """Logarithm of the coordinates of a set of each size: at most ``FILL`` shingles for one."""
    least = GROUPS.bit_length() - 1
    return np.maximum(least, np.ceil(np.log2(np.maximum(n, 1) / FILL))).astype(np.int64)


def counted(hashes: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Group counts of each set."""
    bits = bits_of(np.diff(first))
    return [
        np.bincount((hashes[a:b] >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k)
        for a, b, k in zip(first[:-1], first[1:], bits.tolist(), strict=True)
    ]


def points_of(hashes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Group counts of each set, in one byte each, or in four where a count needs more."""
    return [c.astype(np.uint8 if c.max() < 256 else "<u4").tobytes() for c in counted(hashes, first)]


def unpacked(points: list[bytes], sizes: np.ndarray) -> list[np.ndarray]:
    return [np.frombuffer(p, np.uint8 if len(p) == 1 << k else "<u4") for p, k in zip(points, bits_of(sizes).tolist(), strict=True)]


def describe(docs: DataFrame) -> DataFrame:
    """``key, n, class, check, point`` of every row, and one row per task with its ``sketch`` of shingle counts."""
    given = docs.select(F.col("key"), F.col("doc_id"), F.col("body"))
    kind = given.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "key", "n", "class", "check", "point", "sketch"]

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        id_type = None
        for batch in source:
            id_type = batch.schema.field("doc_id").type
            for run in slices(batch, "body"):
                hashes, first = shingle_sets(run.column("body"))
                counts += np.bincount(hashes % np.uint64(COUNTERS), minlength=COUNTERS)
                yield pa.RecordBatch.from_arrays(
                    [run.column("doc_id"), run.column("key"), pa.array(np.diff(first)),
                     pa.array(set_hash(hashes, first, np.uint64(0))), pa.array(set_hash(hashes, first, _SECOND)),
                     pa.array(points_of(hashes, first), pa.binary()), pa.nulls(run.num_rows, pa.binary())],
                    names=names,
                )
        if id_type is not None:
            none = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), none, none, none, none, pa.nulls(1, pa.binary()), pa.array([_shrunk(counts)])], names=names)

    return given.mapInArrow(work, f"doc_id {kind}, key long, n long, class long, check long, point binary, sketch binary")


def _shrunk(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.tobytes(), 1)


def _grown(sketch: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(sketch), np.int64)


def rarity_levels(sketches: DataFrame) -> np.ndarray:
    """Level of each counter: 0 for what chance alone may count, more for what is common."""

    def add(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in source:
            for sketch in batch.column("sketch").to_pylist():
                total += _grown(sketch)
        yield pa.RecordBatch.from_arrays([pa.array([_shrunk(total)])], names=["sketch"])

    partial = sketches.select("sketch").repartition(ADDERS).mapInArrow(add, "sketch binary")
    total = _grown(partial.coalesce(1).mapInArrow(add, "sketch binary").first()["sketch"])
    chance = total.mean() + 4 * np.sqrt(total.mean()) + 2
    return np.where(total > chance, np.ceil(4 * np.log2(np.maximum(total, 1))), 0).astype(np.uint8)


def tokens(docs: DataFrame, rarity: np.ndarray) -> DataFrame:
    """``token, salt, class, place``: the first shingles of each class, once per task. Salts split common shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity)

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = shared.value
        seen = np.zeros(0, np.int64)
        for batch in source:
            for run in slices(batch, "body"):
                hashes, first = shingle_sets(run.column("body"))
                classes = set_hash(hashes, first, np.uint64(0))
                _, at = np.unique(classes, return_index=True)
                at = at[(np.diff(first)[at] > 0) & ~np.isin(classes[at], seen)]
                seen = np.union1d(seen, classes[at])
                fresh = np.zeros(len(classes), bool)
                fresh[at] = True
                where, doc, rank = prefix_order(hashes, first, rarity)
                where, doc, rank = where[fresh[doc]], doc[fresh[doc]], rank[fresh[doc]]
                token, own = hashes[where], classes[doc]
                level = rarity[token % np.uint64(COUNTERS)].astype(np.int64)
                salt = np.where(level > 0, own % SALTS, -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(own), pa.array(level * RANKS + rank)],
                    names=["token", "salt", "class", "place"],
                )

    return docs.select("body").mapInArrow(work, "token long, salt int, class long, place long")


def shared_tokens(rows: DataFrame) -> DataFrame:
    """``token, class, place``: members of (token, salt) groups that aren't alone; of salted groups all."""
    columns = ("token", "salt", "class", "place")

    def some(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, c])) for c in (0, 2, 3)], names=["token", "class", "place"])

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = np.zeros((0, 4), np.int64)  # the last row, while its group may go on
        follows = False  # it isn't its group's first
        for batch in source:
            rows = np.concatenate([waiting, np.stack([batch.column(c).to_numpy() for c in columns], 1)])
            if not len(rows):
                continue
            rows = rows[np.append(True, (rows[1:] != rows[:-1]).any(1))]
            new = np.append(not follows, (rows[1:, :2] != rows[:-1, :2]).any(1))
            alone = new[:-1] & new[1:] & (rows[:-1, 1] < 0)
            yield some(rows[:-1][~alone])
            waiting, follows = rows[-1:], not new[-1]
        yield some(waiting[follows | (waiting[:, 1] >= 0)])

    dealt = rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "class")
    return dealt.mapInArrow(work, "token long, class long, place long")


def enough(overlap: np.ndarray, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
    """100 * overlap >= PERCENT * union, for sets of sizes a and b."""
    return (100 + PERCENT) * overlap >= PERCENT * (a + b)


def tiled(points: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Leaves of the points ``at``: halved at the coordinate of the widest spread until they fit one."""
    if len(at) <= LEAF:
        return [at]
    own = points[at]
    along = own[:, np.argmax(np.ptp(own, axis=0))]
    at = at[np.argsort(along, kind="stable")]
    half = LEAF * (-(-len(at) // LEAF) // 2)
    return tiled(points, at[:half]) + tiled(points, at[half:])


class Tree:
    """R-tree over points of group counts: leaves close in the points, nodes with upper corners above them."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray):
        self.sizes, self.points = sizes, points
        self.order = np.concatenate(tiled(points, np.arange(len(sizes))))
        #: From the root's children to the leaves: upper corners, smallest set, first member of each node.
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        corner, smallest, width = points[self.order], sizes[self.order], 1
        while len(corner) > LEAF:
            starts = np.arange(0, len(corner), LEAF)
            corner, smallest = np.maximum.reduceat(corner, starts, axis=0), np.minimum.reduceat(smallest, starts)
            width *= LEAF
            self.levels.insert(0, (corner, smallest, np.arange(0, len(sizes), width)))

    def passing(self, of: np.ndarray, fits: np.ndarray) -> np.ndarray:
        """``fits`` (a row for each of the members ``of``) without those whose bound on the overlap is too small."""
        fits = fits[:, self.order]
        open_ = np.ones((len(of), 1), bool)
        for corner, smallest, starts in self.levels:
            open_ = np.repeat(open_, LEAF, axis=1)[:, : len(starts)] & np.logical_or.reduceat(fits, starts, axis=1)
            self._bound(of, open_, corner, smallest)
        fits &= np.repeat(open_, LEAF, axis=1)[:, : len(self.sizes)]
        self._bound(of, fits, self.points[self.order], self.sizes[self.order])
        found = np.empty_like(fits)
        found[:, self.order] = fits
        return found

    def _bound(self, of: np.ndarray, open_: np.ndarray, corner: np.ndarray, smallest: np.ndarray) -> None:
        row, node = np.nonzero(open_)
        step = max(1, TOGETHER // corner.shape[1])
        for start in range(0, len(row), step):
            r, c = row[start : start + step], node[start : start + step]
            overlap = np.minimum(self.points[of[r]], corner[c]).sum(1, dtype=np.int64)
            open_[r, c] = enough(overlap, self.sizes[of[r]], smallest[c])


class Trees:
    """One tree for each number of coordinates, over the points that have it and those that have twice as many, folded.

    Sets that may be linked have numbers of coordinates that differ by a factor of two at most.
    """

    def __init__(self, sizes: np.ndarray, points: list[np.ndarray]):
        self.bits = bits_of(sizes)
        self.trees = []
        for k in np.unique(self.bits).tolist():
            at = np.flatnonzero((self.bits == k) | (self.bits == k + 1))
            rows = np.empty((len(at), 1 << k), np.uint16 if max(int(points[i].max()) for i in at) < 1 << 15 else np.int64)
            for row, i in zip(rows, at, strict=True):
                np.sum(points[i].reshape(1 << k, -1), axis=1, out=row, dtype=row.dtype)
            self.trees.append((k, at, Tree(sizes[at], rows)))

    def passing(self, of: np.ndarray, fits: np.ndarray) -> np.ndarray:
        found = np.zeros_like(fits)
        for k, at, tree in self.trees:
            asked = np.flatnonzero(np.isin(of, at))
            own = np.searchsorted(at, of[asked])
            pairs = np.ix_(asked, at)
            here = np.minimum(self.bits[of[asked], None], self.bits[at]) == k
            found[pairs] |= tree.passing(own, fits[pairs] & here)
        return found


class Points:
    """Members of one block, the smallest set first: the bounds by sizes, places and group counts."""

    def __init__(self, sizes: np.ndarray, payloads: list[bytes]):
        self.sizes = sizes
        #: Shingles from the block's own one on, in the common order.
        self.rest = sizes - np.array([int.from_bytes(p[:8], "big") for p in payloads])
        self.trees = Trees(sizes, unpacked([p[8:] for p in payloads], sizes))

    def passing(self, of: np.ndarray) -> np.ndarray:
        """For each of some members, which ones pass all bounds."""
        overlap = np.minimum(np.minimum(self.sizes, self.rest), self.rest[of, None])
        return self.trees.passing(of, enough(overlap, self.sizes, self.sizes[of, None]))

    def confirmed(self, q: int, at: np.ndarray) -> np.ndarray:
        """Those of the passing ``at`` that count as linked with member ``q``."""
        return at


class Sets:
    """Members of one cluster, the smallest first, with their sets, on which links are verified."""

    def __init__(self, sizes: np.ndarray, payloads: list[bytes]):
        self.sizes = sizes
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        hashes = np.frombuffer(b"".join(payloads), np.uint64)
        self.ids = np.unique(hashes, return_inverse=True)[1]
        self.marked = np.zeros(self.ids.max() + 1, bool)
        self.trees = Trees(sizes, counted(hashes, self.first))

    def passing(self, of: np.ndarray) -> np.ndarray:
        return self.trees.passing(of, enough(np.minimum(self.sizes, self.sizes[of, None]), self.sizes, self.sizes[of, None]))

    def confirmed(self, q: int, at: np.ndarray) -> np.ndarray:
        each = self.sizes[at]
        begin = np.cumsum(each) - each
        places = np.repeat(self.first[at] - begin, each) + np.arange(each.sum())
        own = self.ids[self.first[q] : self.first[q + 1]]
        self.marked[own] = True
        overlap = np.add.reduceat(self.marked[self.ids[places]], begin, dtype=np.int64)
        self.marked[own] = False
        return at[enough(overlap, self.sizes[q], each)]


def clusters(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """``class, cluster`` of the classes that pass the bounds with another one."""
    members_print = [F.bit_xor(F.xxhash64("class")).alias("x"), F.sum(F.hash("class").cast("long")).alias("s"), F.min("class").alias("low")]
    level = F.floor(F.min("place") / RANKS).alias("level")
    blocks = shared.groupBy("token").agg(F.count("*").alias("members"), level, *members_print).filter("members > 1")
    # A pair's first shared shingle comes first among the blocks of the same members too.
    blocks = blocks.groupBy("members", "x", "s", "low").agg(F.min(F.struct("level", "token")).alias("first"))
    blocks = blocks.select(F.col("first.token").alias("token"))
    members = staged(shared.join(blocks, "token").join(classes.select("class", "n"), "class"), "members")
    parts = members.groupBy("token").agg(F.ceil(F.sum(F.greatest(F.lit(GROUPS), F.col("n") / FILL)) / PART).alias("parts"))
    rank = F.unhex(F.lpad(F.hex(F.col("place") % RANKS), 16, "0"))
    given = members.join(parts, "token").join(classes.select("class", "point"), "class").withColumn("payload", F.concat(rank, "point"))
    links = staged(forests(in_parts(given, "token", F.col("parts")), Points), "candidates")
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


def verified(named: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``u, v``: verified links that connect each component of similar classes, from ``class, cluster``."""
    named = named.join(classes.select("class", "key", "n"), "class")
    sizes = named.groupBy("cluster").agg(F.ceil(F.sum("n") / CLUSTER_PART).alias("parts"))
    given = with_sets(docs, staged(named.join(sizes, "cluster"), "wanted"))
    return staged(forests(in_parts(given, "cluster", F.col("parts")), Sets), "links")


def near_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every input row.

    Null texts and texts without words have no shingles and are linked with
    nothing; texts of fewer than five words are one shingle. Equal sets are one
    class, so repeated rows and ties cost nothing more. The smallest id of a
    component names it; a null id names only a component without others. Extra
    columns are ignored; an empty table gives an empty result. A clash of two
    sets' 64-bit hashes is found by a second hash and stops the job.
    """
    rooted = rooted_rows(docs)
    least = rooted.filter("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    named = rooted.join(least, "root", "left")
    name = F.when(F.col("n_shingles") > 0, F.coalesce("least", "doc_id")).otherwise(F.col("doc_id"))
    return named.select("doc_id", "n_shingles", name.alias("component_id"))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, body, key``: the text as bytes and a hash of both."""
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select("doc_id", body.alias("body"), F.xxhash64("doc_id", body).alias("key"))


def rooted_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, key, n_shingles, root`` of every row: rows of one component have one root."""
    given = keyed(docs)
    described = staged(describe(given), "shingled")
    rows = described.filter("sketch IS NULL").select("doc_id", "key", F.col("n").alias("n_shingles"), "class", "check", "point")
    same = F.assert_true(F.min("check") == F.max("check"), F.lit("two shingle sets have one hash"))
    classes = rows.filter("n_shingles > 0").groupBy("class").agg(
        F.min("key").alias("key"), F.max("n_shingles").alias("n"), F.min("point").alias("point"), same.alias("same")
    )
    classes = staged(classes.filter("same IS NULL").drop("same"), "classes")

    rarity = rarity_levels(described.filter("sketch IS NOT NULL"))
    shared = staged(shared_tokens(tokens(given, rarity)), "tokens")
    found = components(verified(clusters(shared, classes), given, classes))

    rooted = rows.join(found.select(F.col("u").alias("class"), F.col("v").alias("root")), "class", "left")
    return rooted.select("doc_id", "key", "n_shingles", F.coalesce("root", "class").alias("root"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of every component of ``docs``, with the same columns: that of the smallest id.

    Decided for each (id, text), so different texts that share an id, or have none,
    are judged apart. A null id comes last; among texts of one id the smallest hash
    stays, among rows of one id and text the first by all columns' hash (equal rows
    differ in nothing). Texts without words are linked with nothing: each of their
    (id, text) stays once.
    """
    empty = F.col("n_shingles") == 0
    group = F.struct(empty.alias("empty"), F.when(empty, F.col("key")).otherwise(F.col("root")).alias("name"))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    first = rooted_rows(docs).groupBy(group.alias("group")).agg(F.min(place).alias("first")).select(F.col("first.key").alias("kept"))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.xxhash64("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("key"),
    )
    named = rows.join(first.distinct(), F.col("key") == F.col("kept"), "left_semi")
    return named.groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
