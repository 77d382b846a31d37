"""Collocations: the best-scoring phrases of each language, by best-first growth of a phrase trie.

1. Words are counted, then all pairs of words that are frequent enough.
2. A phrase is a path in a trie of words. What grows from the node of a prefix
   occurs at most as often as the prefix, and cut behind its first word its score
   is at most ``SCALE * f(prefix) / (f(first word) + f(prefix))``: an admissible
   bound, known before anything longer is counted.
3. Best first: the frontier's nodes whose bound reaches the score of their
   language's ``top``-th surviving phrase are opened. All that is one word longer
   than an open node, on either side, is counted over the whole corpus, which scores
   new phrases and settles which known ones a longer phrase covers. Rounds go on
   until no closed node's bound reaches that score, ties included.

Words are told apart by 64-bit hashes; phrases are arrays of these. Fixed-size
filters keep most rows that can't matter from being shuffled; once they are full
they keep everything, and exact joins decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tariffscope.llm.arrays import FOLD, mix
from tariffscope.llm.common import body_bytes, slices, staged

LONGEST = 4
#: Occurrences that a phrase needs.
MIN_COUNT = 30
SCALE = 2_000_000
#: A phrase is dropped if one longer phrase has this share (percent) of its occurrences.
COVERED = 80
#: Phrases a language lists.
TOP = 2000
#: A round opens nodes as if so many times as many phrases were wanted, which saves passes over the corpus.
AHEAD = 2
#: Bits of a filter: 2 MB on every executor, whatever the corpus.
BITS = 24
#: Rows a task counts before it passes them on.
HELD = 1_000_000
#: Tasks that share the last ranking of one language.
SALTS = 64

_SPLIT = np.zeros(256, bool)
_SPLIT[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_BETWEEN = _SPLIT.copy()
_BETWEEN[[0x20, 0x09]] = True
_FACTORS = np.random.default_rng(13).integers(1, 1 << 63, LONGEST, dtype=np.uint64) | np.uint64(1)
_PLACES = ["w1", "w2", "w3", "w4"]


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place, as one number; past the end they are zero."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray(len(data), "<u8", padded, strides=(1,))


def word_hash(data: np.ndarray, start: np.ndarray, stop: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Hash of each word's bytes, eight at a time, beginning with ``seed``."""
    ahead = eight_bytes(data)
    left = stop - start
    found = mix(seed ^ left.astype(np.uint64))
    live, step = np.arange(len(start)), 0
    while len(live):
        spare = np.maximum(8 - left[live], 0).astype(np.uint64) * np.uint64(8)
        found[live] = mix(found[live] * _FACTORS[0] ^ (ahead[start[live] + step] << spare))
        step += 8
        left[live] -= 8
        live = live[left[live] > 0]
    return found


class Corpus:
    """Words of a run of rows: hashes that tell languages apart, and whether the next word stands in the same piece."""

    def __init__(self, rows: pa.RecordBatch):
        raw, offsets = body_bytes(rows.column("body"))
        self.data = FOLD[raw]
        self.lang = rows.column("lang").to_pylist()
        last = np.zeros(len(raw) + 1, bool)
        last[offsets] = True
        inside = ~_BETWEEN[raw]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | last[1:-1]
        ends[:-1] &= ~inside[1:] | last[1:-1]
        self.start, self.stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.doc = np.repeat(np.arange(len(self.lang)), np.diff(np.searchsorted(self.start, offsets)))
        salts = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest()) for x in set(self.lang)}
        self.hash = word_hash(self.data, self.start, self.stop, np.array([salts[x] for x in self.lang], np.uint64)[self.doc])
        breaks = np.flatnonzero(_SPLIT[raw])
        pieces = np.searchsorted(breaks, self.start)
        self.with_next = (pieces[1:] == pieces[:-1]) & (self.doc[1:] == self.doc[:-1])

    def windows(self, size: int) -> np.ndarray:
        """Where ``size`` consecutive words of one piece begin."""
        whole = np.ones(max(len(self.hash) - size + 1, 0), bool)
        for step in range(size - 1):
            whole &= self.with_next[step : step + len(whole)]
        return np.flatnonzero(whole)


def phrase_key(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for each phrase, given the hashes of its words; any two lengths differ."""
    key = np.full(len(parts[0]), len(parts), np.uint64)
    for part, factor in zip(parts, _FACTORS, strict=False):
        key = mix(key ^ part * factor)
    return key


class Filter:
    """Bits of phrases: what isn't in it isn't among them; what is in it may be."""

    def __init__(self, phrases: DataFrame, size: int):
        """``phrases`` has their words' hashes as ``path``, each ``size`` long. The driver gets at most 2 ** BITS bits."""

        def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(1 << (BITS - 6), np.uint64)
            for batch in source:
                paths = batch.column("path").flatten().to_numpy().view(np.uint64).reshape(-1, size)
                spot = phrase_key(list(paths.T)) >> np.uint64(64 - BITS)
                np.bitwise_or.at(bits, spot >> np.uint64(6), np.uint64(1) << (spot & np.uint64(63)))
            slot = np.flatnonzero(bits)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(bits[slot].view(np.int64))], names=["slot", "bits"])

        found = phrases.select("path").mapInArrow(work, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits"))
        table = found.toArrow()
        bits = np.zeros(1 << (BITS - 6), np.uint64)
        bits[table.column("slot").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
        self.bits = phrases.sparkSession.sparkContext.broadcast(bits)

    def has(self, key: np.ndarray) -> np.ndarray:
        spot = key >> np.uint64(64 - BITS)
        return (self.bits.value[spot >> np.uint64(6)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)


def grouped(keys: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of ``keys`` and the sum of ``n`` of each.

    One sort of numbers made of a hash and the row's place; if two rows' hashes
    clash, all of them are sorted in full.
    """
    places = max(int(len(n) - 1).bit_length(), 1)
    hashed = phrase_key(keys) >> np.uint64(places) << np.uint64(places)
    order = np.sort(hashed | np.arange(len(n), dtype=np.uint64)) & np.uint64((1 << places) - 1)
    columns, by = [key[order] for key in keys], hashed[order]
    new = np.ones(len(n), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    if (new[1:] & (by[1:] == by[:-1])).any():
        order = np.lexsort(keys)
        columns = [key[order] for key in keys]
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.add.reduceat(n[order], first)


class Counter:
    """Counts of equal rows of hashes, merged as they come and handed on when they are too many to hold."""

    def __init__(self, width: int):
        self.width, self.held, self.rows = width, [], 0

    def add(self, keys: list[np.ndarray], n: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        if not len(keys[0]):
            return
        self.held.append((keys, np.ones(len(keys[0]), np.int64) if n is None else n))
        self.rows += len(keys[0])
        if self.rows > HELD:
            self._merge()
            if self.rows > HELD // 2:
                yield from self.rest()

    def _merge(self) -> None:
        columns = [np.concatenate([keys[k] for keys, _ in self.held]) for k in range(len(self.held[0][0]))]
        self.held = [grouped(columns, np.concatenate([n for _, n in self.held]))]
        self.rows = len(self.held[0][1])

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._merge()
            keys, n = self.held[0]
            columns = [pa.array(key.view(np.int64)) for key in keys] + [pa.nulls(len(n), pa.int64())] * (self.width - len(keys))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n)], names=[*_PLACES[: self.width], "n"])
            self.held, self.rows = [], 0


def given_rows(docs: DataFrame) -> DataFrame:
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), body.alias("body"))


def word_counts(rows: DataFrame, least: int) -> DataFrame:
    """``hash, lang, word, n`` of frequent words; a row without a hash has the number of all words of a language."""
    names = ["hash", "lang", "word", "n"]

    def table(hashes: list, lang: list, word: list, n: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((hashes, lang, word, n), kinds, strict=True)], names=names)

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[tuple[np.ndarray, np.ndarray]] = []
        known = np.zeros(0, np.uint64)  # hashes that are spelled, sorted
        order: list[np.ndarray] = []  # the same in the order in which lang and word spell them
        lang: list[str] = []
        word: list[bytes] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            (hashes,), n = grouped([np.concatenate([h for h, _ in counts])], np.concatenate([n for _, n in counts]))
            return hashes, n

        def named() -> pa.RecordBatch:
            hashes, n = merged()
            by = np.argsort(np.concatenate(order))
            at = by[np.searchsorted(known, hashes)].tolist()
            return table(hashes.view(np.int64), [lang[k] for k in at], [word[k] for k in at], n)

        for batch in source:
            for run in slices(batch, "body"):
                c = Corpus(run)
                each = np.bincount(c.doc, minlength=len(c.lang)).tolist()
                totals = dict.fromkeys(c.lang, 0)
                for name, k in zip(c.lang, each, strict=True):
                    totals[name] += k
                yield table([None] * len(totals), list(totals), [None] * len(totals), list(totals.values()))
                if not len(c.hash):
                    continue
                (hashes,), n = grouped([c.hash], np.ones(len(c.hash), np.int64))
                counts.append((hashes, n))
                hashes = np.sort(hashes)
                slot = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                fresh = hashes[known[slot] != hashes] if len(known) else hashes
                place = np.minimum(np.searchsorted(fresh, c.hash), max(len(fresh) - 1, 0))
                found = np.flatnonzero(fresh[place] == c.hash) if len(fresh) else place[:0]
                at = np.empty(len(fresh), np.int64)
                at[place[found]] = found
                data = c.data.tobytes()
                word += [data[a:b] for a, b in zip(c.start[at].tolist(), c.stop[at].tolist(), strict=True)]
                lang += [c.lang[k] for k in c.doc[at].tolist()]
                order.append(fresh)
                known = np.sort(np.concatenate((known, fresh)))
                if sum(len(n) for _, n in counts) > HELD:
                    counts = [merged()]
                if len(known) > HELD:
                    yield named()
                    counts, known, order, lang, word = [], known[:0], [], [], []
        if counts:
            yield named()

    counted = rows.mapInArrow(work, "hash long, lang string, word binary, n long")
    summed = counted.groupBy("hash", "lang", "word").agg(F.sum("n").alias("n"))
    return summed.filter(F.col("hash").isNull() | (F.col("n") >= least)).withColumn("word", F.col("word").cast("string"))


def pair_counts(rows: DataFrame, frequent: Filter, least: int) -> DataFrame:
    """``path, a`` of all frequent pairs of frequent words."""

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(2)
        for batch in source:
            for run in slices(batch, "body"):
                c = Corpus(run)
                good = frequent.has(phrase_key([c.hash]))
                at = c.windows(2)
                at = at[good[at] & good[at + 1]]
                yield from counter.add([c.hash[at], c.hash[at + 1]])
        yield from counter.rest()

    counted = rows.mapInArrow(work, "w1 long, w2 long, n long").groupBy("w1", "w2").agg(F.sum("n").alias("a"))
    return counted.filter(F.col("a") >= least).select(F.array("w1", "w2").alias("path"), "a")


def longer_counts(rows: DataFrame, pairs: Filter, opened: dict[int, Filter], least: int) -> DataFrame:
    """``path, a`` of frequent phrases that begin or end with an opened one and have one word more."""

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {size: Counter(LONGEST) for size in opened}
        for batch in source:
            for run in slices(batch, "body"):
                c = Corpus(run)
                twos = phrase_key([c.hash[:-1], c.hash[1:]])
                frequent = pairs.has(twos)
                for size, known in opened.items():
                    at = c.windows(size + 1)
                    for step in range(size):
                        at = at[frequent[at + step]]
                    keys = [phrase_key([c.hash[at + side + step] for step in range(size)]) for side in (0, 1)]
                    at = at[known.has(keys[0]) | known.has(keys[1])]
                    yield from counters[size].add([c.hash[at + step] for step in range(size + 1)])
        for counter in counters.values():
            yield from counter.rest()

    counted = rows.mapInArrow(work, "w1 long, w2 long, w3 long, w4 long, n long").groupBy(_PLACES).agg(F.sum("n").alias("a"))
    return counted.filter(F.col("a") >= least).select(F.array_compact(F.array(*_PLACES)).alias("path"), "a")


def ends(longer: DataFrame) -> DataFrame:
    """``longer`` twice, with the phrase ``part`` that lacks its last word, and that lacks its first."""
    size = F.size("path")
    parts = F.array(F.slice("path", 1, size - 1), F.slice("path", 2, size - 1))
    return longer.withColumn("part", F.explode(parts))


def whole_score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(SCALE * a / (l + r)), exact: products have up to 27 digits."""
    wide = [x.cast("decimal(19,0)") for x in (a, l, r)]
    return F.call_function("div", wide[0] * F.lit(SCALE).cast("decimal(8,0)"), wide[1] + wide[2])


def judged(known: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``path, lang, a, l, r, score, bound, dropped`` of all known phrases: the cut that scores lowest counts."""
    single = vocabulary.select(F.array("hash").alias("path"), F.col("n").alias("a"))
    counts = single.unionByName(known.select("path", "a"))
    size = F.size("path")
    cuts = known.select("path", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("path", "a", "k", F.slice("path", 1, F.col("k")).alias("left"), F.slice("path", F.col("k") + 1, size - F.col("k")).alias("right"))
    sided = cuts.join(counts.select(F.col("path").alias("left"), F.col("a").alias("l")), "left")
    sided = sided.join(counts.select(F.col("path").alias("right"), F.col("a").alias("r")), "right")
    lowest = F.min(F.struct(whole_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("cut")
    scored = sided.groupBy("path", "a").agg(lowest)
    covers = ends(known.filter(size > 2)).groupBy(F.col("part").alias("path")).agg(F.max("a").alias("longer"))
    first = vocabulary.select(F.col("hash").alias("w1"), "lang", F.col("n").alias("first"))
    found = scored.join(covers, "path", "left").withColumn("w1", F.col("path")[0]).join(first, "w1")
    exact = [F.col(c).cast("decimal(19,0)") for c in ("longer", "a")]
    return found.select(
        "path", "lang", "a", "cut.l", "cut.r", "cut.score", whole_score(F.col("a"), F.col("first"), F.col("a")).alias("bound"),
        F.coalesce(100 * exact[0] >= COVERED * exact[1], F.lit(False)).alias("dropped"),
    )


def lowest_score(phrases: DataFrame, top: int, name: str) -> DataFrame:
    """``lang`` and the score of its ``top``-th surviving phrase; languages with fewer have no row.

    A language's window holds one row for each score, at most SCALE / 2 + 1.
    """
    each = phrases.filter("NOT dropped").groupBy("lang", "score").agg(F.count("*").alias("c"))
    down = Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return each.withColumn("above", F.sum("c").over(down)).filter(F.col("above") >= top).groupBy("lang").agg(F.max("score").alias(name))


def grown(rows: DataFrame, vocabulary: DataFrame, top: int, least: int) -> DataFrame:
    """All phrases of ``judged`` that may be listed, each with its final verdict, and ``cutoff``, the last listed score."""
    spark = rows.sparkSession
    words_filter = Filter(vocabulary.select(F.array("hash").alias("path")), 1)
    known = staged(pair_counts(rows, words_filter, least), "phrases")
    pairs = Filter(known, 2)
    opened = spark.createDataFrame([], "path array<long>")
    while True:
        phrases = staged(judged(known, vocabulary), "judged")
        limits = lowest_score(phrases, top, "cutoff").join(lowest_score(phrases, AHEAD * top, "ahead"), "lang", "left")
        phrases = phrases.join(limits, "lang", "left").fillna(0, ["cutoff", "ahead"])
        closed = phrases.filter(F.size("path") < LONGEST).join(opened, "path", "left_anti")
        frontier = staged(closed.filter("bound >= least(cutoff, ahead)").select("path", (F.col("bound") >= F.col("cutoff")).alias("due")), "frontier")
        if frontier.filter("due").isEmpty():
            return phrases.filter("NOT dropped AND score >= cutoff")
        threes = frontier.filter(F.size("path") == 3).select("path")
        # A longer phrase needs the counts of both its ends, so what lies within an opened node is opened too.
        inside = ends(threes).select(F.col("part").alias("path"))
        fresh = staged(frontier.select("path").unionByName(inside).distinct().join(opened, "path", "left_anti"), "opened")
        filters = {size: Filter(fresh.filter(F.size("path") == size), size) for size in (2, 3)}
        more = longer_counts(rows, pairs, filters, least)
        more = ends(more).join(fresh.withColumnRenamed("path", "part"), "part", "left_semi").select("path", "a")
        known = staged(known.unionByName(more).groupBy("path").agg(F.max("a").alias("a")), "phrases")
        opened = staged(opened.unionByName(fresh), "opened")


def collocations(docs: DataFrame, top: int = TOP, least: int = MIN_COUNT) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases.

    Null and empty texts have no words, a null language is ``und``, repeated rows
    count again. Ties go by ``a``, then by the phrase in byte order. Texts of any length are read
    whole. Extra columns are ignored; an empty table gives an empty result. Two
    frequent words with one 64-bit hash stop the job.
    """
    rows = given_rows(docs)
    counts = staged(word_counts(rows, least), "words")
    clash = F.assert_true(F.count("*") == 1, F.lit("two words have one hash"))
    vocabulary = counts.filter("hash IS NOT NULL").groupBy("hash").agg(
        F.min("lang").alias("lang"), F.min("word").alias("word"), F.min("n").alias("n"), clash.alias("clash")
    )
    vocabulary = staged(vocabulary.filter("clash IS NULL").drop("clash"), "vocabulary")
    listed = staged(grown(rows, vocabulary, top, least), "listed")
    spelled = listed.select("path", F.posexplode("path").alias("place", "hash")).join(vocabulary.select("hash", "word"), "hash")
    spelled = spelled.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("words"))
    named = listed.join(spelled.select("path", F.concat_ws(" ", "words.word").alias("phrase")), "path")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    part = named.withColumn("salt", salt).withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    ranked = part.filter(F.col("place") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    totals = counts.filter("hash IS NULL").select("lang", "n")
    found = ranked.filter(F.col("rank") <= top).join(totals, "lang")
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
