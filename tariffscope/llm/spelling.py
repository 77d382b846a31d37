"""Spelling variants: words at distance one, through pairs of trie nodes.

1. Runs of letters are counted; a few lose one letter by a checksum rule, which
   plants variants that any answer must find.
2. The words are sorted as they stand and reversed. Along each sorted range the
   nodes of its trie are numbered in the order of their first visit; the ranges'
   numbers are then joined up over their ends, so a node has one number however
   many tasks its words lie in. A word's own number follows code-point order.
3. A word without its letter i is the pair (node of what stands before, node of
   what stands behind). Two words that skip into one pair differ by a replaced
   letter; a word that skips into a pair at which another one is merely cut
   differs from it by an inserted one. Pairs are exact, so nothing is verified.
   Only nodes that at least two words share make pairs.
4. A pair holds at most one word for each letter and one cut word: groups are
   bounded by the alphabet, and each member yields one row, not one per partner.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tariffscope.llm.arrays import FOLD
from tariffscope.llm.common import body_bytes, slices, staged

#: Code points and occurrences that a word needs.
MIN_LENGTH, MIN_COUNT = 7, 2
#: A run loses a letter if its checksum is divisible by this.
CUT_EVERY = 31
#: A form is at least so many times as frequent as the word.
TIMES = 10
#: Distinct words a task counts before it passes them on.
HELD = 200_000
#: Bytes up to which checksums of runs are computed together.
SHORT = 48

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: First byte of U+00C0 to U+00FF in UTF-8; any continuation byte may follow.
_LEAD = 0xC3
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and stop of each run of letters, and its text; runs never cross texts."""
    last = np.zeros(len(data) + 1, bool)
    last[offsets] = True
    lead = np.zeros(len(data), bool)
    lead[:-1] = (data[:-1] == _LEAD) & (data[1:] >> 6 == 2) & ~last[1:-1]
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | last[1:-1]
    ends[:-1] &= ~inside[1:] | last[1:-1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, stop, np.searchsorted(offsets, start, side="right") - 1


def checksums(data: np.ndarray, start: np.ndarray, stop: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """crc32 of each run, going on from the checksum ``seed`` of what stands before it."""
    size = stop - start
    order = np.argsort(-size, kind="stable")
    at, size = start[order], size[order]
    state = ~seed[order].astype(np.uint32)
    long = int(np.searchsorted(-size, -SHORT, side="left"))
    for step in range(int(size[long]) if long < len(size) else 0):
        live = slice(long, int(np.searchsorted(-size, -step, side="left")))
        state[live] = _CRC[(state[live] ^ data[at[live] + step]) & 0xFF] ^ (state[live] >> 8)
    found = np.empty(len(order), np.uint32)
    found[order] = ~state
    for k in order[:long]:
        found[k] = zlib.crc32(data[start[k] : stop[k]].tobytes(), int(seed[k]))
    return found


def words_of(bodies: pa.Array, ids: list) -> pa.Array:
    """Every occurrence of a word of the batch, lower-cased, with its letter cut out where the rule says so."""
    raw, offsets = body_bytes(bodies)
    data = FOLD[raw]
    if not len(data):
        return pa.array([], pa.string())
    start, stop, doc = letter_runs(raw, offsets)
    seeds = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    wide = np.concatenate(([0], np.cumsum(data == _LEAD)))
    length = stop - start - (wide[stop] - wide[start])
    kept = length >= MIN_LENGTH
    start, stop, doc, length = start[kept], stop[kept], doc[kept], length[kept]
    check = checksums(data, start, stop, seeds[doc])
    cut = check % CUT_EVERY == 0
    less = []
    for k in np.flatnonzero(cut & (length > MIN_LENGTH)):
        run = data[start[k] : stop[k]].tobytes().decode()
        at = int(check[k]) % int(length[k])
        less.append(run[:at] + run[at + 1 :])
    start, stop = start[~cut], stop[~cut]
    edges = np.zeros(len(data) + 1, np.int8)
    edges[start] = 1
    edges[stop] -= 1
    bounds = np.concatenate(([0], np.cumsum(stop - start))).astype(np.int64)
    letters = data[np.cumsum(edges[:-1]).astype(bool)]
    whole = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(letters.tobytes()))
    return pa.concat_arrays([whole.cast(pa.string()), pa.array(less, pa.string())])


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` of every word with enough letters and occurrences. Counts are partial before the shuffle."""

    def added(parts: list[pa.Table]) -> pa.Table:
        summed = pa.concat_tables(parts).group_by("word").aggregate([("n", "sum")])
        return pa.table({"word": summed.column("word"), "n": summed.column("n_sum")})

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in source:
            for run in slices(batch, "body"):
                counts = words_of(run.column("body"), run.column("doc_id").to_pylist()).value_counts()
                held.append(pa.table({"word": counts.field("values"), "n": counts.field("counts")}))
                if sum(t.num_rows for t in held) > HELD:
                    held = [added(held)]
                    if held[0].num_rows > HELD // 2:
                        yield from held.pop().to_batches()
        if held:
            yield from added(held).to_batches()

    body = F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body")
    counted = docs.select("doc_id", body).mapInArrow(work, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


def common_start(one: str, other: str) -> int:
    shared = 0
    for a, b in zip(one, other):  # noqa: B905
        if a != b:
            break
        shared += 1
    return shared


def with_nodes(rows: DataFrame, spelled: Column, end: str, path: str) -> DataFrame:
    """``rows`` with the trie node of their distinct ``spelled`` in ``end``, and those on the way that others share in ``path``.

    Nodes are numbered from 1 (0 is the root) in the order of a walk through the
    sorted words. ``path[d]`` is the node of the first d + 1 letters, as deep as
    a neighbour in the order shares them. A task's range is numbered by itself;
    the driver gets one row for each range, its first and last word, and says
    where the numbers begin and which nodes the range before has numbered.
    """
    given = rows.withColumn("spelled", spelled)
    names = rows.columns
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = last = waiting = None
        way: list[int] = []
        shared = nodes = 0

        def made(batch: pa.RecordBatch, ends: list[int], ways: list[list[int]]) -> pa.RecordBatch:
            none = pa.nulls(batch.num_rows, pa.string())
            return pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array([part] * batch.num_rows, pa.int32()), pa.array(ends, pa.int64()),
                 pa.array(ways, pa.list_(pa.int64())), none, none, pa.nulls(batch.num_rows, pa.int64())],
                names=[*names, "part", end, path, "first", "last", "nodes"],
            )

        for batch in source:
            if not batch.num_rows:
                continue
            ends, ways = [], []
            for word in batch.column("spelled").to_pylist():
                again = 0
                if first is None:
                    first = word
                else:
                    again = common_start(last, word)
                    ways.append(way if last == first else way[: max(shared, again)])
                way = way[:again] + list(range(nodes, nodes + len(word) - again))
                nodes += len(word) - again
                shared, last = again, word
                ends.append(way[-1])
            if waiting is not None:
                yield made(waiting[0], waiting[1], ways[:1])
                ways = ways[1:]
            yield made(batch.slice(0, batch.num_rows - 1), ends[:-1], ways)
            waiting = batch.slice(batch.num_rows - 1), ends[-1:]
        if waiting is not None:
            yield made(waiting[0], waiting[1], [way])
            empty = [pa.nulls(1, waiting[0].schema.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*empty, pa.array([part], pa.int32()), pa.nulls(1, pa.int64()), pa.array([way], pa.list_(pa.int64())), pa.array([first]),
                 pa.array([last]), pa.array([nodes], pa.int64())],
                names=[*names, "part", end, path, "first", "last", "nodes"],
            )

    extra = f"part int, {end} long, {path} array<long>, first string, last string, nodes long"
    ranges = given.repartitionByRange("spelled").sortWithinPartitions("spelled")
    numbered = staged(ranges.mapInArrow(work, f"{fields}, {extra}"), f"trie-{path}")
    begin, known, before, last = 1, [], [], ""
    ends = numbered.filter("nodes IS NOT NULL").select("part", "first", "last", "nodes", path).orderBy("first")
    for row in ends.collect():
        old = before[: common_start(last, row["first"])]
        known.append((row["part"], begin, old))
        before = [old[x] if x < len(old) else begin + x for x in row[path]]
        begin, last = begin + row["nodes"], row["last"]
    joint = F.broadcast(rows.sparkSession.createDataFrame(known, "part int, begin long, old array<long>"))
    node = F.transform(path, lambda x: F.when(x < F.size("old"), F.element_at("old", (x + 1).cast("int"))).otherwise(F.col("begin") + x))
    found = numbered.filter("nodes IS NULL").join(joint, "part")
    return found.select(*names, (F.col("begin") + F.col(end)).alias(end), node.alias(path))


def pair_dictionary(words: DataFrame) -> DataFrame:
    """``before, behind, skips, fresh, id, n``: each word at every pair of shared nodes into which it skips or at which it is cut.

    Letters that repeat the one before them skip into the same word as that one;
    ``fresh`` marks the first.
    """
    root = F.array(F.lit(0).cast("long"))
    given = words.select(
        "id", "n", F.length("word").alias("size"), F.split("word", "").alias("letters"),
        F.concat(root, "prefixes").alias("prefixes"), F.concat(root, "suffixes").alias("suffixes"),
    )

    def pairs(skipped: int) -> Column:
        low = F.greatest(F.lit(0), F.col("size") - skipped - F.size("suffixes") + 1)
        high = F.least(F.col("size") - skipped, F.size("prefixes") - 1)

        def pair(i: Column) -> Column:
            letter = F.col("letters")[i]
            repeats = (i > 0) & (letter == F.col("letters")[F.greatest(i - 1, F.lit(0))])
            return F.struct(
                F.col("prefixes")[i].alias("before"), F.col("suffixes")[F.col("size") - skipped - i].alias("behind"),
                F.lit(bool(skipped)).alias("skips"), (~repeats if skipped else F.lit(True)).alias("fresh"),
            )

        return F.when(low <= high, F.transform(F.sequence(low, high), pair))

    made = [given.select("id", "n", F.inline(pairs(skipped))) for skipped in (1, 0)]
    return made[0].unionByName(made[1]).select("before", "behind", "skips", "fresh", "id", "n")


def near_words(pairs: DataFrame) -> DataFrame:
    """``id, n_near, best``: how many words are near each one, and the most frequent (``n``, minus its number).

    A replaced letter shows in one pair, an inserted one in the pair of the first
    of equal letters: each near word counts once.
    """
    members = F.collect_list(F.struct("skips", "fresh", "id", "n")).alias("members")
    groups = pairs.groupBy("before", "behind").agg(members).filter(F.size("members") > 1)

    def of(x: Column) -> Column:
        def near(y: Column) -> Column:
            replaced = x["skips"] & y["skips"] & (x["id"] != y["id"])
            return replaced | (x["skips"] & x["fresh"] & ~y["skips"]) | (~x["skips"] & y["skips"] & y["fresh"])

        found = F.filter("members", near)
        return F.struct(
            x["id"].alias("id"), F.size(found).cast("long").alias("n_near"),
            F.array_max(F.transform(found, lambda y: F.struct(y["n"].alias("n"), (-y["id"]).alias("order")))).alias("best"),
        )

    each = groups.select(F.inline(F.transform("members", of))).filter("n_near > 0")
    return each.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``id, root``: from ``id`` along its form's form to the last, by doubling. A form is far more frequent: no circles."""
    steps = staged(forms.select("id", F.col("form").alias("root")), "forms")
    while True:
        ahead = steps.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
        moved = staged(steps.join(ahead, "root", "left").select("id", F.coalesce("beyond", "root").alias("root"), "beyond"), "forms")
        if moved.filter("beyond IS NOT NULL").isEmpty():
            return moved.select("id", "root")
        steps = moved.select("id", "root")


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word in the texts of ``docs``.

    Null and empty texts have no words, a null id counts as empty text, repeated
    rows count again; bytes that aren't UTF-8 separate runs. Of equally frequent
    near words the first in code-point order is the form. Runs may be of any
    length. Extra columns are ignored; an empty table gives an empty result.
    """
    counts = staged(word_counts(docs), "words")
    forward = with_nodes(counts, F.col("word"), "id", "prefixes")
    words = staged(with_nodes(forward, F.reverse("word"), "mirror", "suffixes").drop("mirror"), "nodes")
    near = near_words(pair_dictionary(words))
    judged = words.select("id", "word", "n").join(near, "id", "left")
    form = F.when(F.col("best.n") >= TIMES * F.col("n"), -F.col("best.order"))
    judged = staged(judged.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), form.alias("form")), "near")
    named = judged.select("id", "word", "n")
    changed = judged.filter("form IS NOT NULL").select("id", "form")
    ends = roots(changed).join(named.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root")
    targets = named.select(F.col("id").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n"))
    answers = changed.join(targets, "form").drop("form").join(ends.select("id", "root_word"), "id")
    return judged.join(answers, "id", "left").select(
        "word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"
    )
