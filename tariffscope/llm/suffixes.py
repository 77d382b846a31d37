"""Long repeated strings of a corpus, removed from every place, by grouping hashes of sampled suffixes.

No suffix array is built: removal asks which prefixes of ``LENGTH`` bytes are
equal, not for their order, so sorting, recursion and merging are replaced:

1. A content-defined cover samples suffixes: of every ``COVER`` consecutive
   positions the one with the least local hash. Equal strings of ``LENGTH`` bytes
   have their sampled position at the same distance from their start, as with a
   difference cover; each sampled suffix answers for the run of starts ("lead")
   that lead to it.
2. In place of sorted triples: sampled suffixes are grouped by a hash of their
   next three blocks. One that occurs once ends there.
3. In place of a recursion on names: one grouping by a hash of the whole
   neighbourhood. A sampled suffix whose lead and following bytes have a twin is
   repeated with its whole lead.
4. In place of merging the remaining suffixes: hashes of all ``LENGTH`` byte
   strings of the lead are sorted within a task, for each triple name, and equal
   neighbours are repeated.

Names are 64-bit hashes. Counting is partial before each shuffle, and a triple
name with very many neighbourhoods is split by distance, down to one start,
until its parts are small or plain counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffscope.llm.arrays import byte_values, mix, powers, prefix_hash, run_hash
from tariffscope.llm.common import body_bytes, body_offsets, flagged, slices, staged

LENGTH = 400
COVER = 149
BLOCK = 84
LOCAL = 16
#: Neighbourhoods of one triple name that a task sorts together; a larger class is split.
CLASS = 20_000
#: Starts of a part of a split class.
PART = 30
#: Neighbourhoods sorted in one go, and those passed on in one batch.
TOGETHER = 2_000


def sampled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sampled positions, their first and last starts, their documents, and the prefix hash of the bytes."""
    none = np.zeros(0, np.int64)
    sums = prefix_hash(byte_values(data)) if len(data) else np.zeros(1, np.uint64)
    if len(data) < LENGTH:
        return none, none, none, none, sums
    grams = len(data) - LOCAL + 1
    rank = (sums[LOCAL:] - sums[:-LOCAL]) * powers(len(sums), True)[:grams]
    rank = (mix(rank) & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
    size = -(-grams // COVER) * COVER
    padded = np.full(size + COVER, np.iinfo(np.uint64).max)
    padded[:grams] = rank
    ahead = np.minimum.accumulate(padded.reshape(-1, COVER), axis=1).ravel()
    behind = np.minimum.accumulate(padded.reshape(-1, COVER)[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    doc = np.repeat(np.arange(len(starts)), starts)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(starts) - starts, starts) + offsets[doc]
    least = np.minimum(behind[at], ahead[at + COVER - 1])
    chosen = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(chosen):
        return none, none, none, none, sums
    new = np.ones(len(chosen), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(chosen)) - 1
    return chosen[head], at[head], at[last], doc[head], sums


def triple_names(sums: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Names of the suffixes' first three blocks."""
    name = np.zeros(len(position), np.uint64)
    for block in range(3):
        name = mix(name * np.uint64(3) + run_hash(sums, position + block * BLOCK, position + (block + 1) * BLOCK))
    return name.view(np.int64)


def around_names(sums: np.ndarray, position: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Names of the neighbourhoods: all strings that start in the lead, and where it lies."""
    name = run_hash(sums, first, last + LENGTH)
    return mix(name * np.uint64(3) + ((position - first) * 512 + position - last).astype(np.uint64)).view(np.int64)


def sample(docs: DataFrame) -> DataFrame:
    """``key, triple, around, first, last`` of every sampled suffix; starts are offsets in the document."""

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for run in slices(batch, "body"):
                data, offsets = body_bytes(run.column("body"))
                position, first, last, doc, sums = sampled(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [run.column("key").take(pa.array(doc)), pa.array(triple_names(sums, position)),
                     pa.array(around_names(sums, position, first, last)),
                     pa.array((first - offsets[doc]).astype(np.int32)), pa.array((last - offsets[doc]).astype(np.int32))],
                    names=["key", "triple", "around", "first", "last"],
                )

    return docs.select("key", "body").mapInArrow(work, "key long, triple long, around long, first int, last int")


def neighbourhoods(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``class, around, lead, tail, skip, bytes`` for ``wanted`` (key, places): the strings of each neighbourhood.

    ``lead`` and ``tail`` are the largest and the least distance from a start to
    the sampled position, ``skip`` the starts left out before.
    """

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = []
            for run in slices(batch, "body"):
                for body, places in zip(run.column("body").to_pylist(), run.column("places").to_pylist(), strict=True):
                    data = np.frombuffer(body, np.uint8)
                    position, first, last, _, sums = sampled(data, np.array([0, len(data)]))
                    triple = triple_names(sums, position)
                    at = np.searchsorted(first, [p["first"] for p in places])
                    for k, place in zip(at, places, strict=True):
                        start, stop = int(first[k]), int(last[k])
                        rows.append((triple[k], place["around"], position[k] - start, position[k] - stop, body[start : stop + LENGTH]))
                        if len(rows) == TOGETHER:
                            yield _strings(rows)
                            rows = []
            if rows:
                yield _strings(rows)

    chosen = docs.select("key", "body").join(wanted, "key").select("body", "places")
    return chosen.mapInArrow(work, "class long, around long, lead int, tail int, skip int, bytes binary")


def _strings(rows: list[tuple], skips: list[int] | None = None) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], [], []]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    skip = pa.array(skips if skips is not None else [0] * len(rows), pa.int32())
    return pa.RecordBatch.from_arrays([*arrays[:4], skip, arrays[4]], names=["class", "around", "lead", "tail", "skip", "bytes"])


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of ``TOGETHER`` rows."""
    return (batch.slice(at, TOGETHER) for at in range(0, batch.num_rows, TOGETHER))


def _by_rows(batch: pa.RecordBatch) -> Iterator[dict[str, object]]:
    return (row for piece in _pieces(batch) for row in piece.to_pylist())


def split(strings: DataFrame) -> DataFrame:
    """Neighbourhoods of large classes cut by distance to the sampled position; each part's class is what its starts share."""

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows, skips = [], []
            for row in _by_rows(batch):
                text, lead = row["bytes"], row["lead"]
                sums = prefix_hash(byte_values(np.frombuffer(text, np.uint8)))
                for part in range(row["tail"] // PART, lead // PART + 1):
                    low, high = part * PART, part * PART + PART - 1
                    shared = run_hash(sums, np.array([lead - low]), np.array([lead - high + LENGTH]))
                    name = int(mix(shared + np.uint64(part)).view(np.int64)[0])
                    start, stop = lead - min(high, lead), lead - max(low, row["tail"])
                    rows.append((name, row["around"], min(high, lead), max(low, row["tail"]), text[start : stop + LENGTH]))
                    skips.append(row["skip"] + start)
                if len(rows) >= TOGETHER:
                    yield _strings(rows, skips)
                    rows, skips = [], []
            if rows:
                yield _strings(rows, skips)

    return strings.mapInArrow(work, "class long, around long, lead int, tail int, skip int, bytes binary")


def start_names(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of all strings of ``LENGTH`` bytes in each neighbourhood, their neighbourhoods and starts.

    Names are made run by run, as a hash's arrays take many times the bytes.
    """
    names, lengths = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for run in slices(pa.RecordBatch.from_arrays([column], names=["bytes"]), "bytes") if len(column) else ():
        data, offsets = body_bytes(run.column("bytes"))
        sums = prefix_hash(byte_values(data))
        counts = np.diff(offsets) - LENGTH + 1
        at = np.arange(counts.sum()) + np.repeat(offsets[:-1] - np.cumsum(counts) + counts, counts)
        names.append(run_hash(sums, at, at + LENGTH))
        lengths.append(counts)
    counts = np.concatenate(lengths)
    owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    inside = np.arange(len(owner), dtype=np.int32) - np.repeat((np.cumsum(counts) - counts).astype(np.int32), counts)
    return np.concatenate(names), owner, inside


def repeated_runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs [start, stop) of starts whose string has a twin among all neighbourhoods given: sort names, compare neighbours."""
    name, owner, inside = start_names(column)
    order = np.argsort(name, kind="stable")
    name = name[order]
    equal = name[1:] == name[:-1]
    twin = np.zeros(len(name), bool)
    twin[order[1:][equal]] = True
    twin[order[:-1][equal]] = True
    return _runs(twin, owner, inside)


def _runs(chosen: np.ndarray, owner: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.flatnonzero(chosen)
    if not len(at):
        return at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (owner[at][1:] != owner[at][:-1]) | (inside[at][1:] != inside[at][:-1] + 1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(at)) - 1
    return owner[at[head]], inside[at[head]], inside[at[tail]] + 1


_RUNS = "around long, start int, stop int"


def _run_rows(table: pa.Table) -> pa.RecordBatch:
    strings = table.column("bytes").combine_chunks()
    strings = strings if isinstance(strings, pa.Array) else strings.chunk(0)
    owner, start, stop = repeated_runs(strings)
    skip = table.column("skip").to_numpy()[owner]
    return pa.RecordBatch.from_arrays(
        [pa.array(table.column("around").to_numpy()[owner]), pa.array((start + skip).astype(np.int32)), pa.array((stop + skip).astype(np.int32))],
        names=["around", "start", "stop"],
    )


def merged(strings: DataFrame) -> DataFrame:
    """``around, start, stop``: runs of repeated starts, from classes small enough to sort together."""

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in (piece for given in source for piece in _pieces(given)):
            held.append(batch)
            rows += batch.num_rows
            if rows < TOGETHER:
                continue
            table = pa.Table.from_batches(held)
            own = table.column("class").to_numpy()
            whole = int(np.searchsorted(own, own[-1]))
            if whole:
                yield _run_rows(table.slice(0, whole))
            held, rows = table.slice(whole).to_batches(), len(own) - whole
        if rows:
            yield _run_rows(pa.Table.from_batches(held))

    return strings.repartition("class").sortWithinPartitions("class").mapInArrow(work, _RUNS)


def counted(strings: DataFrame) -> DataFrame:
    """The same from classes of any size: every start's name is counted, partial counts first."""

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for given in source for piece in _pieces(given)):
            name, owner, inside = start_names(batch.column("bytes"))
            start = inside + batch.column("skip").to_numpy()[owner]
            yield pa.RecordBatch.from_arrays(
                [pa.array(name.view(np.int64)), batch.column("around").take(pa.array(owner)), pa.array(start.astype(np.int32))],
                names=["name", "around", "start"],
            )

    names = strings.mapInArrow(work, "name long, around long, start int")
    twins = names.groupBy("name").count().filter("count > 1").select("name")
    return names.join(twins, "name").select("around", "start", (F.col("start") + 1).alias("stop"))


def _by_size(strings: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Strings of classes to sort together, those of larger ones, and whether there are any."""
    sizes = strings.groupBy("class").count().filter("count > 1")
    sized = staged(strings.join(sizes, "class"), "strings")
    large = sized.filter(F.col("count") > CLASS).drop("count")
    return sized.filter(F.col("count") <= CLASS).drop("count"), large, bool(large.limit(1).count())


def repeated_starts(strings: DataFrame) -> DataFrame:
    small, large, any_large = _by_size(strings)
    found = merged(small)
    if any_large:
        small, large, any_large = _by_size(split(large))
        found = found.unionByName(merged(small))
        if any_large:
            found = found.unionByName(counted(large))
    return found


def spans(given: DataFrame) -> DataFrame:
    """``key, starts``: for each document with any, the runs [start, stop) of repeated starts."""
    rows = sample(given)
    shared = rows.groupBy("triple").agg(F.count("*").alias("n"), F.min("around").alias("low"), F.max("around").alias("high"))
    shared = shared.filter("n > 1").select("triple", (F.col("low") != F.col("high")).alias("differ"))
    rows = staged(rows.join(shared, "triple"), "suffixes")
    arounds = rows.groupBy("around").agg(
        F.count("*").alias("n"), F.min(F.struct("key", "first")).alias("at"), F.bool_or("differ").alias("differ")
    )
    arounds = staged(arounds, "arounds")
    # One of each neighbourhood, where its triple has others: the twin of a start may stand in any of them.
    places = arounds.filter("differ").groupBy("at.key").agg(F.sort_array(F.collect_list(F.struct("at.first", "around"))).alias("places"))
    runs = repeated_starts(neighbourhoods(flagged(given, places).filter("maybe"), places))
    alone = arounds.filter("n = 1").select("around")
    twins = arounds.filter("n > 1").select("around")
    whole = rows.join(twins, "around").select("key", F.col("first").alias("start"), (F.col("last") + 1).alias("stop"))
    partly = rows.join(runs.join(alone, "around", "left_semi"), "around").select(
        "key", (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("stop")).alias("stop")
    )
    return whole.unionByName(partly).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("starts"))


def cut(body: bytes, starts: list[dict[str, int]]) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed, and the maximal runs they form."""
    left, removed, runs, done = [], 0, 0, 0
    end = -1
    for run in starts:
        start, stop = run["start"], run["stop"] + LENGTH - 1
        if start > end:
            runs += 1
            left.append(body[done:start])
            removed += stop - start
        elif stop > end:
            removed += stop - end
        end = max(end, stop)
        done = end
    left.append(body[done:])
    return b"".join(left), removed, runs


def without_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (bytes) for every input row.

    A null text counts as empty; texts of fewer than ``LENGTH`` bytes are left
    whole. Repeated rows are documents of their own, so a long one is removed
    from both. Strings are judged on the input and never cross texts. Extra
    columns are ignored; an empty table gives an empty result. Cuts may fall
    inside a character, hence bytes.
    """
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    given = docs.select("doc_id", body.alias("body"), F.xxhash64("doc_id", body).alias("key"))
    found = staged(spans(given), "spans")
    rows = flagged(given, found)
    kind = given.schema["doc_id"].dataType.simpleString()

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (run for given in source for run in slices(given, "body")):
            starts = batch.column("starts").to_pylist()
            made = [cut(t, s or []) for t, s in zip(batch.column("body").to_pylist(), starts, strict=True)]
            kept, removed, runs = zip(*made, strict=True) if made else ([], [], [])
            sizes = np.diff(body_offsets(batch.column("body")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    joined = rows.filter("maybe").join(found, "key", "left").select("doc_id", "body", "starts")
    removed = joined.mapInArrow(work, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    zero = F.lit(0).cast("long")
    whole = rows.filter(~F.col("maybe")).select(
        "doc_id", F.octet_length("body").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("body").alias("kept")
    )
    return removed.unionByName(whole)
