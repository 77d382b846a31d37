"""Documents packed into sequences of one length, by the histogram of piece lengths.

Every document is tokenized and cut into full sequences and one remainder. The
histogram of remainders (at most ``SEQUENCE - 1`` lengths, whatever the corpus)
is packed on the driver: lengths go longest first, each into the pattern with
the most room left, and patterns carry counts. Remainders then find their place
by their rank among those of the same length.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tariffscope.llm.common import slices, staged

SEQUENCE = 2048
END_ID = 1
#: Words whose ids a worker remembers; beyond it the memory starts anew.
REMEMBERED = 500_000
LONGEST_REMEMBERED = 64

_WORD_IDS: dict[str, "WordIds"] = {}


class WordIds:
    """Ids of white-space separated words, as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never joins what it separates, so a
    text's ids are those of its words. Lower-casing A-Z first unites words; it is
    skipped where a special token's spelling may stand.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def learn(self, unknown: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words, asked for in lines of words so that one call serves many."""
        lines = [unknown[i : i + 64] for i in range(0, len(unknown), 64)]
        parts = [[w.decode() for w in line] for line in lines]
        found = self.tokenizer.encode_batch(parts, is_pretokenized=True, add_special_tokens=False)
        made = {}
        for line, encoded in zip(lines, found, strict=True):
            ids = np.array(encoded.ids, "<u4")
            owner = np.array(encoded.word_ids, dtype=np.float64)
            edges = np.searchsorted(owner, np.arange(len(line) + 1))
            raw = ids.tobytes()
            for k, word in enumerate(line):
                made[word] = raw[4 * edges[k] : 4 * edges[k + 1]]
        return made

    def of(self, texts: list[bytes]) -> list[bytes]:
        split = [None if b"<|" in t else t.lower().split() for t in texts]
        seen: set[bytes] = set()
        for words in split:
            if words:
                seen.update(words)
        unknown = [w for w in seen if w not in self.known]
        extra = self.learn([w for w in unknown if len(w) <= LONGEST_REMEMBERED])
        if len(self.known) + len(extra) > REMEMBERED:
            extra |= {w: self.known[w] for w in seen if w in self.known}
            self.known = {}
        self.known |= extra
        long = [w for w in unknown if len(w) > LONGEST_REMEMBERED]
        more = dict(zip(long, self._encode([w.decode() for w in long]), strict=True))
        get = self.known.__getitem__ if not more else {**{w: self.known[w] for w in seen if w in self.known}, **more}.__getitem__
        return [
            self._encode([text.decode()])[0] if words is None else b"".join(map(get, words))
            for text, words in zip(texts, split, strict=True)
        ]


def word_ids(path: str) -> WordIds:
    """One per worker process and vocabulary."""
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of every document: full sequences and a remainder, with the task's own rank by length.

    ``part`` and ``part_rank`` number the pieces of one length within a task; they
    are written before they are used, so a repeated task can't change them.
    """
    end = np.array([END_ID], "<u4").tobytes()
    given = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body"))
    kind = given.schema["doc_id"].dataType.simpleString()

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, part, seen = word_ids(tokenizer), TaskContext.get().partitionId(), defaultdict(int)
        for batch in source:
            for run in slices(batch, "body", 4 << 20):
                rows = []
                for at, raw in enumerate(ids.of(run.column("body").to_pylist())):
                    raw += end
                    tokens = len(raw) // 4
                    for start in range(0, tokens, sequence):
                        length = min(sequence, tokens - start)
                        rows.append((at, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), tokens, seen[length]))
                        seen[length] += 1
                table = np.array(rows, np.int64).reshape(-1, 6)
                yield pa.RecordBatch.from_arrays(
                    [run.column("doc_id").take(pa.array(table[:, 0])), *(pa.array(table[:, c]) for c in range(1, 6)),
                     pa.array(np.full(len(table), part, np.int64))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part_rank", "part"],
                )

    return given.mapInArrow(
        cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part_rank long, part long"
    )


@dataclass
class Layout:
    """Where the pieces of each length go: ``length -> (first rank, first sequence, pieces of it there, offset)``."""

    slots: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    sequences: int = 0
    padding: int = 0


def shortest_pack_first(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[list[int], int]]:
    """Patterns (lengths, longest first) and how many sequences follow each.

    A length goes into the pattern with the most room left; where that pattern
    has more sequences than pieces are left, it is split in two.
    """
    by_room: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        room = sequence
        while left:
            while room >= length and not by_room.get(room):
                room -= 1
            if room < length:
                by_room[sequence - length].append(([length], left))
                break
            pattern, count = by_room[room].pop()
            used = min(left, count)
            if count > used:
                by_room[room].append((pattern, count - used))
            by_room[room - length].append(([*pattern, length], used))
            left -= used
    return [entry for room in sorted(by_room) for entry in by_room[room]]


def lay_out(histogram: dict[int, int], sequence: int = SEQUENCE) -> Layout:
    layout = Layout(slots=defaultdict(list))
    used: dict[int, int] = defaultdict(int)
    for pattern, count in shortest_pack_first(histogram, sequence):
        offset = 0
        for length in dict.fromkeys(pattern):
            times = pattern.count(length)
            layout.slots[length].append((used[length], layout.sequences, times, offset))
            used[length] += times * count
            offset += times * length
        layout.sequences += count
        layout.padding += (sequence - offset) * count
    return layout


def place(cut: DataFrame, layout: Layout) -> DataFrame:
    """Pieces with ``rank`` (among those of their length) get ``sequence_id`` and ``offset``."""
    tables = {length: np.array(slots, np.int64) for length, slots in layout.slots.items()}
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def lookup(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            where = np.zeros((len(length), 2), np.int64)
            for value in np.unique(length):
                own = np.flatnonzero(length == value)
                table = tables[int(value)]
                row = table[np.searchsorted(table[:, 0], rank[own], side="right") - 1]
                inside = rank[own] - row[:, 0]
                where[own, 0] = row[:, 1] + inside // row[:, 2]
                where[own, 1] = row[:, 3] + inside % row[:, 2] * value
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(where[:, 0]), pa.array(where[:, 1])],
                names=[*names, "sequence_id", "offset"],
            )

    kind = cut.schema["doc_id"].dataType.simpleString()
    return cut.select(*names, "rank").mapInArrow(
        lookup,
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece with its sequence and offset there.

    A null or empty text is the end id alone. Repeated rows and ids are separate
    documents, ties in length go by rank, extra columns are ignored, an empty
    table gives an empty result. A text of any length is cut into pieces.
    """
    cut = staged(pieces(docs, tokenizer, sequence), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = cut.join(first, ["length", "part"]).withColumn("rank", F.col("part_rank") + F.col("base"))
    # At most one row per length: bounded by the sequence length.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    return place(ranked, lay_out(histogram, sequence))
