"""Quality rules over words, lines and repeated passages of each document.

Repetition comes from a suffix array over each document's words. Suffixes are
sorted by doubling: only those whose rank is still shared go into the next
round. Neighbours' longest common prefixes then bound every maximal repeated
substring; the union of their spans gives the covered words, the largest prefix
the longest repeat.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tariffscope.llm.arrays import Words, prefix_hash, run_hash, words
from tariffscope.llm.common import add_columns, body_bytes

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
WINDOW = 3

COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_words long, longest_repeat long, base_failed boolean, kept boolean"
)


@dataclass(frozen=True)
class Rules:
    """Limits of the verdict. Repeats shorter than ``min_repeat`` words don't count as passages."""

    min_words: int = 50
    max_window_share: float = 0.5
    min_repeat: int = 8
    max_covered_share: float = 0.45
    max_longest: int = 100


def suffix_array(doc: np.ndarray, stop: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Order of all suffixes, document by document; a suffix ends with its document.

    ``doc`` and ``stop`` give each position's document and that document's end.
    """
    size = len(value)
    order = np.lexsort((value, doc))
    rank = np.empty(size, np.int64)
    fresh = np.ones(size, bool)
    fresh[1:] = (doc[order][1:] != doc[order][:-1]) | (value[order][1:] != value[order][:-1])
    heads = np.flatnonzero(fresh)
    rank[order] = heads[np.cumsum(fresh) - 1]
    span = 1
    open_at = _shared(order, fresh)
    while len(open_at):
        ahead = open_at + span
        follow = np.where(ahead < stop[open_at], rank[np.minimum(ahead, size - 1)] + 1, 0)
        base = rank[open_at]
        by = np.lexsort((follow, base))
        open_at, base, follow = open_at[by], base[by], follow[by]
        group = np.ones(len(by), bool)
        group[1:] = base[1:] != base[:-1]
        fresh = group.copy()
        fresh[1:] |= follow[1:] != follow[:-1]
        at = np.arange(len(by))
        inside = at - at[group][np.cumsum(group) - 1]
        rank[open_at] = (base + inside)[fresh][np.cumsum(fresh) - 1]
        open_at = _shared(open_at, fresh)
        span *= 2
    result = np.empty(size, np.int64)
    result[rank] = np.arange(size)
    return result


def _shared(order: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Members of groups with more than one suffix."""
    last = np.ones(len(fresh), bool)
    last[:-1] = fresh[1:]
    return order[~(fresh & last)]


def common_prefixes(order: np.ndarray, doc: np.ndarray, stop: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Words shared by each suffix in ``order`` and the one before it; 0 across documents."""
    shared = np.zeros(len(order), np.int64)
    left, right = order[:-1], order[1:]
    pair = np.flatnonzero((doc[left] == doc[right]) & (value[left] == value[right]))
    left, right = left[pair], right[pair]
    sums = prefix_hash(value)
    most = np.minimum(stop[left] - left, stop[right] - right)
    low = np.ones(len(pair), np.int64)
    # Grow by doubling while the runs agree, then halve back.
    step, live = 1, np.arange(len(pair))
    high = most.copy()
    while len(live):
        reach = np.minimum(low[live] + step, most[live])
        same = run_hash(sums, left[live], left[live] + reach) == run_hash(sums, right[live], right[live] + reach)
        high[live[~same]] = reach[~same] - 1
        low[live[same]] = reach[same]
        live = live[same & (reach < most[live])]
        step *= 2
    live = np.flatnonzero(low < high)
    while len(live):
        middle = (low[live] + high[live] + 1) // 2
        same = run_hash(sums, left[live], left[live] + middle) == run_hash(sums, right[live], right[live] + middle)
        low[live[same]] = middle[same]
        high[live[~same]] = middle[~same] - 1
        live = live[low[live] < high[live]]
    shared[pair + 1] = low
    return shared


def longest_from(w: Words) -> np.ndarray:
    """For each word, the length in words of the longest repeat that starts there."""
    found = np.zeros(len(w.hash), np.int64)
    if not len(found):
        return found
    stop = w.first[w.doc + 1]
    order = suffix_array(w.doc, stop, w.hash)
    shared = common_prefixes(order, w.doc, stop, w.hash)
    after = np.zeros(len(shared), np.int64)
    after[:-1] = shared[1:]
    found[order] = np.maximum(shared, after)
    return found


def covered(length: np.ndarray, least: int) -> np.ndarray:
    """Words inside the union of the repeats of ``least`` words or more."""
    size = len(length)
    start = np.flatnonzero(length >= least)
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, start, 1)
    np.add.at(edges, start + length[start], -1)
    return np.cumsum(edges[:-1]) > 0


def per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def measure(bodies: pa.Array, rules: Rules) -> dict[str, object]:
    data, offsets = body_bytes(bodies)
    w = words(data, offsets)
    n_words = np.diff(w.first)
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.stop, -1)
    inside = np.cumsum(inside[:-1]) > 0
    length = longest_from(w)
    repeat = per_document(covered(np.minimum(length, WINDOW), WINDOW), w.first)
    passages = per_document(covered(length, rules.min_repeat), w.first)
    longest = np.zeros(len(offsets) - 1, np.int64)
    np.maximum.at(longest, w.doc, length)
    failed = (n_words < rules.min_words) | (repeat > rules.max_window_share * n_words)
    bad = (passages > rules.max_covered_share * n_words) | (longest > rules.max_longest)
    return {
        "n_words": n_words,
        "word_chars": per_document(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": per_document(SYMBOLS[data], offsets),
        "n_dup_lines": [repeated_lines(body.as_py()) for body in bodies],
        "n_repeat_words": repeat,
        "covered_words": passages,
        "longest_repeat": longest,
        "base_failed": failed,
        "kept": ~(failed | bad),
    }


def judge(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Every input row as ``row`` with its measures and the verdict ``kept``.

    Null and empty texts have no words and fail. Repeated rows are judged one by
    one, extra columns stay inside ``row``, an empty table gives an empty result.
    A text is judged whole, whatever its length.
    """
    return add_columns(docs, COLUMNS, lambda bodies: measure(bodies, rules))


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Rows of ``docs`` that pass, with the same columns."""
    return judge(docs, rules).filter("kept").select("row.*")
