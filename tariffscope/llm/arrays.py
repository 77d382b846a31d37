"""Words of a batch of texts as numpy arrays: positions, documents and 64-bit hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: ASCII white space, the separators between words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[bool, np.ndarray] = {}


def powers(size: int, inverse: bool = False) -> np.ndarray:
    """Powers of the hash base (or of its inverse) modulo 2**64, at least ``size`` of them; kept and grown."""
    if len(_POWERS.get(inverse, ())) < size:
        steps = np.full(1 << max(int(size - 1).bit_length(), 12), _BASE_INVERSE if inverse else _BASE, np.uint64)
        steps[0] = 1
        _POWERS[inverse] = np.multiply.accumulate(steps)
    return _POWERS[inverse]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of ``values[i] * base**i``: any run's hash is a difference of two, see ``run_hash``."""
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * powers(len(values) + 1)[: len(values)], out=sums[1:])
    return sums


def run_hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of each run [start, stop), the same wherever the run stands."""
    return mix((sums[stop] - sums[start]) * powers(len(sums), True)[start])


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[data]


@dataclass
class Words:
    """Words of a batch in order; ``first[d]:first[d + 1]`` are those of document d."""

    start: np.ndarray
    stop: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> Words:
    """Runs of bytes that aren't ASCII white space; texts never share a word."""
    documents = len(offsets) - 1
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(documents + 1, np.int64), np.zeros(0, np.uint64))
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    first = np.searchsorted(start, offsets)
    sums = prefix_hash(byte_values(FOLD[data] if fold else data))
    return Words(start, stop, doc, first, run_hash(sums, start, stop))
