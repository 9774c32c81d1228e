"""Words of Arrow text columns as 64-bit hashes, whole columns at a time.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased. Its hash is a
polynomial over random byte values, taken from running sums, so that no word becomes a Python
object. Equal words have equal hashes; different words collide with a chance of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLDED = _VALUES.copy()
_FOLDED[65:91] = _VALUES[97:123]
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2^64; grows by doubling and stays for the next chunk."""
    have = _powers.get(base)
    if have is None:
        have = np.ones(1, np.uint64)
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    if len(have) <= 4 * CHUNK_BYTES:
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """Hashes of data[start:end] for every span."""
    values = (_FOLDED if fold else _VALUES)[data]
    values *= _power(_BASE, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    hashed = (sums[ends] - sums[starts]) * _power(_BASE_INVERSE, len(data) + 1)[starts]
    return mix(hashed + (ends - starts).astype(np.uint64))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string()).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8), offsets


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about the given number of bytes; a longer row makes a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def spans(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without a separator; bounds: where rows begin (runs end there)."""
    inside = ~separator[data]
    padded = np.zeros(len(data) + 2, np.int8)
    padded[1:-1] = inside
    step = np.diff(padded)
    starts, ends = step[:-1] == 1, step[1:] == -1
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    starts[inner] = inside[inner]
    ends[inner - 1] = inside[inner - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row exclusive, word hashes, row of each word) for chunks of a text column."""
    data, offsets = text_buffers(column)
    for first, last in row_chunks(offsets):
        low = offsets[first]
        piece, bounds = data[low:offsets[last]], offsets[first:last + 1] - low
        starts, ends = spans(piece, bounds)
        rows = np.searchsorted(bounds, starts, side="right") - 1 + first
        yield first, last, span_hashes(piece, starts, ends), rows


def row_starts(rows: np.ndarray, first: int, last: int) -> np.ndarray:
    """Where the words of rows first .. last begin in a chunk, with the end."""
    return np.searchsorted(rows, np.arange(first, last + 1))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct hashes of all runs of so many words, sorted; fewer words make one run of all."""
    if not len(words):
        return np.zeros(0, np.uint64)
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(_BASE) + words[i:i + len(out)])
    return np.unique(out)


def union_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each vertex's component, for edges a-b over 0 .. n - 1."""
    labels = np.arange(n)
    while len(a):
        low = np.minimum(labels[a], labels[b])
        fresh = labels.copy()
        np.minimum.at(fresh, a, low)
        np.minimum.at(fresh, b, low)
        np.minimum.at(fresh, labels[a], low)
        np.minimum.at(fresh, labels[b], low)
        fresh = fresh[fresh]
        if (fresh == labels).all():
            break
        labels = fresh
    return labels
