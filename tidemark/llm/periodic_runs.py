"""Periodic runs of words: equal minimizers one period apart seed runs, lag scans find the short periods."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from tidemark.llm.training import free_name, with_column
from tidemark.llm.words import row_chunks, span_hashes, spans, text_buffers

# A run has this many words, and this many periods, at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
# Periods up to here are found by comparing all words at that lag; each scale above covers periods from P to less than P * RATIO.
SHORT, RATIO = 8, 1.5
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = 0x9E3779B97F4A7C15

Run = tuple[int, int, int]


def _slide(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The best of every ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        values = best(values[:-have], values[have:])
        have *= 2
    return best(values[:len(values) - (width - have)], values[width - have:]) if have < width else values


def _gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` successive words, by doubling: a gram is two overlapping halves of equal length."""
    have, out = 1, words
    while 2 * have <= size:
        out = (out[:-have] * np.uint64(_STEP)) ^ (out[have:] + (out[:-have] >> np.uint64(29)))
        out = out * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        have *= 2
    if have < size:
        tail = out[size - have:]
        out = (out[:len(tail)] * np.uint64(_STEP)) ^ (tail + (out[:len(tail)] >> np.uint64(29)))
        out = out * np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(32)
    return out


def _seeds(words: np.ndarray, rows: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance): equal minimizers of one text at the distances low .. high, next to each other.

    A minimizer is a gram of ``high`` words with the least hash of a window of grams. Inside a run no two
    grams less than a period apart are equal, and windows a period apart have the same minimizers. Two
    such windows fit into every run of three periods of ``low`` words or more, so it has a pair here.
    """
    width = 2 * low - high + 1
    grams = _gram_hashes(words, high)
    whole = rows[:len(grams)] == rows[high - 1:]
    grams = np.where(whole, grams, _LAST)
    if len(grams) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = _slide(grams, width, np.minimum)
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    place = np.flatnonzero((_slide(padded, width, np.maximum) == grams) & whole)
    order = np.argsort(grams[place], kind="stable")
    place = place[order]
    gap = np.diff(place)
    near = (grams[place[1:]] == grams[place[:-1]]) & (rows[place[1:]] == rows[place[:-1]]) & (gap >= low) & (gap <= high)
    return place[:-1][near], gap[near]


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the first words of two stretches agree, looking at twice as many each time."""
    done, size = 0, 64
    n = min(len(a), len(b))
    while done < n:
        upto = min(n, done + size)
        differ = a[done:upto] != b[done:upto]
        if differ.any():
            return done + int(differ.argmax())
        done, size = upto, 2 * size
    return n


def _extended(words: np.ndarray, bounds: np.ndarray, rows: np.ndarray, place: np.ndarray, gap: np.ndarray) -> list[Run]:
    """(start, end, period) of the stretches around the seeds; a seed inside its period's last stretch is done."""
    found = []
    order = np.lexsort((place, gap))
    last_gap = upto = -1
    for m, d in zip(place[order].tolist(), gap[order].tolist()):
        if d != last_gap:
            last_gap, upto = d, -1
        if m < upto:
            continue
        row = rows[m]
        low, high = int(bounds[row]), int(bounds[row + 1])
        right = m + _reach(words[m:high - d], words[m + d:high])
        left = m - _reach(words[low:m][::-1], words[low + d:m + d][::-1])
        upto = max(right, m + 1)
        if right + d - left >= max(LEAST_WORDS, LEAST_PERIODS * d):
            found.append((left, right + d, d))
    return found


def _short(words: np.ndarray, rows: np.ndarray) -> list[Run]:
    """Runs whose period is SHORT at most, from one comparison of all words for each lag."""
    found = []
    for d in range(1, min(SHORT, len(words) - 1) + 1):
        same = np.zeros(len(words) - d + 2, np.int8)
        same[1:-1] = (words[d:] == words[:-d]) & (rows[d:] == rows[:-d])
        turn = np.diff(same)
        starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        enough = ends + d - starts >= max(LEAST_WORDS, LEAST_PERIODS * d)
        found += [(s, e + d, d) for s, e in zip(starts[enough].tolist(), ends[enough].tolist())]
    return found


def runs_of(words: np.ndarray, bounds: np.ndarray) -> list[list[Run]]:
    """For each text its runs (start, length, period) by start, then period.

    words: the words of consecutive texts as numbers; bounds: where each text begins, and the end. A run
    that is also periodic at a divisor of its lag is the same stretch as that shorter period's run,
    because it holds three periods; the smallest period of a stretch is kept.
    """
    counts = np.diff(bounds)
    rows = np.repeat(np.arange(len(counts)), counts)
    found = _short(words, rows)
    low = SHORT + 1
    while LEAST_PERIODS * low <= (counts.max() if len(counts) else 0):
        high = max(low, math.ceil(low * RATIO) - 1)
        long_ = counts >= LEAST_PERIODS * low
        kept = long_[rows]
        own_counts = counts[long_]
        own_bounds = np.r_[0, np.cumsum(own_counts)]
        own_words, own_rows = words[kept], np.repeat(np.arange(len(own_counts)), own_counts)
        shift = bounds[:-1][long_] - own_bounds[:-1]
        place, gap = _seeds(own_words, own_rows, low, high)
        if len(place):
            for s, e, d in _extended(own_words, own_bounds, own_rows, place, gap):
                by = int(shift[own_rows[s]])
                found.append((s + by, e + by, d))
        low = high + 1
    smallest: dict[tuple[int, int], int] = {}
    for s, e, d in found:
        smallest[s, e] = min(d, smallest.get((s, e), d))
    out: list[list[Run]] = [[] for _ in counts]
    for (s, e), d in sorted(smallest.items(), key=lambda x: (x[0][0], x[1])):
        row = int(rows[s])
        out[row].append((s - int(bounds[row]), e - s, d))
    return out


def _kept(n: int, runs: list[Run]) -> np.ndarray:
    """Which words stay: those that no run holds after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:-1]) == 0


_RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])


def _pieces(column: pa.Array) -> Iterator[pa.Array]:
    data, offsets = text_buffers(column)
    kind = pa.struct([pa.field("runs", pa.list_(pa.struct([pa.field(c, pa.int64(), False) for c in ("start", "length", "period")]))),
                      pa.field("collapsed", pa.string())])
    for first, last in row_chunks(offsets):
        low = offsets[first]
        piece, at = data[low:offsets[last]], offsets[first:last + 1] - low
        starts, ends = spans(piece, at)
        bounds = np.searchsorted(starts, at)
        found = runs_of(span_hashes(piece, starts, ends, fold=False), bounds)
        made = []
        for i, runs in enumerate(found):
            words = piece[at[i]:at[i + 1]].tobytes().split()
            if any(words[s:s + n - p] != words[s + p:s + n] for s, n, p in runs):  # two words share a hash
                number = {w: j for j, w in enumerate(words)}
                runs = runs_of(np.array([number[w] for w in words], np.uint64), np.array([0, len(words)]))[0]
            if runs:
                keep = _kept(len(words), runs)
                words = [words[j] for j in np.flatnonzero(keep)]
            made.append({"runs": [dict(zip(("start", "length", "period"), r)) for r in runs], "collapsed": b" ".join(words).decode("utf-8")})
        yield pa.array(made, kind)


def find_runs(docs: DataFrame, text_col: str = "text", runs_col: str = "runs", collapsed_col: str = "collapsed") -> DataFrame:
    """The rows with their periodic runs, array of (start, length, period), and their text without the repeats.

    Words are runs of characters other than space and 0x09-0x0D, compared as they are and numbered from 0.
    A run is a stretch of words in which words a period apart are equal, of LEAST_WORDS words and
    LEAST_PERIODS periods at least, with its smallest period, which no neighbouring word extends. They come
    by start, then period. The collapsed text joins by one space the words that no run holds after its
    first period. Null, empty and blank texts have no runs and an empty collapsed text; repeated rows are
    alike; columns pass through, but those called like the two made ones are replaced. An empty table
    gives no rows. One text is looked at in one task, with memory in proportion to its length.
    """
    docs = docs.drop(runs_col, collapsed_col)
    made = free_name(docs, "found_runs")
    kind = T.StructType([T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())])
    out = with_column(docs, text_col, made, kind, _pieces)
    return out.withColumns({runs_col: out[made]["runs"], collapsed_col: out[made]["collapsed"]}).drop(made)
