"""Periodic runs of words, caught online by dyadic catchers.

A run is a maximal stretch of words with smallest period q and at least max(``least``, ``times`` * q) words (``times`` is 4 or more).
For every power of two L, each completed block of L words is a catcher for squares of period L to 2L - 1: it watches the L windows of
L words that start L to 2L - 1 words after it. So an appended word completes one window at each level, and each window is compared
with a single catcher by name: windows of 2L words are named by the names of their halves, so that two windows are equal where
their names are (64 bits; what is reported is verified word by word). A catch is a piece of a square of period p. It is extended
to both sides by comparing names of falling length, which gives the whole stretch of period p that has been read so far.

Stretches that reach the end of the stream stay active: each append advances them first, and they are reported once they are long
enough. Catches within a known run of a smaller period are squares of its powers and add nothing; catches of one period and one
stretch merge. A long stretch has its period as smallest one unless a run of smaller period covers it (Fine and Wilf), so exactly
the runs are found. Work is O(n log n) comparisons of names and O(log n) for each catch, memory O(log n) names a word.

Texts are appended whole, many of them to one stream, parted by words that occur once, so no run crosses documents. Each text is
read by one task, and nothing is shuffled. Null texts have no words; a null id stays null and its words are taken as they are;
repeated rows are computed each; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkflow.llm.batches import by_bytes, mix, strings, text_or_empty

#: Words appended at once, and bytes of text that share a stream.
APPEND = 1 << 18
STREAM = 2 << 20
#: Codes from here on part the texts of a stream.
PART = 1 << 63
HALVES = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
SCHEMA = "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Names:
    """Names of the windows of one length, by their first word; the array grows by doubling."""

    def __init__(self):
        self.data, self.n = np.zeros(1024, np.uint64), 0

    def extend(self, values: np.ndarray) -> None:
        n = self.n + len(values)
        if n > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(n - len(self.data), len(self.data)), np.uint64)])
        self.data[self.n : n] = values
        self.n = n


class Catchers:
    """The runs of a stream of words (codes of 64 bits) that is appended in pieces of any size.

    ``longest`` says that no run has more words, where that is known: it bounds the levels.
    """

    def __init__(self, times: int = 4, least: int = 6, longest: int | None = None):
        if times < 4:
            raise ValueError("catchers need runs of at least four periods")
        self.times, self.least, self.longest = times, least, longest
        self.n = 0
        self.words = Names()
        self.levels: list[Names] = []
        self.active: set[tuple[int, int, int]] = set()  # (period, start, end) of stretches that reach the end
        self.ends: dict[tuple[int, int], int] = {}  # runs by start and period

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs so far, by start and period."""
        return [(start, end - start, period) for (start, period), end in sorted(self.ends.items())]

    def append(self, words: np.ndarray) -> None:
        self.words.extend(words.astype(np.uint64))
        self.n = self.words.n
        most = min(self.n, self.longest or self.n) // self.times
        fresh = [self._name(level) for level in range(most.bit_length())]
        if not fresh:
            return
        moving, self.active = sorted(self.active), set()
        for period, start, end in moving:
            grown = int(self._forward(np.array([end - period]), np.array([end]))[0])
            if not any(q < period and a <= start and b >= grown for (a, q), b in self.ends.items()):
                self._offer(start, grown, period)
        for level, since in enumerate(fresh):
            self._watch(level, since)

    def _name(self, level: int) -> int:
        """Name the windows of 2 ** level words that are complete now; the first of them."""
        if level == len(self.levels):
            self.levels.append(Names())
        own = self.levels[level]
        since, until = own.n, self.n - (1 << level) + 1
        if level == 0:
            own.extend(mix(self.words.data[since:until] + HALVES[0]))
        elif until > since:
            half, below = 1 << level - 1, self.levels[level - 1].data
            named = below[since:until] * HALVES[0] + below[since + half : until + half] * HALVES[1]
            own.extend(named ^ (named >> np.uint64(31)))
        return since

    def _watch(self, level: int, since: int) -> None:
        """Compare each new window of a level with its catcher, the last but one block before it."""
        size, own = 1 << level, self.levels[level]
        since = max(since, size)
        if since >= own.n:
            return
        first, last = since // size - 1, (own.n - 1) // size - 1
        blocks = np.repeat(own.data[first * size : last * size + 1 : size], size)
        offset = since - (first + 1) * size
        t = since + np.flatnonzero(own.data[since : own.n] == blocks[offset : offset + own.n - since])
        if not len(t):
            return
        s = (t // size - 1) * size
        covers = self._covers(size)
        fresh = ~self._covered(covers, s, t + size)
        s, t = s[fresh], t[fresh]
        # Neighbouring catchers that catch the same period belong to one stretch.
        order = np.lexsort((s, t - s))
        s, t = s[order], t[order]
        chained = np.zeros(len(s), bool)
        chained[1:] = (s[1:] == s[:-1] + size) & (t[1:] - s[1:] == t[:-1] - s[:-1])
        s, t = s[~chained], t[~chained]
        if not len(s):
            return
        period, start, end = t - s, self._backward(s, t), self._forward(s + size, t + size)
        wanted = (end - start >= np.maximum(self.least, self.times * period)) | (end == self.n)
        wanted &= ~self._covered(covers, start, end)
        for found in {*zip(start[wanted].tolist(), end[wanted].tolist(), period[wanted].tolist(), strict=True)}:
            self._offer(*found)

    def _covers(self, below: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the runs of smaller periods, and the last end of the runs up to each."""
        spans = sorted((start, end) for (start, period), end in self.ends.items() if period < below)
        starts, ends = np.array([a for a, _ in spans], np.int64), np.array([b for _, b in spans], np.int64)
        return starts, np.maximum.accumulate(ends) if len(ends) else ends

    @staticmethod
    def _covered(covers: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
        starts, ends = covers
        if not len(starts):
            return np.zeros(len(start), bool)
        at = np.searchsorted(starts, start, "right") - 1
        return (at >= 0) & (ends[np.maximum(at, 0)] >= end)

    def _offer(self, start: int, end: int, period: int) -> None:
        """Keep a stretch that reaches the end, and report it once it is a run, word by word."""
        if end == self.n:
            self.active.add((period, start, end))
        if end - start < max(self.least, self.times * period):
            return
        words = self.words.data
        same = words[start : end - period] == words[start + period : end]
        cuts = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
        for a, b in zip(cuts[::2].tolist(), cuts[1::2].tolist(), strict=True):
            if b - a + period >= max(self.least, self.times * period):
                self.ends[start + a, period] = start + b + period

    def _forward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The first position from ``y`` on whose word differs from that as far after ``x``, or the end."""
        x, y = x.copy(), y.copy()
        top = len(self.levels) - 1
        for level in range(top, -1, -1):
            own, size = self.levels[level].data, 1 << level
            at = np.flatnonzero(y + size <= self.n)
            while len(at):
                at = at[own[x[at]] == own[y[at]]]
                x[at] += size
                y[at] += size
                at = at[y[at] + size <= self.n] if level == top else at[:0]
        return y

    def _backward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How far before ``x`` the words still equal those before ``y``: the first such position."""
        x, y = x.copy(), y.copy()
        top = len(self.levels) - 1
        for level in range(top, -1, -1):
            own, size = self.levels[level].data, 1 << level
            at = np.flatnonzero(x >= size)
            while len(at):
                at = at[own[x[at] - size] == own[y[at] - size]]
                x[at] -= size
                y[at] -= size
                at = at[x[at] >= size] if level == top else at[:0]
        return x


def repeated_tail(words: list[bytes], key: int | None) -> list[bytes]:
    """Words that repeat from some word on, for one id in ten: which, from where and how long follow from crc32 of the id."""
    if key is None or not words:
        return words
    code, n = zlib.crc32(str(key).encode()), len(words)
    if code % 10:
        return words
    g = code // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    times = -(-(n - start) // period)
    return words[:start] + (words[start : start + period] * times)[: n - start]


def stream_runs(texts: list[list[bytes]], times: int, least: int) -> list[list[tuple[int, int, int]]]:
    """The runs of every text, caught in one stream."""
    longest = max(map(len, texts), default=0)
    catchers = Catchers(times, least, max(longest, 1))
    vocabulary: defaultdict = defaultdict(count().__next__)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    codes = np.empty(int(sizes.sum()) + len(texts), np.uint64)
    for k, (at, words) in enumerate(zip(starts.tolist(), texts, strict=True)):
        codes[at : at + len(words)] = np.fromiter(map(vocabulary.__getitem__, words), np.uint64, len(words))
        codes[at + len(words)] = PART + k
    for at in range(0, len(codes), APPEND):
        catchers.append(codes[at : at + APPEND])
    found: list = [[] for _ in texts]
    for start, length, period in catchers.runs():
        k = int(np.searchsorted(starts, start, "right")) - 1
        found[k].append((start - int(starts[k]), length, period))
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return b" ".join(compress(words, (np.cumsum(edges[:-1]) == 0).tolist()))


def periodic_runs(
    docs: DataFrame, times: int = 4, least: int = 6, rebuild: Callable[[list, int | None], list] | None = None, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(key, n_words, runs, collapsed) of every row: runs by start and period, and the text with each run cut to one period.

    ``rebuild`` changes the words (bytes) of a text before, given its id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", STREAM):
            ids = batch.column(0).to_pylist()
            texts = [t.encode().split() for t in strings(batch.column(1))]
            if rebuild is not None:
                texts = [rebuild(words, i) for words, i in zip(texts, ids, strict=True)]
            found = stream_runs(texts, times, least)
            flat = [dict(zip(("start", "length", "period"), r, strict=True)) for own in found for r in own]
            offsets = np.concatenate([[0], np.cumsum([len(own) for own in found])])
            runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, RUNS.value_type))
            kept = [collapsed(words, own) for words, own in zip(texts, found, strict=True)]
            columns = [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), runs, pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(key).cast("long").alias("id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, SCHEMA).withColumnRenamed("id", key)
