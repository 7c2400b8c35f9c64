"""Packing: multiway differencing of token pieces into windows.

Every document becomes ids and one end id. Whole windows of it are sequences by themselves; what is left is cut into pieces of
at most ``piece`` tokens. Pieces that follow each other in a partition form a group of about ``windows`` windows, and the group
is dealt by Karmarkar-Karp differencing: each piece starts as a partition (length, 0, 0, ...); the two partitions whose parts
differ most are merged, largest part to smallest, until one is left. If a part exceeds the capacity, the count of windows
rises by one and the group is dealt again.

No rows are shuffled and no key is gathered, so no source and no group of copies can overload a task. Null text is an empty
document (its end id only); an empty table gives no rows; repeated rows are packed each.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkflow.llm.batches import by_bytes, text_or_empty
from rinkflow.llm.tokens import encoder


def difference(lengths: list[int], parts: int) -> np.ndarray:
    """The part of each length after multiway differencing into ``parts`` parts."""
    nodes: list[tuple] = []
    heap: list[tuple[int, int]] = []
    for i, n in enumerate(lengths):
        sums = np.zeros(parts, np.int64)
        sums[0] = n
        nodes.append((sums, i, None, None))
        heap.append((-n if parts > 1 else 0, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        left, right = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        sums = nodes[left][0] + nodes[right][0][::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        nodes.append((sums, left, right, order))
        heapq.heappush(heap, (int(sums[-1] - sums[0]), len(nodes) - 1))
    part = np.zeros(len(lengths), np.int64)
    waiting = [(heap[0][1], np.arange(parts))] if heap else []
    while waiting:
        node, names = waiting.pop()  # names: the final part of each of this node's parts
        _, left, right, order = nodes[node]
        if right is None:
            part[left] = names[0]
            continue
        back = np.empty(parts, np.int64)
        back[order] = names
        waiting += [(left, back), (right, back[::-1])]
    return part


def deal(lengths: list[int], capacity: int) -> np.ndarray:
    """Windows of a group: as few as hold all tokens, one more for as long as differencing exceeds the capacity."""
    parts = max(1, -(-sum(lengths) // capacity))
    while True:
        part = difference(lengths, parts)
        if np.bincount(part, lengths, parts).max(initial=0) <= capacity:
            return part
        parts += 1


class Packer:
    """Collects pieces of one partition and gives out dealt groups."""

    def __init__(self, capacity: int, windows: int, piece: int, slack: int, base: int):
        self.capacity, self.piece, self.base = capacity, piece, base
        self.full = windows * (capacity - slack)
        self.held: list[tuple] = []
        self.tokens, self.sequences = 0, 0
        self.rows: list[tuple] = []

    def add(self, key, ids: np.ndarray) -> None:
        n, start = len(ids), 0
        while n - start >= self.capacity:
            self.rows.append((*self._row(key, ids, start, start + self.capacity), self._next(1), 0))
            start += self.capacity
        while start < n:
            stop = min(n, start + self.piece, start + self.full - self.tokens)
            self.held.append(self._row(key, ids, start, stop))
            self.tokens += stop - start
            start = stop
            if self.tokens >= self.full:
                self.flush()

    def _row(self, key, ids, start, stop) -> tuple:
        return key, start, stop - start, zlib.crc32(ids[start:stop].tobytes()), len(ids)

    def _next(self, n: int) -> int:
        self.sequences += n
        return self.base + self.sequences - n

    def flush(self) -> None:
        if self.held:
            part = deal([x[2] for x in self.held], self.capacity)
            used = np.zeros(part.max() + 1, np.int64)
            names = np.cumsum(np.bincount(part) > 0) - 1  # parts without pieces get no sequence
            first = self._next(int(names[-1]) + 1)
            for row, p in zip(self.held, part, strict=True):
                self.rows.append((*row, first + int(names[p]), int(used[p])))
                used[p] += row[2]
        self.held, self.tokens = [], 0

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, windows: int = 128, piece: int = 512,
    slack: int = 4, text: str = "text", key: str = "doc_id",
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``slack`` tokens a window stay free in a full group, so that differencing rarely needs another window. Sequence ids hold
    the partition in their upper bits; a task that runs again gives the same ids, since a partition's rows come in the same order.
    """
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kinds = [None] + [pa.int64()] * 6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, windows, piece, slack, TaskContext.get().partitionId() << 32)
        kind = None

        def out():
            columns = list(zip(*packer.take(), strict=True)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, t or kind) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in by_bytes(batches, "text", 8 << 20):
            kind = batch.column(0).type
            for k, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer).ids(batch.column(1)), strict=True):
                packer.add(k, np.append(ids, np.array([end_id], "<u4")))
            yield out()
        if kind is not None:
            packer.flush()
            yield out()

    narrow = docs.select(F.col(key), text_or_empty(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
