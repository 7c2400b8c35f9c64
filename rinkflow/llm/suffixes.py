"""Removal of repeated 100-byte strings by a suffix sort that compares hashes.

Sorting every suffix of a large corpus would move each of its bytes many times. Equal windows share an anchor (see ``anchors``)
at one offset, so suffixes only need sorting where an anchor stands in different surroundings:

1. Every text gives its anchors with a hash of all the windows each stands for. Repeats inside a batch, checked byte by byte,
   are settled there and leave as merged spans, so a passage of very many rows sends one row a batch.
2. Anchors meet by their gram. Those whose surroundings came before are repeats; what differs is a candidate.
3. The surroundings of candidates are fetched. Their windows are sorted as suffixes: a bottom-up mergesort, vectorised over all
   runs, ranks each suffix in its sister run by binary search; two suffixes are compared by a binary search over prefix hashes
   for their common extension. Neighbours that agree over a whole window are verified byte by byte and sorted by their bytes
   if a hash misled. Anchors with very many surroundings are sorted in blocks; the windows that are first in their block then
   meet once more by a 128-bit digest.
4. All spans of a document are merged and cut out.

Texts are UTF-8 bytes; null is empty. Texts shorter than a window lose nothing. A text is handled in parts of bounded size. Rows
that repeat an id are expected to repeat the text; none of them counts as earlier than the other. Rows with a null id keep
their text and remove nothing. Extra columns and names do not matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rinkflow.llm.anchors import LENGTH, anchors, prefix, spans_hash
from rinkflow.llm.batches import by_bytes, flat_bytes, stored, strings, text_or_empty

REPEAT, ANCHOR = 0, 1
ROWS = "kind int, g long, c long, id long, at long, low long, high long"


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open ranges as maximal ranges in order; ranges that touch are one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of every text that are the first of their kind in a batch, and merged spans of those that are not."""
    names = [x.split()[0] for x in ROWS.split(", ")]
    for batch in by_bytes(batches, "text"):
        data, offsets = flat_bytes(batch.column(1))
        ids = batch.column(0).to_numpy()
        found = [(k, anchors(data[offsets[k] : offsets[k + 1]])) for k in np.flatnonzero(np.diff(offsets) >= LENGTH)]
        if not found:
            continue
        row = np.concatenate([np.full(len(x.at), k) for k, x in found])
        at, low, high, gram, around = (np.concatenate([getattr(x, f) for _, x in found]) for f in ("at", "low", "high", "gram", "context"))
        order = np.lexsort((at, ids[row], around, gram))
        same = np.zeros(len(order), bool)
        same[1:] = (gram[order[1:]] == gram[order[:-1]]) & (around[order[1:]] == around[order[:-1]])
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        again, before = order[same], order[first[same]]
        # The same row, or another of the same id at the same place, is not earlier.
        earlier = (ids[row[again]] != ids[row[before]]) | (at[again] != at[before])
        again, before = again[earlier], before[earlier]
        x, y = offsets[row[again]] + low[again], offsets[row[before]] + low[before]
        true = _equal(data, x, y, high[again] - low[again] + LENGTH)
        again = again[true]
        left = np.ones(len(at), bool)
        left[again] = False
        spans = []
        for k in np.unique(row[again]):
            own = again[row[again] == k]
            s, e = merged(low[own], high[own] + LENGTH)
            spans.append((np.full(len(s), ids[k]), s, e))
        if spans:
            i, s, e = (np.concatenate(x) for x in zip(*spans, strict=True))
            z = np.zeros(len(i), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(z + REPEAT, pa.int32()), pa.array(i), *map(pa.array, (z, i, s, s, e))], names)
        i = ids[row[left]]
        columns = (gram[left].view(np.int64), around[left].view(np.int64), i, at[left], low[left], high[left])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), ANCHOR), pa.int32()), *map(pa.array, columns)], names)


def _equal(data: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes from x on and from y on are the same."""
    out = np.ones(len(x), bool)
    for a in range(0, len(x), 20_000):
        b = a + 20_000
        k = np.arange(n[a:b].max(initial=0))
        inside = k[None, :] < n[a:b, None]
        same = data[np.minimum(x[a:b, None] + k, len(data) - 1)] == data[np.minimum(y[a:b, None] + k, len(data) - 1)]
        out[a:b] = (same | ~inside).all(axis=1)
    return out


class Suffixes:
    """Windows of a buffer, sorted class by class."""

    def __init__(self, data: np.ndarray, length: int = LENGTH):
        self.data, self.length, self.hashes = data, length, prefix(data)

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension, at most a window, by binary search over prefix hashes."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), self.length, np.int64)
        for _ in range(int(self.length).bit_length()):
            middle = (low + high + 1) >> 1
            same = spans_hash(self.hashes, x, x + middle) == spans_hash(self.hashes, y, y + middle)
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
        return low

    def less(self, x: np.ndarray, y: np.ndarray, rank_x: np.ndarray, rank_y: np.ndarray) -> np.ndarray:
        """Whether suffix x comes before suffix y; equal windows by their rank."""
        n = self.common(x, y)
        whole = n >= self.length
        last = len(self.data) - 1
        return np.where(whole, rank_x < rank_y, self.data[np.minimum(x + n, last)] < self.data[np.minimum(y + n, last)])

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the windows ``at`` within each ``group`` (groups lie together): mergesort; equal ones keep their order."""
        n = len(at)
        order = np.arange(n)
        begin = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), np.arange(n), 0))
        ends = np.concatenate([np.flatnonzero(group[1:] != group[:-1]) + 1, [n]])
        end = ends[np.searchsorted(ends, np.arange(n), "right")]
        run, most = 1, int((end - begin).max(initial=0))
        while run < most:
            # Each element looks for its rank in the sister run of its group.
            place = np.arange(n)
            mine = (place - begin) // run
            sister = begin + (mine ^ 1) * run
            active = np.flatnonzero(sister < end)
            low, high = sister[active].copy(), np.minimum(sister + run, end)[active]
            first = low.copy()
            me = order[active]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) >> 1
                other = order[middle]
                before = self.less(at[other], at[me[open_]], other, me[open_])
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            start = begin[active] + (mine[active] >> 1) * 2 * run
            own = place[active] - (begin[active] + mine[active] * run)
            new = order.copy()
            new[start + own + (low - first)] = me
            order, run = new, run * 2
        return order

    def repeats(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """For each window, whether an equal one of its group stands before it in the given order."""
        out = np.zeros(len(at), bool)
        if len(at) < 2:
            return out
        order = self.sort(at, group)
        x, y = at[order[:-1]], at[order[1:]]
        pair = np.flatnonzero((group[order[:-1]] == group[order[1:]]) & (self.common(x, y) >= self.length))
        true = _equal(self.data, x[pair], y[pair], np.full(len(pair), self.length))
        out[order[pair[true] + 1]] = True
        for g in np.unique(group[order[pair[~true]]]):
            # A hash misled: decide this group by its bytes.
            seen: set[bytes] = set()
            for i in np.flatnonzero(group == g):
                window = self.data[at[i] : at[i] + self.length].tobytes()
                out[i] = window in seen
                seen.add(window)
        return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeats in blocks (g, block) of surroundings that come sorted; windows that are first in one of several blocks."""
    waiting: pa.Table | None = None

    def settle(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks().sort_by([(c, "ascending") for c in ("g", "block", "id", "at")])
        columns = {c: t[c].to_numpy() for c in ("g", "block", "blocks", "id", "at", "low", "high")}
        data, offsets = flat_bytes(t["bytes"].combine_chunks())
        n = columns["high"] - columns["low"] + 1
        owner = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        start = columns["low"][owner] + step
        block = np.cumsum(np.concatenate([[0], (np.diff(columns["g"]) != 0) | (np.diff(columns["block"]) != 0)]))
        # Equal windows of a block have the anchor at the same offset.
        shift = columns["at"][owner] - start
        order = np.lexsort((owner, shift, block[owner]))
        group = block[owner][order] * (LENGTH + 1) + shift[order]
        repeat = np.zeros(len(owner), bool)
        repeat[order] = Suffixes(data).repeats((offsets[owner] + step)[order], group)
        rows = []
        change = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (repeat[1:] != repeat[:-1])]))
        stops = np.concatenate([change[1:], [len(owner)]])
        for a, b in zip(change[repeat[change]], stops[repeat[change]], strict=True):
            rows.append((columns["id"][owner[a]], start[a], start[b - 1] + LENGTH, None))
        for i in np.flatnonzero(~repeat & (columns["blocks"][owner] > 1)):
            at = offsets[owner[i]] + step[i]
            rows.append((columns["id"][owner[i]], start[i], start[i] + LENGTH, hashlib.blake2b(data[at : at + LENGTH].tobytes(), digest_size=16).digest()))
        cut = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cut, kinds, strict=True)], ["id", "s", "e", "digest"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if waiting is None else pa.concat_tables([waiting, table])
        g, b = table["g"].to_numpy(), table["block"].to_numpy()
        last = np.flatnonzero((g[1:] != g[:-1]) | (b[1:] != b[:-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        waiting = table.slice(cut)
        if cut:
            yield settle(table.slice(0, cut))
    if waiting is not None:
        yield settle(waiting)


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around each wanted anchor."""
    for batch in by_bytes(batches, "text"):
        rows = []
        wanted = zip(*(batch.column(k).to_pylist() for k in range(2, 8)), strict=True)
        for key, text, lists in zip(batch.column(0).to_pylist(), strings(batch.column(1)), wanted, strict=True):
            data = text.encode("utf-8")
            for g, block, blocks, at, low, high in zip(*lists, strict=True):
                rows.append((g, block, blocks, key, at, low, high, data[low : high + LENGTH]))
        cut = list(zip(*rows, strict=True)) or [[]] * 8
        names = ["g", "block", "blocks", "id", "at", "low", "high", "bytes"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "bytes" else pa.int64()) for c, k in zip(cut, names, strict=True)], names)


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for spans in batch.column(1).to_pylist():
            s, e = merged(np.array([x["s"] for x in spans], np.int64), np.array([x["e"] for x in spans], np.int64))
            out.append([{"s": int(a), "e": int(b)} for a, b in zip(s, e, strict=True)])
        kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["id", "spans"])


def repeated_spans(docs: DataFrame, block: int = 2000, small: int = 200_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, spans) of every document that loses bytes: maximal half-open byte ranges (s, e) to remove, in order."""
    rows = docs.select(F.col(key).cast("long").alias("id"), text_or_empty(text).alias("text")).where(F.col("id").isNotNull())
    found = rows.mapInArrow(_find, ROWS).repartition("g")
    alike = Window.partitionBy("kind", "g", "c").orderBy("id", "at")
    near = Window.partitionBy("kind", "g")
    ranked = found.withColumn("rank", F.rank().over(alike))
    # How many different surroundings an anchor has: the number of first rows; repeats of one id at one place count once.
    head = (F.col("rank") == 1) & (F.row_number().over(alike) == 1)
    ranked = ranked.withColumn("head", head).withColumn("kinds", F.sum(F.col("head").cast("long")).over(near))
    kept = ranked.where((F.col("kind") == REPEAT) | (F.col("rank") > 1) | (F.col("head") & (F.col("kinds") > 1)))
    kept = stored(kept.select("kind", "g", "id", "at", "low", "high", "rank", "kinds"), "anchors")
    again = (F.col("kind") == REPEAT) | (F.col("rank") > 1)
    end = F.when(F.col("kind") == REPEAT, F.col("high")).otherwise(F.col("high") + LENGTH)
    spans = kept.where(again).select("id", F.col("low").alias("s"), end.alias("e"))

    blocks = F.ceil(F.col("kinds") / block).cast("long")
    fields = {"block": F.pmod(F.xxhash64("id", "at"), blocks), "blocks": blocks, "at": F.col("at"), "low": F.col("low"), "high": F.col("high")}
    wanted = kept.where(~again).select("id", F.struct("g", *[c.cast("int").alias(n) for n, c in fields.items()]).alias("w"))
    # Lists of plain numbers take less than half the memory of a list of structs.
    wanted = stored(wanted.groupBy("id").agg(F.collect_list("w").alias("w")).select("id", "w.g", *[f"w.{n}" for n in fields]), "wanted")
    texts = rows.join(_sized(wanted, small), "id").dropDuplicates(["id"]) if _repeats(rows) else rows.join(_sized(wanted, small), "id")
    around = texts.mapInArrow(_surroundings, "g long, block long, blocks long, id long, at long, low long, high long, bytes binary")
    sorted_ = around.repartition("g", "block").sortWithinPartitions("g", "block")
    compared = stored(sorted_.mapInArrow(_compare, "id long, s long, e long, digest binary"), "compared")
    firsts = compared.where("digest is not null")
    least = firsts.groupBy("digest").agg(F.min(F.struct("id", "s")).alias("least"))
    late = firsts.join(least, "digest").where(F.struct("id", "s") != F.col("least")).select("id", "s", "e")
    everything = spans.unionByName(compared.where("digest is null").select("id", "s", "e")).unionByName(late)
    lists = everything.groupBy("id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return lists.mapInArrow(_union, "id long, spans array<struct<s:long,e:long>>")


def _sized(side: DataFrame, small: int) -> DataFrame:
    """A side that is broadcast within a checked number of rows and shuffled beyond it."""
    return F.broadcast(side) if side.count() <= small else side


def _repeats(rows: DataFrame) -> bool:
    return not rows.groupBy("id").count().where("count > 1").isEmpty()


def without_repeats(docs: DataFrame, small: int = 200_000, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept, spans) of every row: what stays of its text, as bytes, and what went."""
    spans = stored(repeated_spans(docs, small=small, text=text, key=key, **options), "spans")
    rows = docs.select(F.col(key).cast("long").alias("id"), text_or_empty(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            out = []
            for text, gone in zip(strings(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                data, at, parts, lost = text.encode("utf-8"), 0, [], 0
                for span in gone or ():
                    parts.append(data[at : span["s"]])
                    lost += min(span["e"], len(data)) - min(span["s"], len(data))
                    at = span["e"]
                parts.append(data[at:])
                out.append((len(data), lost, len(gone or ()), b"".join(parts)))
            n, lost, count, kept = zip(*out, strict=True)
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, lost, count)), pa.array(kept, pa.binary()), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    joined = rows.join(_sized(spans, small), "id", "left")
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<s:long,e:long>>"
    return joined.mapInArrow(cut, schema).withColumnRenamed("id", key)
