"""Mixing sources to target weights by cube-method balanced sampling.

Each source has a target of words, at most twice its size. Every document of a source is taken floor(target / size) times and
once more with the fractional rest as its inclusion probability. The extra draws are balanced: the probabilities of a block of
documents move along the null-space of two constraints, the count of words and the count of documents, until each but two at
most is 0 or 1. The documents that are left over, two of each block, form the blocks of the next round, so the rounds grow
with the logarithm of the input; in the last round each source has one block and the small landing problem is decided there.

Blocks are cut by a hash of the document, so a source with a third of all rows is spread over as many tasks as its size asks.
The draws are seeded by a hash of each block's first document, so a rerun takes the same documents.

Null text has size 0; a null source is a source of its own, last in order; documents of size 0 are taken floor(target / size)
times (0 if the source has size 0). Repeated rows are decided each. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rinkflow.llm.batches import WORD, stored
from rinkflow.session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, n_docs, target): the weighted share of each source, with water-filling at ``most`` times its size.

    Shares stop at their limits where the common level reaches limit / weight; in the order of that ratio the stopped sources
    come first, so the level follows from running sums over one row per source.
    """
    sums = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int"))
    limits = sums.withColumn("__w", weight).withColumn("__cap", F.col("source_size") * most).withColumn("__at", F.col("__cap") / F.col("__w"))
    everything = Window.partitionBy(F.lit(0))
    below = everything.orderBy("__at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * F.lit(share)
    capped, used = F.coalesce(F.sum("__cap").over(below), F.lit(0.0)), F.coalesce(F.sum("__w").over(below), F.lit(0.0))
    # The level if exactly the sources before this one are stopped; this one is stopped too if its ratio is not above it.
    # Levels rise along the stopped sources and fall after the first that is not, so that one has the highest of the rest.
    level = (total - capped) / (F.sum("__w").over(everything) - used)
    stopped = limits.withColumn("__level", level).withColumn("__stop", F.col("__at") <= F.col("__level"))
    final = F.max(F.when(~F.col("__stop"), F.col("__level"))).over(everything)
    target = F.when(F.col("__stop"), F.col("__cap")).otherwise(F.col("__w") * final)
    return stopped.withColumn("target", target).select("source", "source_size", "n_docs", "target")


def flight(p: np.ndarray, sizes: np.ndarray, rng: np.random.Generator, landing: bool, held: int = 12) -> np.ndarray:
    """Move inclusion probabilities through the null-space of (words, documents) until at most two are fractional.

    Three fractional units always have a direction that keeps both totals; it is followed to either end with probabilities
    that keep the expectation. With ``landing`` very large units are decided first; ``held`` units of all sizes stay out of the flight, and they and the last two
    are decided by trying every sample of them: the one whose words, then documents, come nearest to the expected ones.
    """
    p, eps = p.copy(), 1e-9
    rows = np.flatnonzero((p > eps) & (p < 1 - eps))
    mean = max(1.0, float(sizes[rows].mean())) if len(rows) else 1.0
    kept: list[int] = []
    if landing:
        # A unit that the others could not make up for at the end is decided first, while all of them can.
        for unit in rows[np.argsort(-sizes[rows], kind="stable")]:
            if sizes[unit] <= 0.02 * (p[rows] @ sizes[rows]):
                break
            _decide(p, int(unit), rows, sizes, rng, eps)
        rows = np.flatnonzero((p > eps) & (p < 1 - eps))
        spread = np.unique(np.linspace(0, max(0, len(rows) - 1), min(held, len(rows))).astype(int))
        kept = rows[np.argsort(sizes[rows], kind="stable")[spread]].tolist()
        rows = np.setdiff1d(rows, kept)
    active, rest = rows[:3].tolist(), rows[3:][::-1].tolist()
    while len(active) == 3:
        a, b, c = sizes[active] / mean
        move = np.array([b - c, c - a, a - b])
        if not np.any(np.abs(move) > 1e-12):
            move = np.array([1.0, -1.0, 0.0])
        active = _step(p, active, move, rng, eps)
        while len(active) < 3 and rest:
            active.append(rest.pop())
    if landing and (last := kept + active):
        samples = (np.arange(1 << len(last))[:, None] >> np.arange(len(last))) & 1
        words = np.abs(samples @ sizes[last] - p[last] @ sizes[last])
        units = np.abs(samples.sum(axis=1) - p[last].sum())
        p[last] = samples[np.lexsort((units, np.round(words, 6)))[0]]
    return p


def repair(x: np.ndarray, sizes: np.ndarray, words: float, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Change some units by one, largest first, where that brings the words nearer; x stays between low and high.

    Without it a source whose largest document outweighs the rest could not come near its target.
    """
    x, off = x.copy(), float(x @ sizes) - words
    for i in np.argsort(-sizes, kind="stable"):
        step = -1 if off > 0 else 1
        if low[i] <= x[i] + step <= high[i] and abs(off + step * sizes[i]) < abs(off):
            x[i] += step
            off += step * sizes[i]
    return x


def _decide(p: np.ndarray, unit: int, rows: np.ndarray, sizes: np.ndarray, rng: np.random.Generator, eps: float) -> None:
    """Move one unit to 0 or 1; all fractional others move a little the other way, so that the expected words stay."""
    while eps < p[unit] < 1 - eps:
        others = rows[(rows != unit) & (p[rows] > eps) & (p[rows] < 1 - eps) & (sizes[rows] > 0)]
        if not len(others):
            return
        room = p[others] * (1 - p[others])
        move = np.concatenate([[1.0], -sizes[unit] * room / (room @ sizes[others])])
        _step(p, [unit, *others.tolist()], move, rng, eps)


def _step(p: np.ndarray, active: list[int], move: np.ndarray, rng: np.random.Generator, eps: float) -> list[int]:
    """Follow ``move`` or its opposite to the edge of the unit cube; the units that are still fractional."""
    at = p[active]
    with np.errstate(divide="ignore", invalid="ignore"):
        up = np.min(np.where(move > 0, (1 - at) / move, np.where(move < 0, -at / move, np.inf)))
        down = np.min(np.where(move > 0, at / move, np.where(move < 0, (at - 1) / move, np.inf)))
    at = at + (up if rng.random() < down / (up + down) else -down) * move
    at = np.where(at < eps, 0.0, np.where(at > 1 - eps, 1.0, at))
    p[active] = at
    return [i for i, v in zip(active, at, strict=True) if 0 < v < 1]


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = 1000,
    text: str = "text", key: str = "doc_id", source: str = "source",
) -> DataFrame:
    """One row per document: key, size, source_size, target, times (how often the mix takes it), taken (words)."""
    sized = docs.select(
        F.col(key), F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    sized = stored(sized, "sizes")
    targets = cut_lineage(source_targets(sized, weights, share, most))
    top = targets.agg(F.max("n_docs")).first()[0] or 0
    units = (
        sized.join(targets, sized["source"].eqNullSafe(targets["source"]), "left")
        .drop(targets["source"])
        .withColumn("__rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .withColumn("__times", F.floor(F.col("__rate") + 1e-12).cast("int"))
        .withColumn("__p", F.greatest(F.lit(0.0), F.col("__rate") - F.col("__times")))
        .drop("__rate")
    )
    kind = docs.schema[key].dataType.simpleString()
    schema = f"source string, __block long, `{key}` {kind}, size long, source_size long, target double, n_docs long, __times int, __p double"

    def decided(landing: bool):
        def run(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["__h", key, "size"], kind="stable")
            seed = int(frame["__h"].iloc[0]) & 0xFFFFFFFFFFFF
            p, sizes, times = (frame[c].to_numpy(float) for c in ("__p", "size", "__times"))
            x = flight(p, sizes, np.random.default_rng(seed), landing)
            if landing and abs((x - p) @ sizes) > 0.001 * frame["target"].iloc[0]:
                x = repair(x, sizes, float(p @ sizes), -times, math.floor(most) - times)
            frame["__p"] = x
            return frame.drop(columns="__h")

        return run

    done, waiting, left = [], units, top
    while True:
        last = left <= 4 * block
        # Blocks of the same mean size in every source: as many as its own rows ask for.
        share_of = F.col("n_docs") * (left / max(1, top))
        blocks = F.lit(1) if last else F.greatest(F.lit(1), F.ceil(share_of / block)).cast("long")
        hashed = F.xxhash64(F.col(key), F.col("size"), F.lit(len(done)))
        dealt = waiting.withColumn("__h", hashed).withColumn("__block", F.pmod("__h", blocks).cast("long"))
        moved = stored(dealt.groupBy("source", "__block").applyInPandas(decided(last), schema), "mix")
        open_ = (F.col("__p") > 0) & (F.col("__p") < 1)
        done.append(moved.where(~open_))
        if last:
            break
        waiting, left = moved.where(open_).drop("__block"), math.ceil(left * 2 / block) + 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    times = (F.col("__times") + F.col("__p").cast("int")).cast("int")
    return out.select(key, "size", "source_size", "target", times.alias("times"), (times * F.col("size")).cast("long").alias("taken"), "source")
