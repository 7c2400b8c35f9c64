"""Points against half-open intervals ``[start, end)``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rinkflow.operators.skew import measure_groups


def length_levels(intervals: DataFrame, start: str, end: str) -> list[int]:
    """The powers of two that the lengths of the intervals lie between: at most one for each bit of a length."""
    live = intervals.filter(F.col(end) > F.col(start))
    found = live.agg(F.collect_set(_level(F.col(end) - F.col(start))).alias("l")).first()
    return sorted(found["l"])


def _level(length: Column) -> Column:
    """The largest power of two (its exponent) that is not above the length; 0 for lengths below 1."""
    exponent = F.floor(F.log2(F.greatest(length.cast("double"), F.lit(1.0)))).cast("int")
    # The logarithm may round up to the next whole number.
    return F.greatest(F.when(F.pow(F.lit(2.0), exponent) > F.greatest(length, F.lit(1)), exponent - 1).otherwise(exponent), F.lit(0)).cast("int")


def _nodes(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """Each interval at the nodes of its level that it touches: two or three stretches of 2 ** level units, whatever its length."""
    size = F.pow(F.lit(2.0), F.col("__level"))
    leveled = intervals.filter(F.col(end) > F.col(start)).withColumn("__level", _level(F.col(end) - F.col(start)))
    return leveled.withColumn("__node", F.explode(F.sequence(F.floor(F.col(start) / size), F.ceil(F.col(end) / size) - 1)))


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    on: Sequence[str],
    t: str,
    start: str,
    end: str,
    how: str = "left",
) -> DataFrame:
    """Pair every point with the intervals that cover it, within equal ``on`` keys; ``how`` is ``inner`` or ``left``.

    An interval of length n lies in the dyadic nodes of 2 ** floor(log2 n) units that it touches, three at most. A point asks one
    node of every level that occurs, so no pair appears twice, no interval is repeated by its length, and a point meets only intervals
    that cover at least a quarter of the stretch around it. A busy group spreads over its nodes.

    In a left join, points are first told apart by the running number of intervals around them: those that no interval covers ask
    nothing and stay with nulls, the others stay with their pairs alone.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"no interval join of kind {how}")
    on = list(on)
    levels = length_levels(intervals, start, end)
    asked = points
    if how == "left" and len(levels) > 1:
        asked = _covered(points, intervals, on, t, start, end)
        ask = F.when(F.col("__covered"), F.array(*map(F.lit, levels))).otherwise(F.array(F.lit(None).cast("int")))
    else:
        ask = F.array(*map(F.lit, levels)) if levels else F.array(F.lit(None).cast("int"))
    left = asked.withColumn("__level", F.explode(ask)).withColumn("__node", F.floor(F.col(t) / F.pow(F.lit(2.0), F.col("__level"))))
    keys = [*on, "__level", "__node"]
    right = _nodes(intervals, start, end)
    right = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in intervals.columns if c not in on])
    cond = (F.col(t) >= F.col(start)) & (F.col(t) < F.col(end))
    for k in keys:
        cond = (F.col(k) == F.col(f"__r_{k}")) & cond
    out = left.join(right, cond, how)
    if "__covered" in asked.columns:
        out = out.filter(F.col("__r___level").isNotNull() | ~F.col("__covered")).drop("__covered")
    return out.drop("__level", "__node", *[f"__r_{k}" for k in keys])


def _covered(points: DataFrame, intervals: DataFrame, on: list[str], t: str, start: str, end: str) -> DataFrame:
    """Add whether any interval covers a point: a running sum of +1 and -1 steps over the distinct times, which is joined back."""
    live = intervals.filter(F.col(end) > F.col(start)).dropna(subset=on)
    ends = F.array(F.struct(F.col(start).cast("double").alias("__t"), F.lit(1).alias("__d")), F.struct(F.col(end).cast("double").alias("__t"), F.lit(-1).alias("__d")))
    at = F.col(t).cast("double")
    steps = live.select(*on, F.inline(ends)).unionAll(points.where(at.isNotNull()).select(*on, at.alias("__t"), F.lit(0).alias("__d")))
    times = steps.groupBy(*on, "__t").agg(F.sum("__d").alias("__d"))
    sums = running_total(times, on, "__t", "__d", "__n").where("__n > 0").select(*on, F.col("__t"), F.lit(True).alias("__covered"))
    return points.withColumn("__t", at).join(sums, [*on, "__t"], "left").withColumn("__covered", F.coalesce("__covered", F.lit(False))).select(*points.columns, "__covered")


def cover_counts(
    points: DataFrame,
    intervals: DataFrame,
    key: Sequence[str],
    on: Sequence[str],
    t: str,
    start: str,
    end: str,
    match: Mapping[str, str],
    label: str,
) -> DataFrame:
    """Count the covering intervals of every point without pairing them; one row per point ``key``.

    ``match`` is ``{new column: point column}``; an interval counts when its ``label`` equals that point column.
    Interval ends become +1/-1 steps and a running sum over the axis gives the count, all in one exchange by ``on``.
    With hot groups the steps are summed per axis value before the exchange. ``on`` is part of the unique ``key``;
    ``start``, ``end`` and ``t`` are whole numbers. A null key or label equals none, so it counts 0 intervals.
    """
    on, key = list(on), list(key)
    live = intervals.filter(F.col(end) > F.col(start)).dropna(subset=[*on, label])
    ends = F.array(
        F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d"))
    )
    steps = live.select(*on, F.col(label).alias("__label"), F.inline(ends)).withColumnsRenamed({"t": "__t", "d": "__d"})
    sides = F.array(*[F.struct(F.lit(n).alias("__side"), F.col(c).alias("__label")) for n, c in match.items()])
    rest = [c for c in key if c not in on]
    asked = points.select(*on, *rest, F.col(t).alias("__t"), F.inline(sides)).withColumn("__d", F.lit(0))

    load = measure_groups(points.select(*on).unionByName(live.select(*on)), on)
    part = [*on, "__label"]
    if load.hot:
        known = steps.unionByName(asked.select(*part, "__t", "__d"))
        totals = running_total(known.groupBy(*part, "__t").agg(F.sum("__d").alias("__d")), part, "__t", "__d", "__n")
        found = asked.drop("__d").join(totals, [*part, "__t"], "left")
    else:
        both = steps.unionByName(asked, allowMissingColumns=True).repartition(*on)
        # At equal times the steps come first: a start counts, an end no longer does.
        w = W.partitionBy(*part).orderBy("__t", F.col("__side").isNotNull())
        summed = both.withColumn("__n", F.sum("__d").over(w.rowsBetween(W.unboundedPreceding, 0)))
        found = summed.filter(F.col("__side").isNotNull())
    return found.groupBy(*key).agg(
        *[F.coalesce(F.max(F.when(F.col("__side") == n, F.col("__n"))), F.lit(0)).cast("bigint").alias(n) for n in match]
    )


def running_total(df: DataFrame, keys: Sequence[str], order: str, value: str, new: str, stretch: int = 86_400) -> DataFrame:
    """Running sum per group over unique whole-number order values; the axis is cut into stretches."""
    w = W.partitionBy(*keys, "__stretch").orderBy(order)
    cut = df.withColumn("__stretch", F.floor(F.col(order) / stretch))
    before = W.partitionBy(*keys).orderBy("__stretch").rowsBetween(W.unboundedPreceding, -1)
    carry = (
        cut.groupBy(*keys, "__stretch")
        .agg(F.sum(value).alias("__total"))
        .select(*keys, "__stretch", F.sum("__total").over(before).alias("__carry"))
    )
    local = cut.withColumn("__own", F.sum(value).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return (
        local.join(carry, [*keys, "__stretch"], "left")
        .withColumn(new, F.col("__own") + F.coalesce(F.col("__carry"), F.lit(0)))
        .drop("__stretch", "__own", "__carry", value)
    )
