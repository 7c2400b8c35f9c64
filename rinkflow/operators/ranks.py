"""Ranks over a whole table without moving it into one partition."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rinkflow.operators.sizing import Settled, join_dim, settle
from rinkflow.session import max_group_rows

SLICE = "__slice"
#: Rows of a range at most, unless groups are held smaller.
RANGE_ROWS = 250_000
#: Parts of all rows that a quantile sketch tells apart, and points taken from one sketch.
SKETCH = 10_000
MOST_CUTS = 4096


def range_rows(spark: SparkSession) -> int:
    return min(RANGE_ROWS, max_group_rows(spark))


def range_cuts(df: DataFrame, value: str) -> list[float]:
    """Split points of ``value``, with repeats where one value fills whole ranges, so that a range holds at most ``range_rows`` rows.

    The number of ranges follows the rows. A quantile sketch, merged from all partitions, gives the points; its error is a share of
    all rows, so where that is more than half a range, ranges that came out too large are counted and cut again by sketches of their own.
    """
    limit = range_rows(df.sparkSession)
    n = df.agg(F.count(value)).first()[0]
    parts = math.ceil(2 * n / limit)
    if parts < 2:
        return []
    fine = min(parts, MOST_CUTS)
    cuts = _quantiles(df, value, fine).first()["__cuts"] or []
    # An error of one part in SKETCH on both sides, and half a range of its own.
    while 2 * n / SKETCH > limit / 2 or fine < parts:
        placed = place(df, value, cuts)
        large = placed.groupBy(SLICE).agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
        large = [r for r in large.where(F.col("n") > limit).where("lo < hi").collect()]
        if not large:
            break
        most = min(MOST_CUTS, math.ceil(2 * max(r["n"] for r in large) / limit))
        again = _quantiles(placed.where(F.col(SLICE).isin([r[SLICE] for r in large])), value, most, SLICE)
        cuts = sorted([*cuts, *(c for r in again.collect() for c in r["__cuts"])])
        fine = parts
    return [float(c) for c in cuts]


def _quantiles(df: DataFrame, value: str, parts: int, *by: str) -> DataFrame:
    probs = [i / parts for i in range(1, parts)]
    return df.groupBy(*by).agg(F.percentile_approx(value, probs, max(SKETCH, 20 * parts)).alias("__cuts"))


def heavy_values(cuts: Sequence[float]) -> list[float]:
    """Values that fill whole ranges."""
    return sorted({float(c) for i, c in enumerate(cuts) if i and c == cuts[i - 1]})


def place(df: DataFrame, value: str, cuts: Sequence[float], new: str = SLICE) -> DataFrame:
    """Number rows by range; a heavy value has a range of its own. Rows without a value come last, in a range of their own."""
    points = sorted({float(c) for c in cuts} | {math.nextafter(h, math.inf) for h in heavy_values(cuts)})
    if not points:
        return df.withColumn(new, F.when(F.col(value).isNull(), float("inf")).otherwise(0.0))
    splits = [-math.inf, *points, math.inf]
    cast = df.withColumn("__slice_value", F.col(value).cast("double"))
    sliced = Bucketizer(splits=splits, inputCol="__slice_value", outputCol=new, handleInvalid="keep").transform(cast)
    return sliced.withColumn(new, F.coalesce(F.col(new), F.lit(float("inf")))).drop("__slice_value")


def _sliced(df: DataFrame, value: str) -> tuple[DataFrame, list[float]]:
    """Number rows by value range, and the values that fill whole ranges."""
    cuts = range_cuts(df, value)
    return place(df, value, cuts), heavy_values(cuts)


def value_counts(df: DataFrame, value: str, sums: Mapping[str, str] | None = None) -> DataFrame:
    """One row per distinct value with its row count ``n`` and the rows with smaller values ``n_before``.

    ``sums`` adds totals ``{name: column}`` together with ``{name}_before``. Null values are left out. Running totals
    are taken within value ranges and shifted by the totals of the ranges before them.
    """
    sums = dict(sums or {})
    names = ["n", *sums]
    dense = (
        df.filter(F.col(value).isNotNull())
        .groupBy(value)
        .agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(n) for n, c in sums.items()])
    )
    kept = settle(dense)
    earlier = (W.unboundedPreceding, -1)

    def before(w):
        return {f"{n}_before": F.coalesce(F.sum(n).over(w), F.lit(0)) for n in names}

    if kept.small:
        return kept.df.withColumns(before(W.partitionBy(F.lit(0)).orderBy(value).rowsBetween(*earlier)))
    sliced, _ = _sliced(kept.df, value)
    totals = settle(sliced.groupBy(SLICE).agg(*[F.sum(n).alias(n) for n in names]))
    across = W.partitionBy(F.lit(0)).orderBy(SLICE).rowsBetween(*earlier)
    carry = totals.df.select(SLICE, *[F.coalesce(F.sum(n).over(across), F.lit(0)).alias(f"__c_{n}") for n in names])
    inside = sliced.withColumns(before(W.partitionBy(SLICE).orderBy(value).rowsBetween(*earlier)))
    shifted = inside.join(F.broadcast(carry) if totals.small else carry, SLICE, "left")
    return shifted.withColumns({f"{n}_before": F.col(f"{n}_before") + F.col(f"__c_{n}") for n in names}).drop(
        SLICE, *[f"__c_{n}" for n in names]
    )


def pct_rank(df: DataFrame | Settled, cols: Mapping[str, str], ascending: bool = True) -> DataFrame:
    """Percentile ranks ``{new: column}`` in (0, 100] with averaged ties; nulls stay null and are not counted.

    A table within the checked limit is ranked by windows; a larger one by counts of distinct values.
    """
    side = df if isinstance(df, Settled) else settle(df)
    if side.small:
        out = side.df
        for new, c in cols.items():
            w = W.partitionBy(F.col(c).isNull())
            order = F.asc(c) if ascending else F.desc(c)
            total = F.count(c).over(w)
            first = F.rank().over(w.orderBy(order))
            last = F.round(F.cume_dist().over(w.orderBy(order)) * total)
            out = out.withColumn(new, F.when(F.col(c).isNotNull(), 100.0 * (first + last) / (2.0 * total)))
        return out
    out = side.df
    for new, c in cols.items():
        counts = value_counts(side.df.select(c), c)
        total = F.lit(side.df.filter(F.col(c).isNotNull()).count())
        middle = F.col("n_before") + (F.col("n") + 1) / 2.0
        share = 100.0 * (middle if ascending else total + 1 - middle) / total
        out = join_dim(out, counts.select(c, share.alias(new)), [c])
    return out


def row_numbers(df: DataFrame, value: str, tie: str, new: str = "row_number", by: Sequence[str] = ()) -> DataFrame:
    """Number all rows from 1 in the order of (value, tie) inside each ``by`` group.

    Rows are numbered within value ranges; a value that fills whole ranges is cut further by ``tie``. The number of
    ranges follows the rows, so no range outgrows a task, and the totals that shift them have a row per range.
    """
    by = list(by)
    sliced, heavy = _sliced(df, value)
    if heavy:
        hot = F.col(value).cast("double").isin(heavy)
        ties, _ = _sliced(sliced.withColumnRenamed(SLICE, "__outer"), tie)
        sliced = ties.withColumn(SLICE, F.struct(F.col("__outer"), F.when(hot, F.col(SLICE)).otherwise(0.0))).drop(
            "__outer"
        )
    totals = sliced.groupBy(*by, SLICE).agg(F.count(F.lit(1)).alias("__n"))
    group = by or [F.lit(0)]
    carry = totals.select(
        *by,
        SLICE,
        F.coalesce(
            F.sum("__n").over(W.partitionBy(*group).orderBy(SLICE).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("__before"),
    )
    inner = F.row_number().over(W.partitionBy(*by, SLICE).orderBy(F.asc_nulls_last(value), F.asc_nulls_last(tie)))
    numbered = join_dim(sliced.withColumn("__inner", inner), settle(carry), [*by, SLICE])
    return numbered.withColumn(new, F.col("__before") + F.col("__inner")).drop("__before", "__inner", SLICE)


def falling(df: DataFrame, order: str, low: str, high: str, slack: float = 0.0) -> DataFrame:
    """Rows whose ``low`` is more than ``slack`` below the ``high`` of any row before them; ``order`` is unique.

    Rows lie in value ranges; the highest value of the ranges before one is carried over.
    """
    sliced, _ = _sliced(df, order)
    before = (W.unboundedPreceding, -1)
    tops = sliced.groupBy(SLICE).agg(F.max(high).alias("__top"))
    carry = settle(tops.select(SLICE, F.max("__top").over(W.partitionBy(F.lit(0)).orderBy(SLICE).rowsBetween(*before)).alias("__carry")))
    inner = sliced.withColumn("__inner", F.max(high).over(W.partitionBy(SLICE).orderBy(order).rowsBetween(*before)))
    known = join_dim(inner, carry, [SLICE])
    return known.where(F.col(low) < F.greatest("__inner", "__carry") - slack).drop(SLICE, "__inner", "__carry")


def dense_codes(df: DataFrame, key: str, order: str, new: str = "code") -> DataFrame:
    """Codes 0, 1, 2 ... for the distinct keys in order of first appearance."""
    firsts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first_seen"))
    ranked = value_counts(firsts.select("first_seen"), "first_seen")
    return join_dim(firsts, ranked.select("first_seen", F.col("n_before").alias(new)), ["first_seen"])


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all) chosen by a seeded hash of the key; distributed numbering, no global sort."""
    hashed = df.withColumn("__h", F.xxhash64(F.lit(seed), F.col(key)).cast("double"))
    return row_numbers(hashed, "__h", key, "__rn").filter(F.col("__rn") <= n).drop("__h", "__rn")
