"""Lookups between the points of a curve, and local regression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rinkflow.operators.ranks import place, range_cuts, range_rows, value_counts
from rinkflow.operators.sequences import neighbours, row_hash
from rinkflow.operators.sizing import Settled, join_dim, one_row, settle
from rinkflow.operators.skew import measure_groups

BUCKETS = 256


def segments(curve: DataFrame, x: str, payload: Sequence[str]) -> DataFrame:
    """Neighbouring points of a curve with distinct x: ``__x0, __x1, <payload>0, <payload>1``, ordered lead without a sort
    into one partition when the curve is large."""
    one = curve.withColumn("__all", F.lit(0))
    ahead = {f"__n_{c}": (c, -1) for c in [x, *payload]}
    x1 = neighbours(one, ["__all"], x, ahead, measure_groups(one, ["__all"], x))
    return x1.select(
        F.col(x).cast("double").alias("__x0"),
        F.col(f"__n_{x}").cast("double").alias("__x1"),
        *[F.col(c).alias(f"{c}0") for c in payload],
        *[F.col(f"__n_{c}").alias(f"{c}1") for c in payload],
    )


def locate(points: DataFrame, at: Column, curve: DataFrame | Settled, x: str, payload: Sequence[str]) -> DataFrame:
    """Attach to every point the segment ``[__x0, __x1)`` that holds ``at``.

    Values left of the curve get its first segment and values right of it the last one; a single point has none, and a missing
    value has none. On a curve within the limit of small tables a point finds its segment's number by binary search among all
    points, and joins it by that number. Larger curves are merged with the points by ranges of the axis.
    """
    side = curve if isinstance(curve, Settled) else settle(curve)
    parts = segments(side.df, x, payload).filter(F.col("__x1").isNotNull())
    asked = points.withColumn("__at", at.cast("double"))
    known = F.col("__at").isNotNull() & ~F.isnan("__at")
    if not side.small:
        return _merged(asked, known, parts, payload)
    ends = sorted(r[0] for r in side.df.select(F.col(x).cast("double")).where(F.col(x).isNotNull()).distinct().collect())
    if len(ends) < 2:
        return asked.join(parts, F.lit(False), "left")

    def numbered(df: DataFrame, value: str) -> DataFrame:
        if len(ends) == 2:
            return df.withColumn("__number", F.lit(0.0))
        # The first and the last segment go on beyond the curve.
        splits = [float("-inf"), *ends[1:-1], float("inf")]
        return Bucketizer(splits=splits, inputCol=value, outputCol="__number", handleInvalid="keep").transform(df)

    right = numbered(parts, "__x0").withColumnRenamed("__number", "__segment")
    left = numbered(asked, "__at").withColumn("__number", F.when(known, F.col("__number")))
    return left.join(F.broadcast(right), F.col("__number") == F.col("__segment"), "left").drop("__number", "__segment")


def _merged(asked: DataFrame, known: Column, parts: DataFrame, payload: Sequence[str]) -> DataFrame:
    """As-of merge: points and segments are cut at common quantiles of both and sorted together, range by range.

    A range begins with the last segment before it, which is carried over from a row per range. A range in which the points are
    too many (one value may have a third of all) is dealt into several parts, each with all segments of the range.
    """
    spark = asked.sparkSession
    fields = ["__x0", "__x1", *[f"{c}{i}" for c in payload for i in (0, 1)]]
    both = asked.where(known).select(F.col("__at").alias("__v")).unionAll(parts.select(F.col("__x0").alias("__v")))
    cuts = range_cuts(both, "__v")
    points = place(asked, "__at", cuts, "__range").withColumn("__known", known)
    segs = place(parts, "__x0", cuts, "__range").select("__range", F.struct(*fields).alias("__seg"))

    tops = segs.groupBy("__range").agg(F.max_by("__seg", "__seg.__x0").alias("__top"), F.min_by("__seg", "__seg.__x0").alias("__low"))
    ranges = points.where("__known").groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    # A row per range, of which there are as many as the rows need.
    table = ranges.join(tops, "__range", "full")
    along = W.partitionBy(F.lit(0)).orderBy("__range")
    before = F.last("__top", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1))
    lowest = F.first("__low", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("__n") / range_rows(spark))).cast("int")
    table = settle(table.select("__range", F.coalesce(pieces, F.lit(1)).alias("__pieces"), F.coalesce(before, lowest).alias("__carried")))

    dealt = join_dim(points, table, ["__range"]).withColumn("__piece", F.pmod(row_hash(asked), F.coalesce("__pieces", F.lit(1))).cast("int"))
    dealt = dealt.select("__range", "__piece", F.col("__at").alias("__v"), F.col("__carried").alias("__seg"), F.struct(*asked.columns, "__known").alias("__point"))
    spread = join_dim(segs, table, ["__range"]).withColumn("__piece", F.explode(F.sequence(F.lit(0), F.col("__pieces") - 1)))
    spread = spread.select("__range", "__piece", F.col("__seg.__x0").alias("__v"), "__seg", F.lit(None).cast(dealt.schema["__point"].dataType).alias("__point"))
    # At one value the segment comes first: it begins there.
    w = W.partitionBy("__range", "__piece").orderBy(F.asc_nulls_last("__v"), F.col("__point").isNotNull())
    own = F.last(F.when(F.col("__point").isNull(), F.col("__seg")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    found = dealt.unionAll(spread).withColumn("__own", own).where(F.col("__point").isNotNull())
    seg = F.when(F.col("__point.__known"), F.coalesce("__own", "__seg"))
    return found.select("__point.*", seg.alias("__s")).select(*asked.columns, *[F.col("__s").getField(f).alias(f) for f in fields])


def interpolate_linear(
    points: DataFrame, at: Column, curve: DataFrame | Settled, x: str, y: str, new: str
) -> DataFrame:
    """Piecewise-linear value of the curve at ``at``; beyond its ends the first and last segments are extended."""
    found = locate(points, at, curve, x, [y])
    slope = (F.col(f"{y}1") - F.col(f"{y}0")) / (F.col("__x1") - F.col("__x0"))
    return found.withColumn(new, F.col(f"{y}0") + slope * (F.col("__at") - F.col("__x0"))).drop(
        "__at", "__x0", "__x1", f"{y}0", f"{y}1"
    )


def forward_diff(curve: DataFrame, x: str, y: str, new: str, step: float = 1.0) -> DataFrame:
    """``f(x + step) - f(x)`` at every point of the curve."""
    kept = settle(curve)
    ahead = interpolate_linear(kept.df, F.col(x) + step, kept, x, y, "__ahead")
    return ahead.withColumn(new, F.col("__ahead") - F.col(y)).drop("__ahead")


def grid(spark, lo: float, hi: float, n: int, new: str = "x") -> DataFrame:
    """``n`` evenly spaced values from ``lo`` to ``hi``."""
    return spark.range(n).select((F.lit(float(lo)) + F.col("id") * ((hi - lo) / (n - 1))).alias(new))


def exact_median(df: DataFrame, value: str) -> float | None:
    """Median from counts of distinct values."""
    counts = value_counts(df, value)
    n = counts.agg(F.sum("n")).first()[0]
    if not n:
        return None
    low, high = (n - 1) // 2, n // 2
    end = F.col("n_before") + F.col("n")
    picked = counts.agg(
        F.max(F.when((F.col("n_before") <= low) & (end > low), F.col(value))).alias("a"),
        F.max(F.when((F.col("n_before") <= high) & (end > high), F.col(value))).alias("b"),
    ).first()
    return (picked["a"] + picked["b"]) / 2.0


def _bandwidths(dense: Settled, x: str, k: int) -> DataFrame:
    """Distance to the k-th nearest row for every distinct x, from counts of rows before it.

    A window of k rows that starts at a distinct value reaches to the value at position ``n_before + k - 1``; the best
    window around x is found where the sum of both ends passes 2x.
    """
    starts = dense.df.select(x, "n_before")
    last = dense.df.agg(F.max(F.col("n_before") + F.col("n")).alias("n")).first()["n"]
    reach = F.col("n_before") + (k - 1)
    wins = locate(starts.filter(reach < last), reach, Settled(starts, dense.small), "n_before", [x])
    # Position p lies in the block that starts at or before it; the last block has no next one.
    end = F.when(F.col("__at") >= F.col("__x1"), F.col(f"{x}1")).otherwise(F.col(f"{x}0"))
    spans = wins.select(F.col(x).alias("l"), end.alias("r")).withColumn("mid", F.col("l") + F.col("r"))
    spans = settle(spans.groupBy("mid").agg(F.max("l").alias("l"), F.min("r").alias("r")))
    if spans.df.limit(2).count() < 2:
        only = spans.df.first()
        near = F.greatest(F.col(x) - only["l"], F.lit(only["r"]) - F.col(x))
        return dense.df.select(x, near.alias("h"))
    found = locate(dense.df.select(x), 2 * F.col(x), spans, "mid", ["l", "r"])
    left, right = F.col(x) - F.col("l0"), F.col("r1") - F.col(x)
    outer = F.when(F.col("__at") < F.col("__x0"), F.col("r0") - F.col(x)).when(
        F.col("__at") >= F.col("__x1"), F.col(x) - F.col("l1")
    )
    return found.select(x, F.coalesce(outer, F.least(left, right)).alias("h"))


def _local_lines(dense: DataFrame, targets: DataFrame, x: str) -> DataFrame:
    """Weighted local line at every target from sums of tricube weights inside its bandwidth."""
    span = dense.agg(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi")).first()
    width = (span["hi"] - span["lo"]) / BUCKETS or 1.0
    lo = span["lo"]

    def bucket(c: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), F.floor((c - lo) / width))).cast("int")

    wide = targets.select(
        F.col(x).alias("__t"),
        "h",
        F.explode(F.sequence(bucket(F.col(x) - F.col("h")), bucket(F.col(x) + F.col("h")))).alias("__bucket"),
    )
    near = wide.join(dense.withColumn("__bucket", bucket(F.col(x))), "__bucket")
    d = F.col(x) - F.col("__t")
    u = F.least(F.lit(1.0), F.coalesce(F.try_divide(F.abs(d), F.col("h")), F.when(d == 0, 0.0).otherwise(1.0)))
    tri = F.pow(1 - F.pow(u, F.lit(3.0)), F.lit(3.0))
    w, wy = tri * F.col("sw"), tri * F.col("swy")
    sums = near.groupBy("__t").agg(
        F.sum(w).alias("a"),
        F.sum(w * d).alias("b"),
        F.sum(w * d * d).alias("c"),
        F.sum(wy).alias("p"),
        F.sum(wy * d).alias("q"),
        F.max("h").alias("h"),
    )
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    flat = det <= 1e-12 * F.col("a") * F.col("a") * F.greatest(F.col("h") * F.col("h"), F.lit(1e-300))
    line = F.try_divide(F.col("c") * F.col("p") - F.col("b") * F.col("q"), det)
    mean = F.try_divide(F.col("p"), F.col("a"))
    return sums.select(F.col("__t").alias(x), F.when(flat, mean).otherwise(line).alias("fitted"))


def loess(df: DataFrame, x: str, y: str, frac: float = 0.3, iters: int = 3) -> DataFrame:
    """Local linear regression with tricube weights and robust re-weighting: one row ``x, fitted`` per distinct x.

    Rows are first summed per distinct x, so the pairing of targets and neighbours depends on the resolution of the
    axis and not on the number of rows. Every robust pass needs one median and one fit.
    """
    rows = df.select(F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).filter(
        F.col(x).isNotNull() & F.col(y).isNotNull()
    )
    dense = settle(value_counts(rows.withColumn("__one", F.lit(1.0)), x, {"sw": "__one", "swy": y}))
    total = dense.df.agg(F.sum("n")).first()[0] or 0
    k = max(1, int(frac * total + 1e-10))
    targets = settle(_bandwidths(dense, x, k)).df
    fit = settle(_local_lines(dense.df.select(x, "sw", "swy"), targets, x))
    for _ in range(iters):
        residuals = (
            rows.join(F.broadcast(fit.df) if fit.small else fit.df, x)
            .withColumn("__r", F.col(y) - F.col("fitted"))
            .withColumn("__abs", F.abs("__r"))
        )
        scale = exact_median(residuals, "__abs")
        if not scale:
            break
        u = F.col("__r") / (6.0 * scale)
        delta = F.when(F.abs(u) < 1, (1 - u * u) * (1 - u * u)).otherwise(0.0)
        weighted = residuals.withColumn("__d", delta).groupBy(x).agg(
            F.sum("__d").alias("sw"), F.sum(F.col("__d") * F.col(y)).alias("swy")
        )
        fit = settle(_local_lines(settle(weighted).df, targets, x))
    return fit.df


def curve_sums(df: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct x with the mean of y, ready for interpolation."""
    return df.groupBy(x).agg(F.avg(y).alias(y))


def bounds(df: DataFrame, c: str) -> Column:
    return one_row(df, lo=F.min(c), hi=F.max(c))
