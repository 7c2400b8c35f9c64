"""Calibration and evaluation of scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkflow.functions.numeric import safe_ratio
from rinkflow.operators.ranks import row_numbers, value_counts
from rinkflow.operators.sizing import join_dim, one_row, settle
from rinkflow.session import cut_lineage
from rinkflow.sources.datasets import rewrite_dataset

# Groups that are dealt into folds one by one on the driver.
LARGEST = 50_000


def calibration_factor(
    df: DataFrame, by: Sequence[str] = ("season",), y: str = "is_goal", p: str = "xg_prob", compat: str = "fixed"
) -> DataFrame:
    """Sum of outcomes over sum of probabilities per group."""
    sums = df.groupBy(*by).agg(F.sum(y).alias("goals"), F.sum(p).alias("expected"))
    return sums.select(*by, safe_ratio(F.col("goals"), F.col("expected"), compat).alias("calib_factor"))


def calibrate(
    df: DataFrame, by: Sequence[str] = ("season",), y: str = "is_goal", p: str = "xg_prob", compat: str = "fixed"
) -> DataFrame:
    """Scale probabilities so that both sums agree in every group: one aggregation, then a join with the factors.

    A group whose probabilities sum to zero has no factor and keeps null probabilities.
    """
    factors = calibration_factor(df, by, y, p, compat)
    return join_dim(df, factors, list(by)).withColumn(p, F.col(p) * F.col("calib_factor")).drop("calib_factor")


def sums_check(df: DataFrame, label: str, y: str = "is_goal", p: str = "xg_prob") -> DataFrame:
    """One row with both sums."""
    return df.agg(F.sum(p).alias("expected"), F.sum(y).cast("bigint").alias("goals")).select(
        F.lit(label).alias("version"), "expected", "goals"
    )


def recalibrate_check(df: DataFrame, by: Sequence[str] = ("season",)) -> DataFrame:
    return sums_check(df, "original").unionByName(sums_check(calibrate(df, by), "calibrated"))


def recalibrate(df: DataFrame, by: Sequence[str] = ("season",), name: str = "scored_shots") -> DataFrame:
    """A calibrated new version of the dataset, written and checked before it is returned."""
    columns = [*[c for c in df.columns if c != "xg_prob"], "xg_prob"]
    return rewrite_dataset(calibrate(df, by).select(*columns), name, ["xg_prob", "is_goal"])


def log_loss(y: str, p: str):
    """Mean log loss; probabilities are kept a rounding unit away from 0 and 1."""
    eps = 2.220446049250313e-16
    q = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), F.col(p)))
    return F.avg(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q)))


def brier(y: str, p: str):
    return F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y)))


def auc(df: DataFrame, y: str, p: str) -> DataFrame:
    """Exact area under the curve from counts per distinct score; 0.5 with a single class."""
    counts = value_counts(df.select(p, F.col(y).cast("bigint").alias("__y")), p, {"pos": "__y"})
    pos, n = F.sum("pos"), F.sum("n")
    rank_sum = F.sum(F.col("pos") * (F.col("n_before") + (F.col("n") + 1) / 2.0))
    area = F.try_divide(rank_sum - pos * (pos + 1) / 2.0, (pos * (n - pos)).cast("double"))
    return counts.agg(F.coalesce(area, F.lit(0.5)).alias("auc"))


def evaluate(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: log loss, Brier score, area under the curve."""
    losses = df.agg(log_loss(y, p).alias("log_loss"), brier(y, p).alias("brier_score"))
    return losses.withColumn("auc", one_row(auc(df, y, p), v=F.first("auc")).getField("v"))


def bin_edges(bins: int = 10) -> list[float]:
    """Inner edges of equal-width bins over [0, 1]."""
    return [i * (1.0 / bins) for i in range(1, bins)]


def calibration_curve(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Mean outcome and mean probability per equal-width bin; an edge value goes to the lower bin."""
    index = F.lit(0)
    for edge in bin_edges(bins):
        index = index + (F.col(p) > edge).cast("int")
    return (
        df.groupBy(index.alias("bin"))
        .agg(F.avg(y).alias("prob_true"), F.avg(p).alias("prob_pred"), F.count(F.lit(1)).alias("n"))
        .orderBy("bin")
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights: rows / (classes * rows of the class)."""
    sizes = settle(df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))).df
    total = one_row(sizes, rows=F.sum("n"), classes=F.count(F.lit(1)))
    return sizes.withColumn("t", total).select(
        label, (F.col("t.rows") / (F.col("t.classes") * F.col("n"))).alias("weight")
    )


def with_class_weights(df: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    return join_dim(df, class_weights(df, label), [label]).withColumnRenamed("weight", weight)


def _turns(sizes: Sequence[tuple[int, int]], k: int) -> list[tuple[int, list[int], list[list[int]]]]:
    """Greedy dealing of ``(size, groups of that size)``, largest first, without a step per group.

    Groups of one size n raise the loads by n each, so the lightest fold is taken in the order of load modulo n among the folds
    that are no fuller. Per size: from which of its groups on (``starts``) the folds take turns in which order (``orders``).
    """
    load, out = [0] * k, []
    for n, count in sizes:
        first, floor = list(load), [v // n for v in load]
        levels = sorted(set(floor))
        starts: list[int] = []
        orders: list[list[int]] = []
        at = 0
        for i, level in enumerate(levels):
            order = sorted((f for f in range(k) if floor[f] <= level), key=lambda f: (first[f] % n, f))
            taken = count - at if i + 1 == len(levels) else min(count - at, len(order) * (levels[i + 1] - level))
            starts.append(at)
            orders.append(order)
            for j, f in enumerate(order):
                load[f] += n * (taken // len(order) + (j < taken % len(order)))
            at += taken
            if at == count:
                break
        out.append((n, starts, orders))
    return out


def group_folds(df: DataFrame, group: str, k: int | None = 5, largest: int | None = None) -> DataFrame:
    """One fold per whole group, largest groups first into the lightest fold; ``k=None`` leaves one group out.

    Groups are counted in Spark. Up to ``largest`` (``LARGEST``) groups are dealt in a loop. Of more, only the number of groups of
    each size reaches the driver (the square root of twice the rows at most) and groups find their fold by their place in the
    order. Both ways give the same folds.
    """
    sizes = settle(df.groupBy(group).agg(F.count(F.lit(1)).alias("n")))
    n = sizes.df.count()
    folds = n if k is None else min(k, n)
    kind = dict(df.dtypes)[group]
    ordered = sizes.df.orderBy(F.desc("n"), F.desc(group))
    if n <= (LARGEST if largest is None else largest):
        load = [0] * max(folds, 1)
        dealt = []
        for i, r in enumerate(ordered.collect()):
            fold = i if k is None else load.index(min(load))
            load[fold] += r["n"]
            dealt.append((r[group], fold))
        return df.sparkSession.createDataFrame(dealt, f"{group} {kind}, fold bigint")
    # Sorted ranges hold whole groups, so none is larger than others; the upper bits of the id are the range, the lower ones the place in it.
    placed = cut_lineage(ordered.withColumn("__id", F.monotonically_increasing_id()))
    placed = placed.withColumns({"__range": F.shiftright("__id", 33), "__place": F.col("__id").bitwiseAND((1 << 33) - 1)})
    before, starts = 0, []
    for r in placed.groupBy("__range").count().orderBy("__range").collect():
        starts.append((r["__range"], before))
        before += r["count"]
    ranges = df.sparkSession.createDataFrame(starts, "__range bigint, __before bigint")
    ranked = placed.join(F.broadcast(ranges), "__range").withColumn("__rank", F.col("__before") + F.col("__place"))
    if k is None:
        return ranked.select(group, F.col("__rank").alias("fold"))
    counts = [(r["n"], r["count"]) for r in placed.groupBy("n").count().orderBy(F.desc("n")).collect()]
    rows, before = [], 0
    for (size, count), (_, turns, orders) in zip(counts, _turns(counts, folds), strict=True):
        rows.append((size, before, turns, orders))
        before += count
    plan = df.sparkSession.createDataFrame(rows, "n bigint, __larger bigint, __starts array<bigint>, __orders array<array<bigint>>")
    turn = F.col("__rank") - F.col("__larger")
    known = join_dim(ranked, plan, ["n"]).withColumn("__turn", turn)
    known = known.withColumn("__at", F.size(F.filter("__starts", lambda s: s <= F.col("__turn"))))
    order, start = F.element_at("__orders", F.col("__at")), F.element_at("__starts", F.col("__at"))
    place = (F.col("__turn") - start) % F.size(order)
    return known.select(group, F.element_at(order, (place + 1).cast("int")).alias("fold"))


def with_folds(df: DataFrame, group: str, k: int | None = 5) -> DataFrame:
    return join_dim(df, group_folds(df, group, k), [group])


def stratified_split(
    df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int = 42, order: str | None = None
) -> DataFrame:
    """Add ``is_test`` for a share of every class, in seeded hash order of ``key`` or in the given order.

    With fewer than two rows in a class, all rows are split together.
    """
    classes = settle(df.groupBy(label).agg(F.count(F.lit(1)).alias("__n")))
    whole = classes.df.filter(F.col("__n") < 2).count() > 0 or classes.df.count() < 2
    value = F.col(order).cast("double") if order else F.xxhash64(F.lit(seed), F.col(key)).cast("double")
    by = [] if whole else [label]
    numbered = row_numbers(df.withColumn("__v", value), "__v", key, "__rn", by)
    if whole:
        numbered = numbered.withColumn("__n", F.lit(df.count()))
    else:
        numbered = join_dim(numbered, classes, [label])
    return numbered.withColumn("is_test", F.col("__rn") <= F.round(F.col("__n") * test_share)).drop("__v", "__rn", "__n")
