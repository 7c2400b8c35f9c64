"""Row context inside ordered groups: neighbours, running values and range frames.

Each operator takes the result of ``measure_groups``. Groups within the limit use one window; a hot group is cut
into ordered segments, the window runs per segment, and what crosses a border is carried over from small tables
(a few rows per segment).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rinkflow.operators.sizing import join_dim, null_safe_join, settle
from rinkflow.operators.skew import HOT, SEGMENT, Groups, measure_groups


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    cols: Mapping[str, tuple[str, int]],
    groups: Groups | None = None,
    tie: str | None = None,
) -> DataFrame:
    """Add values of nearby rows: ``{new: (column, k)}`` is ``k`` rows back for k > 0 and ``-k`` rows ahead for k < 0.

    Rows with equal ``order`` come by ``tie``, and by a hash of their values where that is left out; null orders come last.
    """
    groups = groups or measure_groups(df, keys, order)
    by = [F.asc_nulls_last(order), F.asc_nulls_last(tie) if tie else row_hash(df).asc()]

    def shifted(w):
        return {new: F.lag(c, k).over(w) if k > 0 else F.lead(c, -k).over(w) for new, (c, k) in cols.items()}

    if not groups.hot:
        return df.withColumns(shifted(W.partitionBy(*keys).orderBy(*by)))

    reach = max(abs(k) for _, k in cols.values())
    inner = W.partitionBy(*keys, SEGMENT).orderBy(*by)
    local = groups.segmented(df).withColumns(
        {
            **shifted(inner),
            "__rn": F.row_number().over(inner),
            "__head": F.lag(F.lit(1), reach).over(inner).isNull(),
            "__tail": F.lead(F.lit(1), reach).over(inner).isNull(),
        }
    )
    # The first and last rows of every segment of a hot group are contiguous around each border.
    sources = sorted({c for c, _ in cols.values()} - {*keys})
    border = local.filter(F.col(HOT) & (F.col("__head") | F.col("__tail"))).select(*keys, SEGMENT, "__rn", *sources)
    moved = shifted(W.partitionBy(*keys).orderBy(SEGMENT, "__rn"))
    patch = border.select(
        *keys,
        SEGMENT,
        "__rn",
        F.struct(*[moved[new].alias(new) for new in cols]).alias("__fix"),
    )
    fixed = join_dim(local, settle(patch), [*keys, SEGMENT, "__rn"], nulls=True)
    picked = {}
    for new, (_, k) in cols.items():
        edge = F.col("__head") if k > 0 else F.col("__tail")
        picked[new] = F.when(F.col("__fix").isNotNull() & edge, F.col("__fix").getField(new)).otherwise(F.col(new))
    return fixed.withColumns(picked).drop("__fix", "__head", "__tail", "__rn", SEGMENT, HOT)


def row_hash(df: DataFrame) -> Column:
    """A hash of the row, so that rows with equal order have the same sequence whichever way they are computed."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    cols: Mapping[str, tuple[Column, str, bool]],
    default: int | float = 0,
    groups: Groups | None = None,
) -> DataFrame:
    """Add running values ``{new: (expression, "sum" | "max", include_current)}``; ``default`` where there is none."""
    groups = groups or measure_groups(df, keys, order)
    fns = {"sum": F.sum, "max": F.max}
    by = [F.asc_nulls_last(order), row_hash(df).asc()]

    def framed(part):
        w = W.partitionBy(*part).orderBy(*by)
        return {
            new: fns[kind](expr).over(w.rowsBetween(W.unboundedPreceding, 0 if current else -1))
            for new, (expr, kind, current) in cols.items()
        }

    if not groups.hot:
        return df.withColumns({n: F.coalesce(c, F.lit(default)) for n, c in framed(keys).items()})

    base = groups.segmented(df)
    totals = base.filter(HOT).groupBy(*keys, SEGMENT).agg(
        *[fns[kind](expr).alias(f"__t_{new}") for new, (expr, kind, _) in cols.items()]
    )
    before = W.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(
        *keys, SEGMENT, *[fns[kind](f"__t_{new}").over(before).alias(f"__c_{new}") for new, (_, kind, _) in cols.items()]
    )
    joined = join_dim(base.withColumns(framed([*keys, SEGMENT])), settle(carry), [*keys, SEGMENT], nulls=True)
    out = {}
    for new, (_, kind, _) in cols.items():
        own, old = F.col(new), F.col(f"__c_{new}")
        both = F.greatest(own, old) if kind == "max" else F.coalesce(own, F.lit(0)) + F.coalesce(old, F.lit(0))
        out[new] = F.coalesce(both, F.lit(default))
    return joined.withColumns(out).drop(SEGMENT, HOT, *[f"__c_{n}" for n in cols])


def range_counts(
    df: DataFrame,
    keys: Sequence[str],
    axis: str,
    cols: Mapping[str, tuple[Column, int, int]],
    groups: Groups | None = None,
) -> DataFrame:
    """Count earlier rows whose ``axis`` lies in ``[value + lo, value + hi]``: ``{new: (flag, lo, hi)}`` with lo <= hi < 0.

    ``axis`` is a whole number. With hot groups, flags are summed per axis value first and long axes are cut into
    stretches; each stretch also gets the rows of the previous one that its frames can reach.
    """
    groups = groups or measure_groups(df, keys)
    flags = {new: F.when(flag, 1).otherwise(0) for new, (flag, _, _) in cols.items()}
    if not groups.hot:
        w = W.partitionBy(*keys).orderBy(axis)
        counted = {
            new: F.when(F.col(axis).isNull(), F.lit(0)).otherwise(
                F.coalesce(F.sum(flags[new]).over(w.rangeBetween(lo, hi)), F.lit(0))
            )
            for new, (_, lo, hi) in cols.items()
        }
        return df.withColumns(counted)

    reach = -min(lo for _, lo, _ in cols.values())
    stretch = max(86_400, 16 * reach)
    dense = df.filter(F.col(axis).isNotNull()).groupBy(*keys, axis).agg(*[F.sum(flags[n]).alias(n) for n in cols])
    own = F.floor(F.col(axis) / stretch)
    placed = dense.withColumn(
        "__s", F.explode(F.array_distinct(F.array(own, F.floor((F.col(axis) + reach) / stretch))))
    )
    w = W.partitionBy(*keys, "__s").orderBy(axis)
    summed = (
        placed.select(
            *keys,
            axis,
            "__s",
            *[F.coalesce(F.sum(n).over(w.rangeBetween(lo, hi)), F.lit(0)).alias(n) for n, (_, lo, hi) in cols.items()],
        )
        .filter(F.col("__s") == own)
        .drop("__s")
    )
    return null_safe_join(df, summed, [*keys, axis]).withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in cols})


def group_values(
    df: DataFrame, keys: Sequence[str], cols: Mapping[str, Column], hot: bool
) -> DataFrame:
    """Add whole-group aggregates to every row: a window when groups are bounded, else aggregate and join."""
    if not hot:
        w = W.partitionBy(*keys)
        return df.withColumns({n: c.over(w) for n, c in cols.items()})
    return null_safe_join(df, df.groupBy(*keys).agg(*[c.alias(n) for n, c in cols.items()]), keys)


def event_sequence(older: Column, newer: Column, sep: str = "->") -> Column:
    """Two event names in order; null when either is missing."""
    return F.concat(older, F.lit(sep), newer)
