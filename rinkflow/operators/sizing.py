"""Size checks that decide between a broadcast and a shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinkflow.session import cut_lineage, max_small_rows

# A side is small only if its rows take no more memory than this.
SMALL_BYTES = 64 << 20


@dataclass(frozen=True)
class Settled:
    """Rows computed once. ``small`` says that their number was checked against the limit."""

    df: DataFrame
    small: bool


def settle(df: DataFrame, max_rows: int | None = None) -> Settled:
    """Compute ``df`` once: a local relation when it has at most ``max_rows`` rows, else a reliable checkpoint.

    At most ``max_rows + 1`` rows reach the driver, whatever the size of ``df``; they are small only if their bytes are few too.
    """
    spark = df.sparkSession
    limit = max_small_rows(spark) if max_rows is None else max_rows
    head = df.limit(limit + 1).toArrow()
    if head.num_rows <= limit and head.nbytes <= SMALL_BYTES:
        return Settled(spark.createDataFrame(head, schema=df.schema), True)
    return Settled(cut_lineage(df), False)


def join_dim(
    facts: DataFrame,
    dim: DataFrame | Settled,
    on: Sequence[str],
    how: str = "left",
    max_rows: int | None = None,
    nulls: bool = False,
) -> DataFrame:
    """Join a dimension whose size is checked first: broadcast within the limit, shuffle join beyond it.

    With ``nulls`` a null key meets a null key, as in a group.
    """
    side = dim if isinstance(dim, Settled) else settle(dim, max_rows)
    right = F.broadcast(side.df) if side.small else side.df
    return null_safe_join(facts, right, on, how) if nulls else facts.join(right, list(on), how)


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join on columns of one name on both sides, in which null equals null; the left side's columns stay."""
    names = {c: f"__right_{c}" for c in on}
    other = right.withColumnsRenamed(names)
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    return left.join(other, same, how).drop(*names.values())


def one_row(df: DataFrame, **aggs: Column) -> Column:
    """Whole-table aggregates as a scalar subquery with one struct field per keyword (no join)."""
    return df.agg(F.struct(*[c.alias(n) for n, c in aggs.items()]).alias("v")).scalar()


def guard_rows(df: DataFrame, n: int) -> bool:
    """Whether ``df`` has at least ``n`` rows, reading no more than needed."""
    return df.limit(n).count() >= n
