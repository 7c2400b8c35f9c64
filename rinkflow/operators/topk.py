"""Sorted heads, latest rows and deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_n(df: DataFrame, by: str, tie: str, n: int, ascending: bool = False) -> DataFrame:
    """The first ``n`` rows and their rank; nulls last, ties in key order. Only the head is numbered."""
    order = [F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by), F.asc(tie)]
    head = df.orderBy(*order).limit(n)
    number = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order))
    return head.withColumn("rank", number.cast("bigint"))


# Above this many rows per key Spark does not cut heads before the exchange by itself.
GROUP_LIMIT = 1000
SALTS = 64


def recent_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows of every key.

    Heads are cut per task before the exchange. For a large ``n`` every key is first cut to ``n`` rows in each of
    several hashed parts, so that no task takes a whole hot key.
    """
    by = [F.desc_nulls_last(c) for c in order]
    if n > GROUP_LIMIT:
        part = W.partitionBy(*keys, F.pmod(F.xxhash64(*order), F.lit(SALTS))).orderBy(*by)
        df = df.withColumn("__part", F.row_number().over(part)).filter(F.col("__part") <= n).drop("__part")
    w = W.partitionBy(*keys).orderBy(*by)
    return df.withColumn("recency", F.row_number().over(w).cast("bigint")).filter(F.col("recency") <= n)


def order_nulls_last(df: DataFrame, *cols: str) -> DataFrame:
    """Sorted rows; a leading ``-`` means descending."""
    return df.orderBy(*[F.desc_nulls_last(c[1:]) if c.startswith("-") else F.asc_nulls_last(c) for c in cols])


def sort_by(df: DataFrame, col: str, direction: str = "desc") -> DataFrame:
    """Sorted as a table heading would: null counts as the least value."""
    return df.orderBy(F.desc_nulls_last(col) if direction == "desc" else F.asc_nulls_first(col))


def latest_per_key(df: DataFrame, key: str, order: str, cols: Sequence[str]) -> DataFrame:
    """Values of the last row per key, found by aggregation."""
    return df.groupBy(key).agg(F.max_by(F.struct(order, *cols), order).alias("l")).select(key, "l.*")


def dedup_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first one counts; found by aggregation, so repeated keys do not meet in one sort."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("f")).select(key, "f.*")
