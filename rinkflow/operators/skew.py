"""Finding hot groups and cutting them into ordered segments of bounded size."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkflow.operators.sizing import Settled, join_dim, settle
from rinkflow.session import max_group_rows

SEGMENT = "__segment"
HOT = "__hot"
CUTS = "__cuts"


@dataclass(frozen=True)
class Groups:
    """How the rows of ``keys`` are spread; ``cuts`` holds split points of the groups above the limit."""

    keys: tuple[str, ...]
    order: str | None
    cuts: Settled | None = None
    pieces: int = 1

    @property
    def hot(self) -> bool:
        return self.cuts is not None

    def segmented(self, df: DataFrame) -> DataFrame:
        """Add the segment number (0 for groups within the limit) and the hot flag."""
        stride = max(1, math.isqrt(self.pieces))
        order = F.col(self.order)
        joined = join_dim(df, self.cuts, self.keys, nulls=True)
        # Two short scans (every stride-th cut, then one stride) instead of one long scan of the cuts.
        heads = F.filter(F.col(CUTS), lambda c, i: (i % stride == stride - 1) & (c < order))
        block = F.size(heads)
        inner = F.size(F.filter(F.slice(F.col(CUTS), block * stride + 1, stride), lambda c: c < order))
        # Rows without an order come last, as in a window of the whole group.
        segment = F.when(F.col(CUTS).isNull(), F.lit(0)).when(order.isNull(), F.size(CUTS)).otherwise(block * stride + inner)
        return joined.withColumns(
            {
                SEGMENT: segment,
                HOT: F.col(CUTS).isNotNull(),
            }
        ).drop(CUTS)


def measure_groups(
    df: DataFrame, keys: Sequence[str], order: str | None = None, max_rows: int | None = None
) -> Groups:
    """Count rows per group (map-side combined, keys only) and, where needed, cut the hot groups by ``order``.

    Equal order values stay in one segment, so an order column should be unique within its group.
    """
    limit = max_group_rows(df.sparkSession) if max_rows is None else max_rows
    keys = tuple(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    top = sizes.agg(F.max("__n")).first()[0] or 0
    if top <= limit:
        return Groups(keys, order)
    hot = settle(sizes.filter(F.col("__n") > limit).select(*keys))
    if order is None:
        return Groups(keys, order, hot, 1)
    pieces = math.ceil(top / limit) + 1
    probs = [i / pieces for i in range(1, pieces)]
    cuts = (
        join_dim(df.select(*keys, order), hot, keys, "left_semi", nulls=True)
        .groupBy(*keys)
        .agg(F.array_distinct(F.percentile_approx(order, probs, 20 * pieces)).alias(CUTS))
    )
    return Groups(keys, order, settle(cuts), pieces)

