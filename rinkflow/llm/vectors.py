"""Vectors as rows: which take part, matrices of a batch, cosines that do not depend on where a vector stands."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def common_length(df: DataFrame, vector: str) -> int:
    """The most frequent length of the vectors (the smaller one of equals); 0 without rows."""
    sizes = df.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return sizes["d"] if sizes else 0


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that neither very small nor very large components lose their squares."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosines in double precision, summed in the order of the components: equal vectors get equal values in every block."""
    dots = np.zeros((len(left), len(right)))
    a, b = np.zeros(len(left)), np.zeros(len(right))
    for k in range(left.shape[1]):
        x, y = left[:, k], right[:, k]
        dots += x[:, None] * y[None, :]
        a += x * x
        b += y * y
    return dots / (np.sqrt(a)[:, None] * np.sqrt(b)[None, :])
