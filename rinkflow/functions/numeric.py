"""Guarded arithmetic, scaling and display formats."""

from __future__ import annotations

import math
from fractions import Fraction
from functools import reduce
from operator import add, and_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shots of a game, of a season and of a starter's full season; widths of the two intervals.
SHOTS_PER_GAME = 30
SHOTS_PER_SEASON = 1500
REFERENCE_SHOTS = 1800
Z_80 = 1.28
Z_95 = 1.96


def safe_ratio(a: Column, b: Column, compat: str = "fixed") -> Column:
    """a / b; null for a zero divisor, or signed infinity (NaN for 0/0) with ``compat="reference"``."""
    ratio = F.try_divide(a.cast("double"), b.cast("double"))
    if compat == "reference":
        inf = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
        return F.when((b == 0) & a.isNotNull(), inf).otherwise(ratio)
    return ratio


def exact_sum(*terms: Column) -> Column:
    """The sum of all terms of all rows, which the order of rows doesn't change, so that equal groups have equal sums.

    Doubles are added as whole numbers of 2 ** -56, which is exact for those of 1/16 and more, and become a double once. Where a value
    is none (128 and more, infinite, NaN), the group is added as doubles.
    """
    units = [F.rint(c * F.lit(2.0**56)).try_cast("bigint").cast("decimal(20,0)") for c in terms]
    whole = reduce(and_, [F.count(c) == F.count(u) for c, u in zip(terms, units, strict=True)])
    exact = reduce(add, [F.sum(u) for u in units]).cast("double") / F.lit(2.0**56)
    return F.when(whole, exact).otherwise(reduce(add, [F.sum(c).cast("double") for c in terms]))


def round_to(c: Column, n: int) -> Column:
    return F.round(c, n)


def scale(c: Column, k: float) -> Column:
    return c * F.lit(k)


def obs_noise(base: float, shots: Column, reference: int = REFERENCE_SHOTS) -> Column:
    """Measurement noise that grows when fewer shots than a full season were faced."""
    return F.lit(base) * F.greatest(F.lit(float(reference)) / F.greatest(shots, F.lit(1)), F.lit(1.0))


def interval(mean: Column, sd: Column, z: float) -> tuple[Column, Column]:
    return mean - F.lit(z) * sd, mean + F.lit(z) * sd


# The three trend texts.
def trend_label(current: Column, projected: Column, eps: float = 1e-4) -> Column:
    diff = projected - current
    return (
        F.when(F.abs(diff) < eps, F.lit("STABLE"))
        .when(diff > 0, F.lit("TRENDING UP ↑"))
        .when(diff.isNotNull(), F.lit("TRENDING DOWN ↓"))
    )


def fmt_season(season: Column) -> Column:
    """20242025 as 2024-25; other lengths unchanged."""
    text = season.cast("string")
    return F.when(F.length(text) == 8, F.concat(F.substring(text, 1, 4), F.lit("-"), F.substring(text, 7, 2))).otherwise(
        text
    )


def fmt_pct(share: Column, compat: str = "fixed") -> Column:
    """Save percentage such as .915; the reference form drops leading zeros of the three digits."""
    digits = F.round(share * 1000).cast("bigint").cast("string")
    if compat != "reference":
        digits = F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)
    return F.coalesce(F.concat(F.lit("."), digits), F.lit("—"))


def fmt_signed(c: Column, n: int = 4) -> Column:
    """Signed text of ``n`` places, rounded by the exact value of the double, as printf does.

    ``format_string`` would round the shortest decimal that reads back as the double: 0.00135, which is a little more, and 0.00145,
    which is a little less, both upwards.
    """
    digits = "0." + "0" * n if n else "0"
    # format_number takes halves of the last place for exact where nothing stands before them.
    half = Fraction(1, 2 * 10**n)
    least = float(half) if Fraction(float(half)) > half else math.nextafter(float(half), 1)
    near = F.concat(F.when(c < 0, F.lit("-")).otherwise(F.lit("")), F.when(F.abs(c) >= least, F.lit(f"{10.0**-n:.{n}f}")).otherwise(F.lit(digits)))
    text = F.when(F.abs(c) < 10.0**-n, near).otherwise(F.call_function("format_number", c, F.lit(digits)))
    return F.concat(F.when(c >= 0, F.lit("+")).otherwise(F.lit("")), F.when(F.abs(c) < float("inf"), text).otherwise(F.format_string(f"%.{n}f", c)))
