"""Ages, talent by age and the ageing curve."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkflow.functions import clock
from rinkflow.operators.interpolation import forward_diff, grid, interpolate_linear, loess
from rinkflow.operators.sizing import join_dim


def resolve_fallback(keys: DataFrame, fetched: DataFrame, fallback: DataFrame, key: str, value: str) -> DataFrame:
    """The fetched value, else the fallback; keys with neither are dropped."""
    x = join_dim(keys, fetched.select(key, F.col(value).alias("__a")), [key])
    x = join_dim(x, fallback.select(key, F.col(value).alias("__b")), [key])
    return x.withColumn(value, F.coalesce("__a", "__b")).drop("__a", "__b").filter(F.col(value).isNotNull())


def true_talent(team_seasons: DataFrame, effects: DataFrame | None) -> DataFrame:
    """Goals saved per shot minus the team's effect of that season; 0 where there is none."""
    effect = "dsis_team_defense_impact_per_shot"
    if effects is None:
        x = team_seasons.withColumn(effect, F.lit(0.0))
    else:
        x = join_dim(team_seasons, effects.select("team_id", "season", effect), ["team_id", "season"])
        x = x.fillna({effect: 0.0})
    per_shot = F.col("raw_gsax_2_0") / F.col("shots_faced")
    return x.withColumn("raw_gsax_per_shot", per_shot).withColumn("seasonal_true_talent", per_shot - F.col(effect))


def exact_age(rows: DataFrame, births: DataFrame, key: str = "goalie_id") -> DataFrame:
    """Age on October 1 of the season; goalies without a birth date are dropped."""
    season = F.col("season")
    return (
        join_dim(rows, births.select(key, "birth_date"), [key], "inner")
        .withColumn("season_start_year", clock.season_start_year(season))
        .withColumn("season_start_date", clock.season_start(season))
        .withColumn("exact_age", clock.age_years(F.col("birth_date"), F.col("season_start_date")))
    )


def age_filter(rows: DataFrame, lo: float = 20, hi: float = 40, age: str = "exact_age") -> DataFrame:
    return rows.filter(F.col(age).between(lo, hi))


def age_curve_grid(
    points: DataFrame, x: str, y: str, lo: float = 20.0, hi: float = 42.0, n: int = 221, digits: int = 1
) -> DataFrame:
    """A fitted curve on an even grid with its change over the next year."""
    ages = grid(points.sparkSession, lo, hi, n, "age")
    talent = interpolate_linear(ages, F.col("age"), points, x, y, "expected_true_talent")
    drift = forward_diff(talent, "age", "expected_true_talent", "yearly_drift")
    return drift.withColumn("age", F.round("age", digits))


def age_curve(rows: DataFrame, age: str = "exact_age", talent: str = "seasonal_true_talent", frac: float = 0.3, iters: int = 3) -> DataFrame:
    """Fit at the data's ages, then read the grid."""
    fitted = loess(age_filter(rows, age=age), age, talent, frac, iters)
    return age_curve_grid(fitted, age, "fitted")


def peak_age(curve: DataFrame, sample_ages: tuple[float, ...] = (22, 25, 27, 28, 30, 33, 35, 38)) -> DataFrame:
    """The age of the highest value, and the curve at sample ages."""
    peak = curve.agg(
        F.max_by(F.struct("age", "expected_true_talent", "yearly_drift"), "expected_true_talent").alias("p")
    ).select(F.lit("peak").alias("kind"), "p.*")
    samples = curve.filter(F.col("age").isin(*[float(a) for a in sample_ages])).select(
        F.lit("sample").alias("kind"), "age", "expected_true_talent", "yearly_drift"
    )
    return peak.unionByName(samples)
