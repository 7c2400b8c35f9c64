"""Goalie metrics from scored shots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinkflow.functions.details import defending_team
from rinkflow.functions.geometry import movement_demand
from rinkflow.functions.numeric import exact_sum, safe_ratio
from rinkflow.operators.sequences import neighbours
from rinkflow.operators.sizing import join_dim, one_row, settle
from rinkflow.schemas import ON_GOAL_TYPES

GOALIE = "goalie_in_net_id"


def gsax_aggs(y: str = "is_goal", p: str = "xg_prob") -> list[Column]:
    """Shots, goals and goals saved above expectation."""
    return [
        F.count(F.lit(1)).alias("shots"),
        F.sum(y).cast("bigint").alias("goals"),
        exact_sum(F.col(p), -F.col(y)).alias("gsax"),
    ]


def save_pct() -> Column:
    return 1.0 - F.try_divide(F.col("goals"), F.col("shots"))


def gsax(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*gsax_aggs())


def faced(scored: DataFrame) -> DataFrame:
    """Shots against a goalie in the net."""
    return scored.filter(F.col(GOALIE).isNotNull() & (F.col("is_empty_net") == 0))


def with_team(scored: DataFrame) -> DataFrame:
    """Add the goalie's team."""
    team = defending_team(F.col("event_owner_team_id"), F.col("home_team_id"), F.col("away_team_id"))
    return scored.withColumn("team_id", team)


def rebounds(
    scored: DataFrame, max_gap: float = 3, max_distance: float = 30, compat: str = "fixed"
) -> DataFrame:
    """Mark saves followed by a near shot of the same team against the same goalie, with the follow-up's probability.

    The next shot is looked for within the period; ``compat="reference"`` looks within the game, where a clock that
    restarts makes the gap negative.
    """
    keys = ["game_id", GOALIE] if compat == "reference" else ["game_id", "period", GOALIE]
    ahead = {
        "next_time": ("time_seconds", -1),
        "next_event_type": ("event_type", -1),
        "next_distance": ("shot_distance", -1),
        "next_xg": ("xg_prob", -1),
        "next_team_id": ("event_owner_team_id", -1),
    }
    x = neighbours(scored, keys, "event_id", ahead)
    gap = F.col("next_time") - F.col("time_seconds")
    soon = gap <= max_gap if compat == "reference" else gap.between(0, max_gap)
    rebound = (
        (F.col("is_goal") == 0)
        & F.col("next_event_type").isin(*ON_GOAL_TYPES)
        & (F.col("next_team_id") == F.col("event_owner_team_id"))
        & soon
        & (F.col("next_distance") <= max_distance)
    )
    return x.withColumns(
        {
            "generated_rebound": F.when(rebound, 1).otherwise(0),
            "generated_rebound_xg": F.when(rebound, F.col("next_xg")).otherwise(0.0),
        }
    )


def goalie_season_metrics(
    scored: DataFrame,
    min_shots: int = 100,
    compat: str = "fixed",
    rci_by: Sequence[str] = (),
    max_gap: float = 3,
    max_distance: float = 30,
) -> DataFrame:
    """One row per goalie and season with more than ``min_shots`` shots.

    Rebound control compares rate times danger with its mean over all rows, or over the rows of ``rci_by``.
    """
    marked = rebounds(faced(scored), max_gap, max_distance, compat).withColumn(
        "movement_demand", movement_demand(F.col("delta_angle"), F.col("time_since_last_event"))
    )
    saved, scored_on = F.col("is_goal") == 0, F.col("is_goal") == 1
    sums = (
        marked.groupBy(GOALIE, "season")
        .agg(
            F.count(F.lit(1)).alias("shots_faced"),
            F.sum("is_goal").cast("bigint").alias("actual_goals_allowed"),
            F.sum("xg_prob").alias("expected_goals"),
            (F.sum("xg_prob") - F.sum("is_goal")).alias("gsax_cumulative"),
            F.count_if(saved).alias("total_saves"),
            F.sum("generated_rebound").cast("bigint").alias("rebounds_generated"),
            F.sum("generated_rebound_xg").alias("total_rebound_xg_danger"),
            F.avg(F.when(saved, F.col("movement_demand"))).alias("avg_mda_saves"),
            F.avg(F.when(scored_on, F.col("movement_demand"))).alias("avg_mda_goals"),
        )
        .filter(F.col("shots_faced") > min_shots)
    )
    rate = safe_ratio(F.col("rebounds_generated"), F.col("total_saves"))
    rated = sums.withColumns(
        {
            "rebound_rate": rate.cast("float") if compat == "reference" else rate,
            "rebound_danger": safe_ratio(F.col("total_rebound_xg_danger"), F.col("rebounds_generated")),
            "mda": F.coalesce("avg_mda_saves", F.lit(0.0)) - F.coalesce("avg_mda_goals", F.lit(0.0)),
        }
    ).withColumn("rr_x_rd", F.col("rebound_rate").cast("double") * F.coalesce("rebound_danger", F.lit(0.0)))
    base = settle(rated)
    if rci_by:
        league = base.df.groupBy(*rci_by).agg(F.avg("rr_x_rd").alias("__league"))
        full = join_dim(base.df, league, rci_by)
    else:
        full = base.df.withColumn("__league", one_row(base.df, m=F.avg("rr_x_rd")).getField("m"))
    return full.withColumn("rci", 1.0 - F.try_divide("rr_x_rd", "__league")).drop("__league")


def goalie_team_season(scored: DataFrame, min_games: int = 10) -> DataFrame:
    """One row per goalie, team and season with at least ``min_games`` games."""
    return (
        with_team(faced(scored))
        .groupBy(F.col(GOALIE).alias("goalie_id"), "team_id", "season")
        .agg(
            F.count(F.lit(1)).alias("shots_faced"),
            F.count_distinct("game_id").alias("games_played"),
            (F.sum("xg_prob") - F.sum("is_goal")).alias("raw_gsax_2_0"),
        )
        .filter(F.col("games_played") >= min_games)
    )


def goalie_game_obs(scored: DataFrame, min_shots: int = 5) -> DataFrame:
    """One row per goalie, team, season and game with more than ``min_shots`` shots."""
    return (
        with_team(faced(scored))
        .groupBy(F.col(GOALIE).alias("goalie_id"), "team_id", "season", "game_id")
        .agg(
            F.count(F.lit(1)).alias("shots_faced"),
            ((F.sum("xg_prob") - F.sum("is_goal")) / F.count(F.lit(1))).alias("gsax_per_shot"),
            F.avg("traffic_density").alias("avg_traffic"),
            F.avg("puck_speed").alias("avg_speed"),
        )
        .filter(F.col("shots_faced") > min_shots)
    )


def semi_min_rows(df: DataFrame, key: str, min_rows: int) -> DataFrame:
    """Rows of keys that have at least ``min_rows`` rows."""
    keys = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_rows).select(key)
    return join_dim(df, keys, [key], "left_semi")


def zscore(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Standardised columns ``{new: column}`` over all rows (sample deviation)."""
    aggs = {}
    for new, c in cols.items():
        aggs[f"m_{new}"], aggs[f"s_{new}"] = F.avg(c), F.stddev_samp(c)
    stats = df.withColumn("__s", one_row(df, **aggs))
    return stats.withColumns(
        {new: F.try_divide(F.col(c) - F.col(f"__s.m_{new}"), F.col(f"__s.s_{new}")) for new, c in cols.items()}
    ).drop("__s")


def group_size_stats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, least and greatest number of rows per key."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_groups"), F.avg("n").alias("mean_n"), F.min("n").alias("min_n"), F.max("n").alias("max_n")
    )


def season_rates(scored: DataFrame, n: int = 5) -> DataFrame:
    """Totals and rates of the latest ``n`` seasons."""
    sums = scored.groupBy("season").agg(
        F.count(F.lit(1)).alias("shots"),
        F.sum("is_goal").cast("bigint").alias("total_goals"),
        F.sum("xg_prob").alias("total_xg"),
    )
    rates = sums.withColumns(
        {
            "avg_goal_rate": F.col("total_goals") / F.col("shots"),
            "avg_xg_prob": F.col("total_xg") / F.col("shots"),
        }
    )
    return rates.orderBy(F.desc_nulls_last("season")).limit(n)


def zone_save_pct(scored: DataFrame, near: float = 30.0, wide: float = 45.0) -> DataFrame:
    """Save percentage by shot origin: low slot, high slot, sides and far shots."""
    distance, angle = F.col("shot_distance"), F.abs("shot_angle")
    zone = (
        F.when((distance <= near) & (angle <= wide), "low_slot")
        .when((distance <= 2 * near) & (angle <= wide), "high_slot")
        .when(distance <= 2 * near, "side")
        .otherwise("far")
    )
    sums = scored.groupBy(F.col(GOALIE).alias("goalie_id"), zone.alias("zone")).agg(*gsax_aggs())
    return sums.withColumn("sv_pct", save_pct())
