"""The tables a front end reads."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinkflow.functions.details import defending_abbrev
from rinkflow.functions.numeric import SHOTS_PER_SEASON, trend_label
from rinkflow.operators.ranks import pct_rank
from rinkflow.operators.sizing import join_dim, one_row, settle
from rinkflow.operators.topk import latest_per_key, recent_rows, sort_by
from rinkflow.plans.metrics import GOALIE, gsax_aggs, save_pct, with_team
from rinkflow.plans.scoring import calibrate


def union_distinct(df: DataFrame, left: str, right: str, new: str) -> DataFrame:
    """Distinct non-null values of two columns, each made distinct before the union."""
    parts = df.select(F.col(left).alias(new)).distinct().union(df.select(F.col(right).alias(new)).distinct())
    return parts.filter(F.col(new).isNotNull()).distinct()


def filter_values(scored: DataFrame) -> DataFrame:
    """Seasons (latest first) and team names for the filter lists."""
    seasons = scored.select("season").distinct().select(
        F.lit("season").alias("kind"), F.col("season").cast("string").alias("value"), (-F.col("season")).cast("string").alias("__o")
    )
    teams = union_distinct(scored, "home_team_abbrev", "away_team_abbrev", "value").select(
        F.lit("team").alias("kind"), "value", F.col("value").alias("__o")
    )
    return seasons.unionByName(teams).orderBy("kind", "__o").drop("__o")


def shot_filter(season: int | None = None, team: str | None = None) -> Column:
    """Conditions of the filters in use; none means all rows. ``team`` is the goalie's team."""
    conditions = [F.lit(True)]
    if season is not None:
        conditions.append(F.col("season") == season)
    if team is not None:
        side = defending_abbrev(
            F.col("event_owner_team_id"),
            F.col("home_team_id"),
            F.col("away_team_id"),
            F.col("home_team_abbrev"),
            F.col("away_team_abbrev"),
        )
        conditions.append(side == team)
    return reduce(and_, conditions)


def attach_names(df: DataFrame, names: DataFrame, key: str = "goalie_id", new: str = "goalie_name") -> DataFrame:
    """Add the name, or the id as text."""
    dim = names.select(F.col("goalie_id").alias(key), F.col("goalie_name").alias("__name"))
    return join_dim(df, dim, [key]).withColumn(new, F.coalesce("__name", F.col(key).cast("string"))).drop("__name")


def talent_columns(df: DataFrame) -> list[str]:
    """Columns that hold a talent per shot, found by name."""
    return [c for c in df.columns if "talent" in c.lower() and "per_shot" in c.lower()]


def shot_averages() -> list[Column]:
    return [
        F.avg("traffic_density").alias("avg_traffic"),
        F.avg("puck_speed").alias("avg_speed"),
        F.avg(F.abs("delta_angle")).alias("avg_movement"),
    ]


def leaderboard(
    scored: DataFrame,
    names: DataFrame,
    talent: DataFrame | None = None,
    base: DataFrame | None = None,
    season: int | None = None,
    team: str | None = None,
    min_shots: int = 200,
    sort: tuple[str, str] = ("gsax", "desc"),
) -> DataFrame:
    """Goalies with enough shots, their rates, names, talent, rebound control and percentiles within the filter."""
    board = (
        scored.filter(shot_filter(season, team))
        .groupBy(F.col(GOALIE).alias("goalie_id"))
        .agg(*gsax_aggs(), *shot_averages())
        .filter(F.col("shots") >= min_shots)
        .withColumn("sv_pct", save_pct())
    )
    board = attach_names(board, names)
    ranked = {"gsax_pct": "gsax", "traffic_pct": "avg_traffic", "speed_pct": "avg_speed", "movement_pct": "avg_movement"}
    if talent is not None and talent_columns(talent):
        dim = talent.select("goalie_id", F.col(talent_columns(talent)[0]).alias("isolated_talent"))
        board = join_dim(board, dim, ["goalie_id"])
    if base is not None:
        by_goalie = base.withColumnRenamed(GOALIE, "goalie_id")
        if season is not None:
            rci = by_goalie.filter(F.col("season") == season).select("goalie_id", "rci")
        else:
            rci = latest_per_key(by_goalie, "goalie_id", "season", ["rci"]).select("goalie_id", "rci")
        board = join_dim(board, rci, ["goalie_id"])
        ranked["rci_pct"] = "rci"
    return sort_by(pct_rank(board, ranked), *sort)


def career(scored: DataFrame, by: tuple[str, ...] = ("goalie_id", "season")) -> DataFrame:
    """Totals and averages per goalie and season."""
    return (
        scored.withColumn("goalie_id", F.col(GOALIE))
        .groupBy(*by)
        .agg(*gsax_aggs(), F.avg("traffic_density").alias("avg_traffic"), F.avg("puck_speed").alias("avg_speed"))
        .withColumn("sv_pct", save_pct())
    )


RECENT = ("adjusted_x", "adjusted_y", "xg_prob", "is_goal", "traffic_density", "puck_speed", "shot_type", "shot_distance")


def recent_shots(scored: DataFrame, n: int = 500, goalie_id: int | None = None) -> DataFrame:
    """The last ``n`` shots of one goalie, or of every goalie."""
    rows = scored.filter(F.col(GOALIE) == goalie_id) if goalie_id is not None else scored.filter(F.col(GOALIE).isNotNull())
    return recent_rows(rows, [GOALIE], ["game_id", "event_id"], n).select(
        F.col(GOALIE).alias("goalie_id"), "recency", "game_id", "event_id", *RECENT
    )


def goalie_detail(
    scored: DataFrame,
    names: DataFrame,
    proj: DataFrame,
    base: DataFrame,
    goalie_id: int | None = None,
    n_recent: int = 500,
) -> DataFrame:
    """One nested record per goalie: seasons, last shots, base metrics and projection.

    Every list is bounded: by the number of seasons, or by ``n_recent``.
    """

    def only(df: DataFrame, key: str = "goalie_id") -> DataFrame:
        return df if goalie_id is None else df.filter(F.col(key) == goalie_id)

    def listed(df: DataFrame, order: str, new: str) -> DataFrame:
        rest = [c for c in df.columns if c not in ("goalie_id", order)]
        return df.groupBy("goalie_id").agg(F.array_sort(F.collect_list(F.struct(order, *rest))).alias(new))

    shots = only(scored.filter(F.col(GOALIE).isNotNull()), GOALIE)
    seasons = listed(career(shots), "season", "career")
    recent = listed(recent_shots(shots, n_recent), "recency", "recent_shots")
    metrics = listed(only(base.withColumnRenamed(GOALIE, "goalie_id")), "season", "base_metrics")
    one = only(proj).select("goalie_id", F.struct(*[c for c in proj.columns if c != "goalie_id"]).alias("projection"))
    x = attach_names(seasons, names, new="name").join(recent, "goalie_id", "left")
    return join_dim(join_dim(x, metrics, ["goalie_id"]), one, ["goalie_id"])


def projections_active(
    proj: DataFrame, scored: DataFrame, names: DataFrame, min_shots: int = 0, compat: str = "fixed"
) -> DataFrame:
    """Projections of goalies with a shot in the last season; ``min_shots`` applies to career shots."""
    latest = one_row(scored, s=F.max("season")).getField("s")
    totals = (
        scored.filter(F.col(GOALIE).isNotNull())
        .groupBy(F.col(GOALIE).alias("goalie_id"))
        .agg(F.count(F.lit(1)).alias("career_shots"), F.max("season").alias("__last"))
        .filter(F.col("__last") == latest)
        .drop("__last")
    )
    x = proj.join(totals, "goalie_id")
    x = x.drop("career_shots") if compat == "reference" else x.filter(F.col("career_shots") >= min_shots)
    return attach_names(x, names)


def team_defense(effects: DataFrame, scored: DataFrame, season: int | None = None) -> DataFrame:
    """Team effects with the team's name, least first."""
    rows = effects if season is None else effects.filter(F.col("season") == season)
    teams = (
        scored.filter(F.col("home_team_abbrev").isNotNull())
        .select(F.col("home_team_id").alias("team_id"), F.col("home_team_abbrev").alias("team_name"))
        .distinct()
    )
    return (
        join_dim(rows, teams, ["team_id"])
        .withColumn("team_name", F.coalesce("team_name", F.col("team_id").cast("string")))
        .orderBy(F.asc_nulls_last("dsis_team_defense_impact_per_shot"))
    )


def head_to_head(scored: DataFrame, names: DataFrame, ids: DataFrame, season: int | None = None) -> DataFrame:
    """The same figures for every asked goalie, also for one without shots."""
    asked = settle(ids.select("goalie_id").distinct())
    rows = scored.filter(shot_filter(season)).withColumn("goalie_id", F.col(GOALIE))
    sums = join_dim(rows, asked, ["goalie_id"], "left_semi").groupBy("goalie_id").agg(*gsax_aggs(), *shot_averages())
    x = join_dim(asked.df, sums, ["goalie_id"]).fillna({"shots": 0}).withColumn("sv_pct", save_pct())
    return attach_names(x, names)


CARD_COLUMNS = ("gsax_2_0", "dsis_true_talent_gsax_per_shot", "avg_traffic", "avg_speed", "avg_movement", "rci")


def card_stats(
    scored: DataFrame,
    dsis: DataFrame,
    proj: DataFrame,
    base: DataFrame,
    names: DataFrame,
    season: int | None,
    min_shots: int = 200,
) -> DataFrame:
    """One season's goalies, or all of them with their latest rebound control, with talent, projection, rebound control, percentiles and trend."""
    stats = (
        scored.filter(shot_filter(season))
        .groupBy(F.col(GOALIE).alias("goalie_id"))
        .agg(*gsax_aggs(), *shot_averages())
        .withColumnRenamed("gsax", "gsax_2_0")
        .filter(F.col("shots") >= min_shots)
    )
    x = join_dim(stats, dsis.select("goalie_id", "dsis_true_talent_gsax_per_shot"), ["goalie_id"])
    x = join_dim(x, proj.select("goalie_id", "proj_1yr_talent_per_shot"), ["goalie_id"])
    rated = base.withColumnRenamed(GOALIE, "goalie_id")
    of_season = latest_per_key(rated, "goalie_id", "season", ["rci"]) if season is None else rated.filter(F.col("season") == season)
    x = join_dim(x, of_season.select("goalie_id", "rci"), ["goalie_id"])
    x = attach_names(x, names, new="Goalie")
    ranked = pct_rank(x, {f"{c}_percentile": c for c in CARD_COLUMNS})
    return ranked.withColumn(
        "trend", trend_label(F.col("dsis_true_talent_gsax_per_shot"), F.col("proj_1yr_talent_per_shot"))
    )


def calibrated_gsax(scored: DataFrame, goalies: list[int] | None = None, season: int | None = None) -> DataFrame:
    """Goals saved above calibrated expectation per goalie and team, best first."""
    rows = with_team(calibrate(scored)).filter(F.col("is_empty_net") == 0).filter(shot_filter(season))
    if goalies is not None:
        rows = rows.filter(F.col(GOALIE).isin(goalies))
    return (
        rows.groupBy(F.col(GOALIE).alias("goalie_id"), "team_id")
        .agg(
            F.count(F.lit(1)).alias("shots_faced"),
            F.sum("xg_prob").alias("xG_against"),
            F.sum("is_goal").cast("bigint").alias("goals_against"),
            (F.sum("xg_prob") - F.sum("is_goal")).alias("gsax_2_0"),
        )
        .orderBy(F.desc_nulls_last("gsax_2_0"))
    )


def career_totals(scored: DataFrame, base: DataFrame, proj: DataFrame, season_shots: int = SHOTS_PER_SEASON) -> DataFrame:
    """Career totals, mean rebound control (a season without one counts as 0) and the projected season value."""
    seasons = career(scored.filter(F.col(GOALIE).isNotNull()))
    totals = seasons.groupBy("goalie_id").agg(
        F.sum("shots").alias("shots"), F.sum("goals").alias("goals"), F.sum("gsax").alias("gsax")
    )
    rci = base.groupBy(F.col(GOALIE).alias("goalie_id")).agg(F.avg(F.coalesce("rci", F.lit(0.0))).alias("avg_rci"))
    value = (F.col("proj_1yr_talent_per_shot") * season_shots).alias("projected_season_gsax")
    x = join_dim(totals.withColumn("sv_pct", save_pct()), rci, ["goalie_id"])
    return join_dim(x, proj.select("goalie_id", value), ["goalie_id"])


def shot_points(df: DataFrame) -> DataFrame:
    """Points of a shot map, marked as goal or save."""
    placed = df.filter(F.col("adjusted_x").isNotNull() & F.col("adjusted_y").isNotNull())
    return placed.withColumn("kind", F.when(F.col("is_goal") == 1, "goal").otherwise("save"))


def unified_metrics(base: DataFrame, dsis: DataFrame, proj: DataFrame) -> DataFrame:
    """Season metrics with the goalie's talent and projection."""
    x = base.withColumnRenamed(GOALIE, "goalie_id").select("goalie_id", "season", "shots_faced", "gsax_cumulative", "rci", "mda")
    x = join_dim(x, dsis.select("goalie_id", "dsis_true_talent_gsax_per_shot"), ["goalie_id"])
    return join_dim(x, proj.select("goalie_id", "proj_1yr_talent_per_shot"), ["goalie_id"])


def write_unified(metrics: DataFrame, path: str) -> None:
    """Unified metrics as Parquet and as CSV with a header, below ``path``."""
    metrics.write.mode("overwrite").parquet(f"{path}/parquet")
    metrics.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def missing_names(dim: DataFrame) -> DataFrame:
    """Rows whose name is only the id."""
    from rinkflow.functions.details import name_missing

    return dim.filter(name_missing(F.col("goalie_id"), F.col("goalie_name")))


def upsert(dim: DataFrame, updates: DataFrame, key: str, value: str) -> DataFrame:
    """New values where given, old ones elsewhere, and new keys added."""
    x = dim.withColumnRenamed(value, "__old").join(updates.select(key, F.col(value).alias("__new")), key, "full_outer")
    return x.withColumn(value, F.coalesce("__new", "__old")).drop("__new", "__old")
