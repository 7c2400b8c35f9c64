"""The shot feature table."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkflow.functions import clock, details, geometry
from rinkflow.operators.intervals import cover_counts
from rinkflow.operators.sequences import event_sequence, group_values, neighbours, range_counts, running
from rinkflow.operators.sizing import guard_rows
from rinkflow.operators.skew import Groups, measure_groups
from rinkflow.schemas import ON_GOAL_TYPES, SHOT_TYPES, TRAFFIC_TYPES
from rinkflow.sources.datasets import replace_table, write_dataset

GAME, PERIOD, EVENT, OWNER = "game_id", "period", "event_id", "event_owner_team_id"


@dataclass(frozen=True)
class Layout:
    """Group sizes of a play-by-play table: by game, and by the partition of neighbours and range frames."""

    game: Groups
    own: Groups
    period: Groups
    own_keys: tuple[str, ...]


def layout(pbp: DataFrame, compat: str = "fixed") -> Layout:
    """Measure once; with no hot game, no finer group can be hot either."""
    game = measure_groups(pbp, [GAME], EVENT)
    period = measure_groups(pbp, [GAME, PERIOD], EVENT) if game.hot else Groups((GAME, PERIOD), EVENT)
    own_keys = (GAME,) if compat == "reference" else (GAME, PERIOD)
    return Layout(game, game if compat == "reference" else period, period, own_keys)


def attacking_net(pbp: DataFrame, hot: bool = True) -> DataFrame:
    """``net_x`` per game, period and team: +89 where its shots average a positive x, else -89, null without shots or with a null key."""
    x = F.when(F.col("event_type").isin(*SHOT_TYPES), F.col("x_coord"))
    valued = group_values(pbp, [GAME, PERIOD, OWNER], {"__mean_x": F.avg(x)}, hot)
    mean = F.col("__mean_x")
    known = F.col(GAME).isNotNull() & F.col(PERIOD).isNotNull() & F.col(OWNER).isNotNull()
    net = F.when(known & (mean > 0), geometry.NET_X).when(known & mean.isNotNull(), -geometry.NET_X)
    return valued.withColumn("net_x", net).drop("__mean_x")


def event_context(
    pbp: DataFrame, compat: str = "fixed", shot_frame: tuple[int, int] = (-4, -1), traffic_frame: tuple[int, int] = (-10, -1)
) -> DataFrame:
    """Every event with its net, previous events, stoppage time, running score and range counts.

    One exchange by game serves all windows when no game is hot.
    """
    plan = layout(pbp, compat)
    timed = pbp.withColumn("time_seconds", clock.clock_seconds(F.col("time_in_period")))
    base = timed if plan.game.hot else timed.repartition(GAME)
    own = list(plan.own_keys)
    x = attacking_net(base, plan.game.hot)
    x = neighbours(
        x,
        own,
        EVENT,
        {
            "prev_event_type": ("event_type", 1),
            "__prev2_event_type": ("event_type", 2),
            "prev_x": ("x_coord", 1),
            "prev_y": ("y_coord", 1),
            "prev_time_seconds": ("time_seconds", 1),
        },
        plan.own,
    )
    x = x.withColumn("sequence_2_events", event_sequence(F.col("__prev2_event_type"), F.col("prev_event_type"))).drop(
        "__prev2_event_type"
    )
    faceoff = F.when(F.col("event_type") == "faceoff", F.col("time_seconds"))
    x = running(x, [GAME, PERIOD], EVENT, {"last_stoppage_time": (faceoff, "max", True)}, 0, plan.period)
    goal = F.col("event_type") == "goal"
    x = running(
        x,
        [GAME],
        EVENT,
        {
            "home_goals": (F.when(goal & (F.col(OWNER) == F.col("home_team_id")), 1).otherwise(0), "sum", False),
            "away_goals": (F.when(goal & (F.col(OWNER) == F.col("away_team_id")), 1).otherwise(0), "sum", False),
        },
        0,
        plan.game,
    )
    near = geometry.same_sign(F.col("x_coord"), F.col("net_x")) & F.col("event_type").isin(*TRAFFIC_TYPES)
    return range_counts(
        x,
        own,
        "time_seconds",
        {
            "shot_sequence_num": (F.col("event_type").isin(*ON_GOAL_TYPES), *shot_frame),
            "traffic_density": (near, *traffic_frame),
        },
        plan.own,
    )


def shots_only(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type").isin(*ON_GOAL_TYPES) & F.col("x_coord").isNotNull())


def shift_seconds(shifts: DataFrame) -> DataFrame:
    return shifts.select(
        "game_id",
        "period",
        "team_id",
        "player_id",
        "type_code",
        clock.clock_seconds(F.col("start_time")).alias("start_sec"),
        clock.clock_seconds(F.col("end_time")).alias("end_sec"),
    )


def skater_shifts(
    shifts: DataFrame, goalies: DataFrame | None = None, compat: str = "fixed", type_code: int | None = None
) -> DataFrame:
    """Shifts that count for strength: without known goalies, unless ``compat="reference"`` counts all."""
    if compat == "reference":
        return shifts
    kept = shifts if type_code is None else shifts.filter(F.col("type_code") == type_code)
    return kept if goalies is None else kept.join(goalies.select("player_id").distinct(), "player_id", "left_anti")


def strength_counts(
    shots: DataFrame, shifts: DataFrame, goalies: DataFrame | None = None, compat: str = "fixed"
) -> DataFrame:
    """Skaters of both teams on the ice at every shot."""
    keys = [GAME, PERIOD, EVENT]
    points = shots.select(*keys, "time_seconds", "home_team_id", "away_team_id")
    live = skater_shifts(shift_seconds(shifts), goalies, compat)
    counted = cover_counts(
        points,
        live,
        keys,
        [GAME, PERIOD],
        "time_seconds",
        "start_sec",
        "end_sec",
        {"home_skaters": "home_team_id", "away_skaters": "away_team_id"},
        "team_id",
    )
    if compat == "reference":
        return counted.groupBy(EVENT).agg(*[F.sum(c).alias(c) for c in ("home_skaters", "away_skaters")])
    return counted


def fill_defaults(df: DataFrame) -> DataFrame:
    """Defaults of the model's inputs."""
    return df.fillna(
        {
            "net_x": geometry.NET_X,
            "prev_x": float(geometry.NET_X),
            "prev_y": 0.0,
            "prev_event_type": "None",
            "sequence_2_events": "None",
        }
    )


def shot_geometry(shots: DataFrame, compat: str = "fixed") -> DataFrame:
    """Positions seen from the attacking side, distances, angles and what lies between two events."""
    net = F.col("net_x")
    placed = shots.withColumns(
        {
            "adjusted_x": geometry.mirror(F.col("x_coord"), net),
            "adjusted_y": geometry.mirror(F.col("y_coord"), net),
            "prev_adjusted_x": geometry.mirror(F.col("prev_x"), net),
            "prev_adjusted_y": geometry.mirror(F.col("prev_y"), net),
        }
    )
    measured = placed.withColumns(
        {
            "shot_distance": geometry.net_distance(F.col("adjusted_x"), F.col("adjusted_y")),
            "shot_angle": geometry.net_angle(F.col("adjusted_x"), F.col("adjusted_y"), net, compat),
            "prev_distance": geometry.net_distance(F.col("prev_adjusted_x"), F.col("prev_adjusted_y")),
            "prev_angle": geometry.net_angle(F.col("prev_adjusted_x"), F.col("prev_adjusted_y"), net, compat),
            "distance_from_prev": geometry.travel(F.col("x_coord"), F.col("y_coord"), F.col("prev_x"), F.col("prev_y")),
        }
    )
    return measured.withColumn("delta_angle", geometry.delta_angle(F.col("shot_angle"), F.col("prev_angle")))


def drop_empty_net(df: DataFrame) -> DataFrame:
    return df.filter((F.col("is_empty_net") == 0) & F.col("goalie_in_net_id").isNotNull())


def shot_features(
    pbp: DataFrame,
    shifts: DataFrame | None = None,
    goalies: DataFrame | None = None,
    compat: str = "fixed",
    shot_frame: tuple[int, int] = (-4, -1),
    traffic_frame: tuple[int, int] = (-10, -1),
) -> DataFrame:
    """One row per shot on goal against a goalie with all model features; without shifts the strength is unknown."""
    shots = shots_only(event_context(pbp, compat, shot_frame, traffic_frame))
    if shifts is None:
        none = F.lit(None).cast("bigint")
        joined = shots.withColumns({"home_skaters": none, "away_skaters": none})
    else:
        points = shots_only(pbp).withColumn("time_seconds", clock.clock_seconds(F.col("time_in_period")))
        counts = strength_counts(points, shifts, goalies, compat)
        joined = shots.join(counts, [EVENT] if compat == "reference" else [GAME, PERIOD, EVENT], "left")
    now = F.col("time_seconds")
    timed = fill_defaults(joined).withColumns(
        {
            "time_since_last_event": clock.elapsed(now, F.col("prev_time_seconds")),
            "time_since_last_stoppage": clock.elapsed(now, F.col("last_stoppage_time")),
        }
    )
    placed = shot_geometry(timed, compat)
    gap = F.col("time_since_last_event")
    full = placed.withColumns(
        {
            "puck_speed": geometry.puck_speed(F.col("distance_from_prev"), gap),
            "score_differential": details.score_diff(
                F.col(OWNER), F.col("home_team_id"), F.col("home_goals"), F.col("away_goals")
            ),
            "strength_state": details.strength_state(
                F.col(OWNER), F.col("away_team_id"), F.col("home_skaters"), F.col("away_skaters")
            ),
            "royal_road_cross": geometry.royal_road(gap, F.col("y_coord"), F.col("prev_y"), F.col("prev_x"), F.col("net_x")),
            "is_empty_net": details.json_absent_flag(F.col("details_json"), "goalieInNetId"),
            "shot_type": details.json_coalesce(F.col("shot_type"), F.col("details_json"), "shotType", "unknown"),
            "is_goal": details.is_goal(F.col("event_type")),
        }
    )
    return drop_empty_net(full)


# Inputs of the context model and those that are categories.
MODEL_FEATURES = (
    "adjusted_x",
    "adjusted_y",
    "shot_distance",
    "shot_angle",
    "shot_type",
    "time_since_last_event",
    "prev_event_type",
    "sequence_2_events",
    "shot_sequence_num",
    "traffic_density",
    "royal_road_cross",
    "time_since_last_stoppage",
    "strength_state",
    "score_differential",
    "puck_speed",
    "delta_angle",
)
CATEGORY_FEATURES = ("shot_type", "prev_event_type", "sequence_2_events", "strength_state")


def write_features(features: DataFrame, path: str, by: tuple[str, ...] = ("season",)) -> bool:
    """Write the shots with their context; without any shot nothing is written and an older version stays."""
    if not guard_rows(features, 1):
        warnings.warn("no shots: features not written", stacklevel=2)
        return False
    return write_dataset(features, path, by)


def load_features(spark: SparkSession, features: DataFrame, name: str = "xg_features") -> DataFrame:
    """Create the table of features in the catalog, or replace its rows and columns, and read it."""
    replace_table(features, name)
    return spark.table(name)
