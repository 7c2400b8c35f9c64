"""Queries over play-by-play context and shot features."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinkflow.functions import clock, details, geometry
from rinkflow.operators.intervals import interval_join
from rinkflow.operators.sequences import neighbours, range_counts, running
from rinkflow.plans import features as P
from rinkflow.registry.core import register
from rinkflow.registry.sql import using
from rinkflow.schemas import ON_GOAL_TYPES, SHOT_TYPES
from rinkflow.sources import roles
from rinkflow.sources.datasets import rewrite_dataset

# The test events are sparse, so frames are an hour and two hours wide.
FRAMES = {"shot_frame": (-3600, -1), "traffic_frame": (-7200, -1)}
ID = ["game_id", "period", "event_id"]


def features(spark, path, compat="fixed", with_shifts=True):
    shifts = roles.shifts(spark, path) if with_shifts else None
    goalies = roles.goalies(spark, path) if with_shifts else None
    return P.shot_features(roles.pbp(spark, path), shifts, goalies, compat, **FRAMES)


def context(spark, path, compat="fixed"):
    return P.event_context(roles.pbp(spark, path), compat, **FRAMES)


def scored(spark, path, with_shifts=False):
    """Features with a fixed stand-in for the model's probability."""
    return features(spark, path, with_shifts=with_shifts).withColumn(
        "xg_prob", 1.0 / (1.0 + F.exp(0.04 * F.col("shot_distance") - 1.0))
    )


# What the metrics and front-end tables read from the scored shots.
SHOT_COLUMNS = (
    "game_id, season, period, event_id, event_type, time_seconds, home_team_id, away_team_id, home_team_abbrev, "
    "away_team_abbrev, event_owner_team_id, goalie_in_net_id, adjusted_x, adjusted_y, shot_distance, shot_angle, shot_type, "
    "time_since_last_event, delta_angle, puck_speed, traffic_density, is_empty_net, is_goal, xg_prob"
).split(", ")


def stored(spark, path):
    """Scored shots as a table in the shared folder, for queries that read them several times."""
    return rewrite_dataset(scored(spark, path).select(*SHOT_COLUMNS), "scored_shots")


@register("filter_in_list", using("pbp") + "SELECT game_id, event_id, event_type FROM pbp WHERE event_type IN ('shot-on-goal', 'goal', 'missed-shot')")
def filter_in_list(spark, path):
    return roles.pbp(spark, path).filter(F.col("event_type").isin(*SHOT_TYPES)).select("game_id", "event_id", "event_type")


@register("shots_only", using("pbp") + "SELECT game_id, event_id, x_coord FROM pbp WHERE event_type IN ('shot-on-goal', 'goal') AND x_coord IS NOT NULL")
def shots_only(spark, path):
    return P.shots_only(roles.pbp(spark, path)).select("game_id", "event_id", "x_coord")


@register("filter_nonempty", using("pbp") + "SELECT venue, count(*) AS n_events FROM pbp WHERE venue IS NOT NULL AND venue != '' GROUP BY venue")
def filter_nonempty(spark, path):
    kept = roles.pbp(spark, path).filter(F.col("venue").isNotNull() & (F.col("venue") != ""))
    return kept.groupBy("venue").agg(F.count(F.lit(1)).alias("n_events"))


@register("defending_team", using("pbp") + "SELECT event_id, CASE WHEN event_owner_team_id = home_team_id THEN away_team_id ELSE home_team_id END AS team_id FROM pbp")
def defending_team(spark, path):
    side = details.defending_team(F.col("event_owner_team_id"), F.col("home_team_id"), F.col("away_team_id"))
    return roles.pbp(spark, path).select("event_id", side.alias("team_id"))


@register("drop_empty_net", using("pbp") + """
SELECT event_id, goalie_in_net_id FROM pbp WHERE goalie_in_net_id IS NOT NULL
  AND CASE WHEN json_valid(details_json) THEN json_extract_string(details_json, '$.goalieInNetId') IS NOT NULL ELSE true END""")
def drop_empty_net(spark, path):
    flagged = roles.pbp(spark, path).withColumn(
        "is_empty_net", details.json_absent_flag(F.col("details_json"), "goalieInNetId")
    )
    return P.drop_empty_net(flagged).select("event_id", "goalie_in_net_id")


@register("attacking_net", using("pbp", "nets") + """
SELECT event_id, CAST(net_x AS INT) AS net_x FROM pbp LEFT JOIN nets USING (game_id, period, event_owner_team_id)""")
def attacking_net(spark, path):
    return P.attacking_net(roles.pbp(spark, path)).select("event_id", F.col("net_x").cast("int").alias("net_x"))


@register("interval_join", using("pbp", "shifts") + """
SELECT p.game_id, p.period, p.event_id, s.player_id, s.start_sec, s.end_sec
FROM pbp p LEFT JOIN shifts s ON p.game_id = s.game_id AND p.period = s.period
  AND p.time_seconds >= s.start_sec AND p.time_seconds < s.end_sec
WHERE p.event_type IN ('shot-on-goal', 'goal') AND p.x_coord IS NOT NULL""")
def interval_pairs(spark, path):
    points = P.shots_only(roles.pbp(spark, path)).select(*ID, "time_seconds")
    live = P.shift_seconds(roles.shifts(spark, path)).select("game_id", "period", "player_id", "start_sec", "end_sec")
    return interval_join(points, live, ["game_id", "period"], "time_seconds", "start_sec", "end_sec").drop("time_seconds")


@register("strength_counts", using("strength") + "SELECT * FROM strength")
def strength_counts(spark, path):
    return P.strength_counts(P.shots_only(roles.pbp(spark, path)), roles.shifts(spark, path), roles.goalies(spark, path))


@register("strength_state", using("feats") + "SELECT game_id, event_id, strength_state FROM feats")
def strength_state(spark, path):
    return features(spark, path).select("game_id", "event_id", "strength_state")


@register("strength_state_ref", using("feats_ref") + "SELECT game_id, event_id, strength_state FROM feats_ref")
def strength_state_ref(spark, path):
    return features(spark, path, "reference").select("game_id", "event_id", "strength_state")


@register("lag_context", using("context") + "SELECT event_id, prev_event_type, prev_x, prev_y, prev_time_seconds FROM context", "prev_x prev_y")
def lag_context(spark, path):
    cols = {"prev_event_type": "event_type", "prev_x": "x_coord", "prev_y": "y_coord", "prev_time_seconds": "time_seconds"}
    out = neighbours(roles.pbp(spark, path), ["game_id", "period"], "event_id", {n: (c, 1) for n, c in cols.items()})
    return out.select("event_id", *cols)


@register("sequence_2", using("context") + "SELECT sequence_2_events, count(*) AS n FROM context GROUP BY 1")
def sequence_2(spark, path):
    return context(spark, path).groupBy("sequence_2_events").agg(F.count(F.lit(1)).alias("n"))


@register("time_since_stoppage", using("context") + "SELECT event_id, time_seconds - last_stoppage_time AS since_stoppage FROM context")
def time_since_stoppage(spark, path):
    faceoff = F.when(F.col("event_type") == "faceoff", F.col("time_seconds"))
    out = running(roles.pbp(spark, path), ["game_id", "period"], "event_id", {"last": (faceoff, "max", True)})
    return out.select("event_id", (F.col("time_seconds") - F.col("last")).alias("since_stoppage"))


@register("running_score", using("context") + "SELECT event_id, home_goals, away_goals FROM context")
def running_score(spark, path):
    return context(spark, path).select("event_id", "home_goals", "away_goals")


@register("range_count", using("context") + "SELECT event_id, shot_sequence_num FROM context")
def range_count(spark, path):
    flag = F.col("event_type").isin(*ON_GOAL_TYPES)
    out = range_counts(
        roles.pbp(spark, path), ["game_id", "period"], "time_seconds", {"shot_sequence_num": (flag, -3600, -1)}
    )
    return out.select("event_id", "shot_sequence_num")


@register("range_count_ref", using("context_ref") + "SELECT event_id, shot_sequence_num FROM context_ref")
def range_count_ref(spark, path):
    flag = F.col("event_type").isin(*ON_GOAL_TYPES)
    out = range_counts(roles.pbp(spark, path), ["game_id"], "time_seconds", {"shot_sequence_num": (flag, -3600, -1)})
    return out.select("event_id", "shot_sequence_num")


@register("traffic_density", using("context") + "SELECT event_id, traffic_density FROM context")
def traffic_density(spark, path):
    return context(spark, path).select("event_id", "traffic_density")


@register("clock_seconds", using("pbp_plain") + "SELECT event_id, time_in_period, time_seconds FROM pbp_plain")
def clock_seconds(spark, path):
    c = F.col("time_in_period")
    return roles.pbp(spark, path, pad=False).select("event_id", c, clock.clock_seconds(c).alias("time_seconds"))


@register("clock_regex", using("pbp_plain") + """
SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 != 0 THEN time_seconds END AS seconds FROM pbp_plain""")
def clock_regex(spark, path):
    eid, c = F.col("event_id"), F.col("time_in_period")
    broken = F.when(eid % 11 == 0, "invalid").when(eid % 7 == 0, F.concat(c, F.lit("7"))).otherwise(F.concat(F.lit(" "), c))
    return roles.pbp(spark, path, pad=False).select("event_id", clock.clock_regex(broken).alias("seconds"))


@register("royal_road", using("feats") + "SELECT game_id, royal_road_cross, count(*) AS n FROM feats GROUP BY 1, 2")
def royal_road(spark, path):
    return features(spark, path, with_shifts=False).groupBy("game_id", "royal_road_cross").agg(F.count(F.lit(1)).alias("n"))


@register(
    "shot_geometry",
    using("feats") + "SELECT event_id, adjusted_x, adjusted_y, shot_distance, shot_angle FROM feats",
    "adjusted_x adjusted_y shot_distance shot_angle",
)
def shot_geometry(spark, path):
    return features(spark, path, with_shifts=False).select(
        "event_id", "adjusted_x", "adjusted_y", "shot_distance", "shot_angle"
    )


@register("delta_angle", using("feats") + "SELECT event_id, delta_angle FROM feats", "delta_angle")
def delta_angle(spark, path):
    return features(spark, path, with_shifts=False).select("event_id", "delta_angle")


@register("puck_speed", using("feats") + "SELECT event_id, distance_from_prev, puck_speed FROM feats", "distance_from_prev puck_speed")
def puck_speed(spark, path):
    return features(spark, path, with_shifts=False).select("event_id", "distance_from_prev", "puck_speed")


@register("elapsed_times", using("feats") + "SELECT event_id, time_since_last_event, time_since_last_stoppage FROM feats")
def elapsed_times(spark, path):
    return features(spark, path, with_shifts=False).select("event_id", "time_since_last_event", "time_since_last_stoppage")


@register("score_diff", using("feats") + "SELECT event_id, score_differential FROM feats")
def score_diff(spark, path):
    return features(spark, path, with_shifts=False).select("event_id", "score_differential")


@register("fill_defaults", using("context") + """
SELECT event_id, CAST(coalesce(net_x, 89) AS INT) AS net_x, coalesce(prev_x, 89.0) AS prev_x, coalesce(prev_y, 0.0) AS prev_y,
  coalesce(prev_event_type, 'None') AS prev_event_type, coalesce(sequence_2_events, 'None') AS sequence_2_events FROM context""", "prev_x prev_y")
def fill_defaults(spark, path):
    return P.fill_defaults(context(spark, path)).select(
        "event_id", F.col("net_x").cast("int").alias("net_x"), "prev_x", "prev_y", "prev_event_type", "sequence_2_events"
    )


@register("json_flag", using("pbp") + """
SELECT event_id, CASE WHEN json_valid(details_json) THEN CAST(json_extract_string(details_json, '$.goalieInNetId') IS NULL AS INT)
  ELSE 0 END AS is_empty_net FROM pbp""")
def json_flag(spark, path):
    return roles.pbp(spark, path).select(
        "event_id", details.json_absent_flag(F.col("details_json"), "goalieInNetId").alias("is_empty_net")
    )


@register("json_coalesce", using("pbp") + """
SELECT event_id, coalesce(shot_type, CASE WHEN json_valid(details_json)
  THEN json_extract_string(details_json, '$.shotType') END, 'unknown') AS shot_type FROM pbp""")
def json_coalesce(spark, path):
    value = details.json_coalesce(F.col("shot_type"), F.col("details_json"), "shotType", "unknown")
    return roles.pbp(spark, path).select("event_id", value.alias("shot_type"))


@register("is_goal", using("pbp") + "SELECT event_id, CAST(event_type = 'goal' AS INT) AS is_goal FROM pbp")
def is_goal(spark, path):
    return roles.pbp(spark, path).select("event_id", details.is_goal(F.col("event_type")).alias("is_goal"))


@register("shot_points", using("scored") + """
SELECT event_id, adjusted_x, adjusted_y, CASE WHEN is_goal = 1 THEN 'goal' ELSE 'save' END AS kind
FROM scored WHERE adjusted_x IS NOT NULL AND adjusted_y IS NOT NULL""", "adjusted_x adjusted_y")
def shot_points(spark, path):
    from rinkflow.plans.serving import shot_points as points

    return points(scored(spark, path)).select("event_id", "adjusted_x", "adjusted_y", "kind")


_FEATURE_COLUMNS = (
    "game_id, season, event_id, period, net_x, time_seconds, prev_event_type, sequence_2_events, home_goals, away_goals, "
    "shot_sequence_num, traffic_density, home_skaters, away_skaters, adjusted_x, adjusted_y, shot_distance, shot_angle, "
    "time_since_last_event, time_since_last_stoppage, delta_angle, distance_from_prev, puck_speed, score_differential, "
    "strength_state, royal_road_cross, is_empty_net, shot_type, is_goal, goalie_in_net_id"
)
_FEATURE_DOUBLES = "adjusted_x adjusted_y shot_distance shot_angle delta_angle distance_from_prev puck_speed"


@register("shot_features", using("feats") + f"SELECT {_FEATURE_COLUMNS} FROM feats", _FEATURE_DOUBLES)
def shot_features(spark, path):
    out = features(spark, path)
    return out.withColumn("net_x", F.col("net_x").cast("int")).select(*_FEATURE_COLUMNS.split(", "))


@register("shot_features_ref", using("feats_ref") + f"SELECT {_FEATURE_COLUMNS} FROM feats_ref", _FEATURE_DOUBLES)
def shot_features_ref(spark, path):
    out = features(spark, path, "reference")
    return out.withColumn("net_x", F.col("net_x").cast("int")).select(*_FEATURE_COLUMNS.split(", "))
