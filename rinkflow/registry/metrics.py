"""Queries of goalie metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinkflow.operators import ranks
from rinkflow.plans import metrics as M
from rinkflow.registry.core import register
from rinkflow.registry.features import scored
from rinkflow.registry.sql import part, using
from rinkflow.sources import roles

# Wider limits than in a rink, because the test events are sparse.
REBOUND = {"max_gap": 7200, "max_distance": 120}
MIN_SHOTS = 10


def _rebounds(keys: str, soon: str) -> str:
    return f"""
SELECT *, CAST(hit AS INT) AS generated_rebound, if(hit, nxt.xg, 0) AS generated_rebound_xg,
  delta_angle / (time_since_last_event + 0.1::DOUBLE) AS movement_demand
FROM (
  SELECT *, ifnull(is_goal = 0 AND nxt.team = event_owner_team_id AND nxt.distance <= 120 AND {soon}, false) AS hit
  FROM (SELECT *, lead({{'t': time_seconds, 'distance': shot_distance, 'xg': xg_prob, 'team': event_owner_team_id}}) OVER (
    PARTITION BY {keys}, goalie_in_net_id ORDER BY event_id) AS nxt FROM scored))"""


part("rebounds", ("scored",), _rebounds("game_id, period", "nxt.t - time_seconds BETWEEN 0 AND 7200"))
part("rebounds_ref", ("scored",), _rebounds("game_id", "nxt.t - time_seconds <= 7200"))


def _base(source: str, rate: str) -> str:
    return f"""
SELECT *, {rate} AS rebound_rate, total_rebound_xg_danger / nullif(rebounds_generated, 0) AS rebound_danger,
  ifnull(avg_mda_saves, 0) - ifnull(avg_mda_goals, 0) AS mda
FROM (
  SELECT goalie_in_net_id, season, count(*) AS shots_faced, count(*) FILTER (WHERE is_goal = 1) AS actual_goals_allowed,
    sum(xg_prob) AS expected_goals, sum(xg_prob - is_goal) AS gsax_cumulative, count(*) FILTER (WHERE is_goal = 0) AS total_saves,
    count(*) FILTER (WHERE generated_rebound = 1) AS rebounds_generated, sum(generated_rebound_xg) AS total_rebound_xg_danger,
    avg(movement_demand) FILTER (WHERE is_goal = 0) AS avg_mda_saves, avg(movement_demand) FILTER (WHERE is_goal = 1) AS avg_mda_goals
  FROM {source} GROUP BY ALL HAVING count(*) > {MIN_SHOTS})"""


part("base0", ("rebounds",), _base("rebounds", "CAST(rebounds_generated AS DOUBLE) / nullif(total_saves, 0)"))
part("base0_ref", ("rebounds_ref",), _base("rebounds_ref", "CAST(rebounds_generated AS FLOAT) / CAST(nullif(total_saves, 0) AS FLOAT)"))
_RCI = """
SELECT *, 1 - rr_x_rd / nullif(avg(rr_x_rd) OVER (), 0) AS rci
FROM (SELECT *, CAST(rebound_rate AS DOUBLE) * coalesce(rebound_danger, 0) AS rr_x_rd FROM {})"""
part("base", ("base0",), _RCI.format("base0"))
part("base_ref", ("base0_ref",), _RCI.format("base0_ref"))

_DOUBLES = (
    "expected_goals gsax_cumulative total_rebound_xg_danger avg_mda_saves avg_mda_goals rebound_rate rebound_danger mda rr_x_rd rci"
)


def base(shots, compat="fixed"):
    return M.goalie_season_metrics(shots, MIN_SHOTS, compat, **REBOUND)


@register("rebounds", using("rebounds") + "SELECT event_id, generated_rebound, generated_rebound_xg FROM rebounds", "generated_rebound_xg")
def rebounds(spark, path):
    return M.rebounds(M.faced(scored(spark, path)), **REBOUND).select("event_id", "generated_rebound", "generated_rebound_xg")


@register("rebound_rates", using("base") + "SELECT goalie_in_net_id, season, rebound_rate, rebound_danger FROM base", "rebound_rate rebound_danger")
def rebound_rates(spark, path):
    return base(scored(spark, path)).select(M.GOALIE, "season", "rebound_rate", "rebound_danger")


@register("rci", using("base") + "SELECT goalie_in_net_id, season, rr_x_rd, rci FROM base", "rr_x_rd rci")
def rci(spark, path):
    return base(scored(spark, path)).select(M.GOALIE, "season", "rr_x_rd", "rci")


@register("mda", using("base") + "SELECT goalie_in_net_id, season, avg_mda_saves, avg_mda_goals, mda FROM base", "avg_mda_saves avg_mda_goals mda")
def mda(spark, path):
    return base(scored(spark, path)).select(M.GOALIE, "season", "avg_mda_saves", "avg_mda_goals", "mda")


@register("goalie_season_metrics", using("base") + "SELECT * FROM base", _DOUBLES)
def goalie_season_metrics(spark, path):
    return base(scored(spark, path)).orderBy(F.desc_nulls_last("gsax_cumulative"))


@register("goalie_season_metrics_ref", using("base_ref") + "SELECT * FROM base_ref", _DOUBLES)
def goalie_season_metrics_ref(spark, path):
    return base(scored(spark, path), "reference")


part("teamed", ("scored",), """
SELECT *, CASE WHEN event_owner_team_id = home_team_id THEN away_team_id ELSE home_team_id END AS team_id FROM scored""")
part("team_season", ("teamed",), """
SELECT goalie_in_net_id AS goalie_id, team_id, season, count(*) AS shots_faced, count(DISTINCT game_id) AS games_played,
  sum(xg_prob) - sum(is_goal) AS raw_gsax_2_0 FROM teamed GROUP BY 1, 2, 3 HAVING count(DISTINCT game_id) >= 3""")
part("game_obs", ("teamed",), """
SELECT goalie_in_net_id AS goalie_id, team_id, season, game_id, count(*) AS shots_faced,
  (sum(xg_prob) - sum(is_goal)) / count(*) AS gsax_per_shot, avg(traffic_density) AS avg_traffic, avg(puck_speed) AS avg_speed
FROM teamed GROUP BY 1, 2, 3, 4 HAVING count(*) > 2""")


@register("goalie_team_season", using("team_season") + "SELECT * FROM team_season", "raw_gsax_2_0")
def goalie_team_season(spark, path):
    return M.goalie_team_season(scored(spark, path), 3)


@register("goalie_game_obs", using("game_obs") + "SELECT * FROM game_obs", "gsax_per_shot avg_traffic avg_speed")
def goalie_game_obs(spark, path):
    return M.goalie_game_obs(scored(spark, path), 2)


@register("zscore", using("game_obs") + """
SELECT goalie_id, game_id, season, (avg_traffic - avg(avg_traffic) OVER ()) / stddev_samp(avg_traffic) OVER () AS traffic_std,
  (avg_speed - avg(avg_speed) OVER ()) / stddev_samp(avg_speed) OVER () AS speed_std FROM game_obs""", "traffic_std speed_std", 4)
def zscore(spark, path):
    obs = M.goalie_game_obs(scored(spark, path), 2)
    return M.zscore(obs, {"traffic_std": "avg_traffic", "speed_std": "avg_speed"}).select(
        "goalie_id", "game_id", "season", "traffic_std", "speed_std"
    )


@register("season_rates", using("scored") + """
SELECT season, count(*) AS shots, CAST(sum(is_goal) AS BIGINT) AS total_goals, sum(xg_prob) AS total_xg,
  sum(is_goal) * 1.0 / count(*) AS avg_goal_rate, sum(xg_prob) / count(*) AS avg_xg_prob
FROM scored GROUP BY season ORDER BY season DESC LIMIT 2""", "total_xg avg_goal_rate avg_xg_prob", 4)
def season_rates(spark, path):
    return M.season_rates(scored(spark, path), 2)


@register("zone_save_pct", using("scored") + """
SELECT *, 1.0 - goals::DOUBLE / shots AS sv_pct FROM (
  SELECT goalie_in_net_id AS goalie_id, CASE WHEN shot_distance <= 30 AND abs(shot_angle) <= 45 THEN 'low_slot'
      WHEN shot_distance <= 60 AND abs(shot_angle) <= 45 THEN 'high_slot' WHEN shot_distance <= 60 THEN 'side' ELSE 'far' END AS zone,
    count(*) AS shots, CAST(sum(is_goal) AS BIGINT) AS goals, sum(xg_prob) - sum(is_goal) AS gsax FROM scored GROUP BY 1, 2)""", "gsax sv_pct")
def zone_save_pct(spark, path):
    return M.zone_save_pct(scored(spark, path))


@register("top_bottom", using("scored_li") + """
SELECT * FROM (SELECT 'top' AS side, row_number() OVER (ORDER BY gsax DESC, goalie_id) AS rank, * FROM g) WHERE rank <= 10
UNION ALL SELECT * FROM (SELECT 'bottom', row_number() OVER (ORDER BY gsax, goalie_id) AS rank, * FROM g) WHERE rank <= 5"""
    .replace("FROM g)", "FROM (SELECT goalie_id, count(*) AS shots, CAST(sum(is_goal) AS BIGINT) AS goals, "
             "sum(xg_prob) - sum(is_goal) AS gsax FROM scored_li GROUP BY 1))"), "gsax", 4)
def top_bottom(spark, path):
    from rinkflow.operators.topk import top_n

    board = M.gsax(roles.scored_lineitem(spark, path), ["goalie_id"])
    top = top_n(board, "gsax", "goalie_id", 10).withColumn("side", F.lit("top"))
    low = top_n(board, "gsax", "goalie_id", 5, ascending=True).withColumn("side", F.lit("bottom"))
    return top.unionByName(low)


@register("pct_rank", using("scored_li") + """
SELECT l_partkey, gsax, CASE WHEN gsax IS NOT NULL THEN 100.0 * (rank() OVER (PARTITION BY gsax IS NULL ORDER BY gsax)
  + count(*) OVER (PARTITION BY gsax IS NULL ORDER BY gsax RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  / (2.0 * count(gsax) OVER ()) END AS gsax_pct
FROM (SELECT l_partkey, CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE CAST(count(*) AS DOUBLE) END AS gsax FROM lineitem GROUP BY 1)""", "gsax gsax_pct")
def pct_rank(spark, path):
    sizes = roles.table(spark, path, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    rows = sizes.select("l_partkey", F.when(F.col("l_partkey") % 50 != 0, F.col("n").cast("double")).alias("gsax"))
    return ranks.pct_rank(rows, {"gsax_pct": "gsax"})
