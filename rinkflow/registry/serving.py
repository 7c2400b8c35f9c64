"""Queries of the front-end tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinkflow.functions import clock, details, numeric
from rinkflow.operators import ranks, topk
from rinkflow.plans import serving as V
from rinkflow.plans.scoring import calibrate
from rinkflow.registry import scoring as _scoring_parts  # noqa: F401  (its SQL parts are used below)
from rinkflow.registry.core import register
from rinkflow.registry.features import scored, stored
from rinkflow.registry.metrics import base
from rinkflow.registry.sql import part, using
from rinkflow.session import fresh_path
from rinkflow.sources import datasets, roles

SEASON = 20222023
MIN = 30

# Stand-ins for the model's talent and projection: shrunk goals saved per shot.
part("dsis", ("scored",), """
SELECT goalie_in_net_id AS goalie_id, (sum(xg_prob) - sum(is_goal)) / (count(*) + 50.0::DOUBLE) AS dsis_true_talent_gsax_per_shot
FROM scored WHERE goalie_in_net_id % 5 != 0 GROUP BY 1""")
part("proj", ("scored",), """
SELECT goalie_in_net_id AS goalie_id, 0.9::DOUBLE * (sum(xg_prob) - sum(is_goal)) / (count(*) + 40.0::DOUBLE) AS proj_1yr_talent_per_shot,
  max(season) AS latest_season
FROM scored WHERE goalie_in_net_id % 4 != 0 GROUP BY 1""")
part("effects", ("teamed",), """
SELECT team_id, season, (sum(xg_prob) - sum(is_goal)) / (count(*) + 20.0::DOUBLE) AS dsis_team_defense_impact_per_shot
FROM teamed GROUP BY 1, 2""")


def dsis(shots):
    g = F.col("goalie_in_net_id")
    talent = (F.sum("xg_prob") - F.sum("is_goal")) / (F.count(F.lit(1)) + F.lit(50.0))
    return shots.filter(g % 5 != 0).groupBy(g.alias("goalie_id")).agg(talent.alias("dsis_true_talent_gsax_per_shot"))


def proj(shots):
    g = F.col("goalie_in_net_id")
    talent = 0.9 * (F.sum("xg_prob") - F.sum("is_goal")) / (F.count(F.lit(1)) + F.lit(40.0))
    return shots.filter(g % 4 != 0).groupBy(g.alias("goalie_id")).agg(
        talent.alias("proj_1yr_talent_per_shot"), F.max("season").alias("latest_season")
    )


def effects(shots):
    from rinkflow.plans.metrics import with_team

    value = (F.sum("xg_prob") - F.sum("is_goal")) / (F.count(F.lit(1)) + F.lit(20.0))
    return with_team(shots).groupBy("team_id", "season").agg(value.alias("dsis_team_defense_impact_per_shot"))


def flagship_board(spark, path):
    """Calibrated shots to goalie leaderboard."""
    shots = calibrate(stored(spark, path))
    return V.leaderboard(shots, roles.names(spark, path), dsis(shots), None, min_shots=3)


def _pct(new: str, c: str) -> str:
    w = f"(PARTITION BY {c} IS NULL ORDER BY {c}"
    return (
        f"CASE WHEN {c} IS NOT NULL THEN 100.0 * (rank() OVER {w}) + count(*) OVER {w} RANGE BETWEEN UNBOUNDED PRECEDING "
        f"AND CURRENT ROW)) / (2.0 * count({c}) OVER ()) END AS {new}"
    )


def _board(where: str, rci: str, source: str = "scored", least: int = MIN) -> str:
    ranked = [("gsax_pct", "gsax"), ("traffic_pct", "avg_traffic"), ("speed_pct", "avg_speed"), ("movement_pct", "avg_movement")]
    if rci:
        ranked.append(("rci_pct", "rci"))
    return f"""
SELECT *, {', '.join(_pct(n, c) for n, c in ranked)} FROM (
  SELECT b.*, coalesce(goalie_name, CAST(goalie_id AS VARCHAR)) AS goalie_name,
    dsis_true_talent_gsax_per_shot AS isolated_talent {', rci' if rci else ''}
  FROM (SELECT goalie_in_net_id AS goalie_id, count(*) AS shots, CAST(sum(is_goal) AS BIGINT) AS goals,
      1.0 - sum(is_goal)::DOUBLE / count(*) AS sv_pct, sum(xg_prob) - sum(is_goal) AS gsax,
      avg(traffic_density) AS avg_traffic, avg(puck_speed) AS avg_speed, avg(abs(delta_angle)) AS avg_movement
    FROM {source} WHERE {where} GROUP BY 1 HAVING count(*) >= {least}) b
  LEFT JOIN names USING (goalie_id) LEFT JOIN dsis USING (goalie_id)
  {f'LEFT JOIN ({rci}) r USING (goalie_id)' if rci else ''})"""


_LATEST = "SELECT goalie_in_net_id AS goalie_id, arg_max(rci, season) AS rci FROM base GROUP BY 1"
_OF_SEASON = f"SELECT goalie_in_net_id AS goalie_id, rci FROM base WHERE season = {SEASON}"
_BOARD_DOUBLES = "sv_pct gsax avg_traffic avg_speed avg_movement isolated_talent rci gsax_pct traffic_pct speed_pct movement_pct rci_pct"
_WITH = using("scored", "names", "dsis", "base")


@register("leaderboard", _WITH + _board("true", _LATEST), _BOARD_DOUBLES, 5)
def leaderboard(spark, path):
    shots = stored(spark, path)
    return V.leaderboard(shots, roles.names(spark, path), dsis(shots), base(shots), min_shots=MIN)


@register("leaderboard_season", _WITH + _board(f"season = {SEASON}", _OF_SEASON, least=10), _BOARD_DOUBLES, 5)
def leaderboard_season(spark, path):
    shots = stored(spark, path)
    return V.leaderboard(shots, roles.names(spark, path), dsis(shots), base(shots), season=SEASON, min_shots=10)


_TEAM = """(event_owner_team_id = home_team_id AND away_team_abbrev = 'T3')
  OR (event_owner_team_id = away_team_id AND home_team_abbrev = 'T3')"""


@register("leaderboard_team", using("scored", "names", "dsis") + _board(_TEAM, ""), " ".join(c for c in _BOARD_DOUBLES.split() if not c.startswith("rci")), 5)
def leaderboard_team(spark, path):
    shots = scored(spark, path)
    return V.leaderboard(shots, roles.names(spark, path), dsis(shots), team="T3", min_shots=MIN)


@register("leaderboard_sorted", _WITH + f"SELECT goalie_id, rci, row_number() OVER (ORDER BY rci DESC NULLS LAST, goalie_id) AS pos FROM ({_board('true', _LATEST)})", "rci", 5)
def leaderboard_sorted(spark, path):
    shots = stored(spark, path)
    board = V.leaderboard(shots, roles.names(spark, path), dsis(shots), base(shots), min_shots=MIN, sort=("rci", "desc"))
    numbered = ranks.row_numbers(board.withColumn("__neg", -F.col("rci")), "__neg", "goalie_id", "pos")
    return numbered.select("goalie_id", "rci", "pos")


@register("leaderboard_top", using("scored", "names", "dsis") + f"SELECT goalie_id, gsax, row_number() OVER (ORDER BY gsax DESC, goalie_id) AS rank FROM ({_board('true', '')}) ORDER BY rank LIMIT 10", "gsax", 5)
def leaderboard_top(spark, path):
    shots = scored(spark, path)
    board = V.leaderboard(shots, roles.names(spark, path), dsis(shots), min_shots=MIN)
    return topk.top_n(board, "gsax", "goalie_id", 10).select("goalie_id", "gsax", "rank")


part("dsis_cal", ("calibrated",), """
SELECT goalie_in_net_id AS goalie_id, (sum(xg_prob) - sum(is_goal)) / (count(*) + 50.0::DOUBLE) AS dsis_true_talent_gsax_per_shot
FROM calibrated WHERE goalie_in_net_id % 5 != 0 GROUP BY 1""")
_NO_RCI = " ".join(c for c in _BOARD_DOUBLES.split() if not c.startswith("rci"))


@register(
    "flagship",
    using("calibrated", "names", "dsis_cal")
    + _board("true", "", "calibrated", 3).replace("LEFT JOIN dsis ", "LEFT JOIN dsis_cal "),
    _NO_RCI,
    5,
)
def flagship(spark, path):
    return flagship_board(spark, path)


@register("distinct_meta", using("scored") + """
SELECT DISTINCT 'season' AS kind, CAST(season AS VARCHAR) AS value FROM scored
UNION ALL SELECT 'team', t FROM (SELECT home_team_abbrev AS t FROM scored UNION SELECT away_team_abbrev FROM scored) WHERE t IS NOT NULL""")
def distinct_meta(spark, path):
    return V.filter_values(scored(spark, path))


_CAREER = """
SELECT goalie_in_net_id AS goalie_id, season, count(*) AS shots, CAST(sum(is_goal) AS BIGINT) AS goals,
  1.0 - sum(is_goal)::DOUBLE / count(*) AS sv_pct, sum(xg_prob) - sum(is_goal) AS gsax,
  avg(traffic_density) AS avg_traffic, avg(puck_speed) AS avg_speed FROM scored GROUP BY 1, 2"""
part("career", ("scored",), _CAREER)
part("recent", ("scored",), """
SELECT goalie_in_net_id AS goalie_id, row_number() OVER (PARTITION BY goalie_in_net_id ORDER BY game_id DESC, event_id DESC) AS recency,
  game_id, event_id, adjusted_x, adjusted_y, xg_prob, is_goal, traffic_density, puck_speed, shot_type, shot_distance
FROM scored QUALIFY recency <= 20""")


@register("goalie_career", using("career") + "SELECT * FROM career", "sv_pct gsax avg_traffic avg_speed")
def goalie_career(spark, path):
    return V.career(scored(spark, path))


@register("recent_shots", using("recent") + "SELECT * FROM recent", "adjusted_x adjusted_y xg_prob puck_speed shot_distance")
def recent_shots(spark, path):
    return V.recent_shots(scored(spark, path), 20)


@register("goalie_detail", using("career", "recent", "names", "base", "proj") + """
, parts AS (SELECT 'career' AS part, goalie_id, season AS k, gsax AS v FROM career
  UNION ALL SELECT 'recent', goalie_id, recency, xg_prob FROM recent
  UNION ALL SELECT 'base', goalie_in_net_id, season, gsax_cumulative FROM base
  UNION ALL SELECT 'projection', goalie_id, latest_season, proj_1yr_talent_per_shot FROM proj)
SELECT part, goalie_id, coalesce(goalie_name, CAST(goalie_id AS VARCHAR)) AS name, k, v FROM parts LEFT JOIN names USING (goalie_id)""", "v")
def goalie_detail(spark, path):
    shots = stored(spark, path)
    nested = V.goalie_detail(shots, roles.names(spark, path), proj(shots), base(shots), n_recent=20)

    def listed(column, name, k, v):
        return F.transform(column, lambda r: F.struct(F.lit(name).alias("part"), r[k].cast("bigint").alias("k"), r[v].alias("v")))

    p = F.col("projection")
    single = F.when(
        p.isNotNull(),
        F.array(F.struct(F.lit("projection").alias("part"), p["latest_season"].alias("k"), p["proj_1yr_talent_per_shot"].alias("v"))),
    )
    empty = F.array().cast("array<struct<part:string,k:bigint,v:double>>")
    lists = [
        listed(F.col("career"), "career", "season", "gsax"),
        listed(F.col("recent_shots"), "recent", "recency", "xg_prob"),
        F.coalesce(listed(F.col("base_metrics"), "base", "season", "gsax_cumulative"), empty),
        F.coalesce(single, empty),
    ]
    return nested.select("goalie_id", "name", F.inline(F.concat(*lists)))


@register("projections_active", using("proj", "names", "scored") + """
SELECT p.*, career_shots, coalesce(goalie_name, CAST(goalie_id AS VARCHAR)) AS goalie_name FROM proj p
JOIN (SELECT goalie_in_net_id AS goalie_id, count(*) AS career_shots FROM scored GROUP BY 1
  HAVING max(season) = (SELECT max(season) FROM scored) AND count(*) >= 40) USING (goalie_id) LEFT JOIN names USING (goalie_id)""", "proj_1yr_talent_per_shot")
def projections_active(spark, path):
    shots = scored(spark, path)
    return V.projections_active(proj(shots), shots, roles.names(spark, path), 40)


@register("team_defense", using("effects") + f"""
SELECT e.*, coalesce(team_name, CAST(team_id AS VARCHAR)) AS team_name FROM effects e
LEFT JOIN (SELECT DISTINCT home_team_id AS team_id, home_team_abbrev AS team_name FROM scored) USING (team_id) WHERE season = {SEASON}""", "dsis_team_defense_impact_per_shot")
def team_defense(spark, path):
    shots = scored(spark, path)
    return V.team_defense(effects(shots), shots, SEASON)


@register("head_to_head", using("names", "scored", "goalies") + f"""
SELECT g.player_id AS goalie_id, count(event_id) AS shots, CAST(sum(is_goal) AS BIGINT) AS goals, sum(xg_prob) - sum(is_goal) AS gsax,
  1.0 - sum(is_goal)::DOUBLE / nullif(count(event_id), 0) AS sv_pct, avg(traffic_density) AS avg_traffic, avg(puck_speed) AS avg_speed,
  avg(abs(delta_angle)) AS avg_movement, coalesce(any_value(goalie_name), CAST(g.player_id AS VARCHAR)) AS goalie_name
FROM goalies g LEFT JOIN scored s ON g.player_id = s.goalie_in_net_id AND season = {SEASON} LEFT JOIN names n ON n.goalie_id = g.player_id
GROUP BY g.player_id""", "gsax sv_pct avg_traffic avg_speed avg_movement")
def head_to_head(spark, path):
    ids = roles.goalies(spark, path).select(F.col("player_id").alias("goalie_id"))
    return V.head_to_head(scored(spark, path), roles.names(spark, path), ids, SEASON)


_CARD = f"""
SELECT goalie_in_net_id AS goalie_id, count(*) AS shots, CAST(sum(is_goal) AS BIGINT) AS goals, sum(xg_prob) - sum(is_goal) AS gsax_2_0,
  avg(traffic_density) AS avg_traffic, avg(puck_speed) AS avg_speed, avg(delta_angle) AS avg_movement
FROM scored WHERE season = {SEASON} GROUP BY 1 HAVING count(*) >= 10"""


@register("card_stats", _WITH + f"""
SELECT *, {', '.join(_pct(f'{c}_percentile', c) for c in V.CARD_COLUMNS)},
  CASE WHEN abs(proj_1yr_talent_per_shot - dsis_true_talent_gsax_per_shot) < 1e-4 THEN 'STABLE'
    WHEN proj_1yr_talent_per_shot > dsis_true_talent_gsax_per_shot THEN 'TRENDING UP ↑'
    WHEN proj_1yr_talent_per_shot <= dsis_true_talent_gsax_per_shot THEN 'TRENDING DOWN ↓' END AS trend
FROM (SELECT c.*, dsis_true_talent_gsax_per_shot, proj_1yr_talent_per_shot, rci, coalesce(goalie_name, CAST(goalie_id AS VARCHAR)) AS "Goalie"
  FROM ({_CARD}) c LEFT JOIN dsis USING (goalie_id) LEFT JOIN PROJ USING (goalie_id) LEFT JOIN ({_OF_SEASON}) r USING (goalie_id)
  LEFT JOIN names USING (goalie_id))""".replace("LEFT JOIN PROJ USING", """LEFT JOIN (
    SELECT goalie_in_net_id AS goalie_id, 0.9::DOUBLE * (sum(xg_prob) - sum(is_goal)) / (count(*) + 40.0::DOUBLE) AS proj_1yr_talent_per_shot
    FROM scored WHERE goalie_in_net_id % 4 != 0 GROUP BY 1) p USING"""),
    "gsax_2_0 avg_traffic avg_speed avg_movement dsis_true_talent_gsax_per_shot proj_1yr_talent_per_shot rci "
    + " ".join(f"{c}_percentile" for c in V.CARD_COLUMNS), 5)
def card_stats(spark, path):
    shots = stored(spark, path)
    return V.card_stats(shots, dsis(shots), proj(shots), base(shots), roles.names(spark, path), SEASON, 10)


@register("calibrated_gsax", using("calibrated") + f"""
SELECT goalie_in_net_id AS goalie_id, CASE WHEN event_owner_team_id = home_team_id THEN away_team_id ELSE home_team_id END AS team_id,
  count(*) AS shots_faced, sum(xg_prob) AS "xG_against", CAST(sum(is_goal) AS BIGINT) AS goals_against, sum(xg_prob) - sum(is_goal) AS gsax_2_0
FROM calibrated WHERE season = {SEASON} AND is_empty_net = 0 GROUP BY 1, 2""", "xG_against gsax_2_0", 5)
def calibrated_gsax(spark, path):
    return V.calibrated_gsax(scored(spark, path), None, SEASON)


@register("career_totals", using("career", "base", "proj") + """
SELECT t.*, 1.0 - goals::DOUBLE / shots AS sv_pct, avg_rci, proj_1yr_talent_per_shot * 1500 AS projected_season_gsax
FROM (SELECT goalie_id, CAST(sum(shots) AS BIGINT) AS shots, CAST(sum(goals) AS BIGINT) AS goals, sum(gsax) AS gsax FROM career GROUP BY 1) t
LEFT JOIN (SELECT goalie_in_net_id AS goalie_id, avg(coalesce(rci, 0)) AS avg_rci FROM base GROUP BY 1) USING (goalie_id)
LEFT JOIN proj USING (goalie_id)""", "gsax sv_pct avg_rci projected_season_gsax", 5)
def career_totals(spark, path):
    shots = stored(spark, path)
    return V.career_totals(shots, base(shots), proj(shots))


@register("unified_metrics", using("base", "dsis", "proj") + """
SELECT goalie_in_net_id AS goalie_id, season, shots_faced, gsax_cumulative, rci, mda, dsis_true_talent_gsax_per_shot, proj_1yr_talent_per_shot
FROM base LEFT JOIN dsis ON goalie_in_net_id = dsis.goalie_id LEFT JOIN proj ON goalie_in_net_id = proj.goalie_id""",
    "gsax_cumulative rci mda dsis_true_talent_gsax_per_shot proj_1yr_talent_per_shot", 5)
def unified_metrics(spark, path):
    shots = stored(spark, path)
    return V.unified_metrics(base(shots), dsis(shots), proj(shots))


@register("unified_written", using("base") + "SELECT season, 2 * count(*) AS n, CAST(2 * sum(shots_faced) AS BIGINT) AS shots, sum(gsax_cumulative) AS gsax FROM base GROUP BY 1", "gsax", 4)
def unified_written(spark, path):
    """The unified table written in both forms, both read again."""
    target = fresh_path(spark, "unified")
    V.write_unified(unified_metrics(spark, path), target)
    kept = spark.read.parquet(f"{target}/parquet").select("season", "shots_faced", "gsax_cumulative", F.lit(1).alias("half"))
    text = spark.read.option("header", True).csv(f"{target}/csv")
    text = text.select(F.col("season").cast("bigint"), F.col("shots_faced").cast("bigint"), F.col("gsax_cumulative").cast("double"), F.lit(1).alias("half"))
    sums = F.sum("shots_faced").cast("bigint").alias("shots"), (F.sum("gsax_cumulative") / 2).alias("gsax")
    return kept.unionAll(text).groupBy("season").agg(F.count(F.lit(1)).alias("n"), *sums)


@register("latest_per_key", using("base") + "SELECT goalie_in_net_id, max(season) AS season, arg_max(rci, season) AS rci FROM base GROUP BY 1", "rci")
def latest_per_key(spark, path):
    return topk.latest_per_key(base(scored(spark, path)), "goalie_in_net_id", "season", ["rci"])


@register("attach_names", using("names", "goalies") + """
SELECT player_id AS goalie_id, coalesce(goalie_name, CAST(player_id AS VARCHAR)) AS goalie_name FROM goalies LEFT JOIN names ON goalie_id = player_id""")
def attach_names(spark, path):
    return V.attach_names(roles.goalies(spark, path).select(F.col("player_id").alias("goalie_id")), roles.names(spark, path))


part("name_dim", ("names", "goalies"), "SELECT player_id AS goalie_id, coalesce(goalie_name, CAST(player_id AS VARCHAR)) AS goalie_name FROM goalies LEFT JOIN names ON goalie_id = player_id")


@register("missing_names", using("name_dim") + "SELECT * FROM name_dim WHERE CAST(goalie_id AS VARCHAR) = goalie_name")
def missing_names(spark, path):
    return V.missing_names(attach_names(spark, path))


@register("upsert_dim", using("name_dim") + "SELECT goalie_id, CASE WHEN goalie_id % 3 = 0 THEN 'found ' || goalie_id ELSE goalie_name END AS goalie_name FROM name_dim")
def upsert_dim(spark, path):
    dim = attach_names(spark, path)
    found = dim.filter(F.col("goalie_id") % 3 == 0).select(
        "goalie_id", F.concat(F.lit("found "), F.col("goalie_id").cast("string")).alias("goalie_name")
    )
    return V.upsert(dim, found, "goalie_id", "goalie_name")


@register("optional_dim", using("goalies") + "SELECT player_id AS goalie_id, 0.0::DOUBLE AS effect FROM goalies")
def optional_dim(spark, path):
    absent = datasets.read_optional(spark, f"{path}/absent_effects.parquet", "goalie_id BIGINT, effect DOUBLE")
    ids = roles.goalies(spark, path).select(F.col("player_id").alias("goalie_id"))
    return ids.join(absent, "goalie_id", "left").fillna({"effect": 0.0})


@register("full_name", "SELECT c_custkey, trim(c_mktsegment || ' ' || c_name) AS name FROM customer")
def full_name(spark, path):
    rows = roles.table(spark, path, "customer")
    return rows.select("c_custkey", details.full_name(F.col("c_mktsegment"), F.concat(F.col("c_name"), F.lit(" "))).alias("name"))


@register("season_code", "SELECT o_orderkey, CAST(year(o_orderdate) * 10000 + year(o_orderdate) + 1 AS BIGINT) AS season FROM orders")
def season_code(spark, path):
    return roles.table(spark, path, "orders").select("o_orderkey", clock.season_code(F.year("o_orderdate")).alias("season"))


@register("compound_key", using("effects") + "SELECT team_id || '_' || season AS team_season, team_id, season FROM effects")
def compound_key(spark, path):
    keyed = effects(scored(spark, path)).select(details.compound_key(F.col("team_id"), F.col("season")).alias("team_season"))
    parts = F.split("team_season", "_")
    return keyed.select("team_season", parts[0].cast("bigint").alias("team_id"), parts[1].cast("bigint").alias("season"))


@register("format_display", using("career", "proj") + """
SELECT goalie_id, CAST(season AS VARCHAR)[1:4] || '-' || CAST(season AS VARCHAR)[7:8] AS season_text,
  '.' || CAST(round(sv_pct * 1000) AS BIGINT) AS pct_reference, CASE WHEN round(sv_pct * 1000) >= 100
    THEN '.' || CAST(round(sv_pct * 1000) AS BIGINT) ELSE '.' || lpad(CAST(CAST(round(sv_pct * 1000) AS BIGINT) AS VARCHAR), 3, '0') END AS pct_text,
  CASE WHEN p >= 0 THEN '+' ELSE '' END || printf('%.4f', p) AS talent_text
FROM (SELECT c.*, round(proj_1yr_talent_per_shot, 6) + 0.00001::DOUBLE AS p FROM career c JOIN proj USING (goalie_id))""")
def format_display(spark, path):
    shots = scored(spark, path)
    rows = V.career(shots).join(proj(shots), "goalie_id")
    talent = F.round("proj_1yr_talent_per_shot", 6) + F.lit(0.00001)
    return rows.select(
        "goalie_id",
        numeric.fmt_season(F.col("season")).alias("season_text"),
        numeric.fmt_pct(F.col("sv_pct"), "reference").alias("pct_reference"),
        numeric.fmt_pct(F.col("sv_pct")).alias("pct_text"),
        numeric.fmt_signed(talent).alias("talent_text"),
    )


@register("scale_projection", using("proj") + """
SELECT goalie_id, proj_1yr_talent_per_shot * 30 AS per_game, proj_1yr_talent_per_shot * 1500 AS per_season, 1.96 * 0.01::DOUBLE * 30 AS half_width FROM proj""", "per_game per_season half_width", 5)
def scale_projection(spark, path):
    p = F.col("proj_1yr_talent_per_shot")
    low, high = numeric.interval(p, F.lit(0.01), numeric.Z_95)
    return proj(scored(spark, path)).select(
        "goalie_id",
        numeric.scale(p, numeric.SHOTS_PER_GAME).alias("per_game"),
        numeric.scale(p, numeric.SHOTS_PER_SEASON).alias("per_season"),
        numeric.scale((high - low) / 2, numeric.SHOTS_PER_GAME).alias("half_width"),
    )


@register("trend_label", using("dsis", "proj") + """
SELECT goalie_id, CASE WHEN abs(p - d) < 0.002 THEN 'STABLE' WHEN p > d THEN 'TRENDING UP ↑' ELSE 'TRENDING DOWN ↓' END AS trend
FROM (SELECT goalie_id, proj_1yr_talent_per_shot AS p, dsis_true_talent_gsax_per_shot AS d FROM dsis JOIN proj USING (goalie_id))""")
def trend_label(spark, path):
    shots = scored(spark, path)
    rows = dsis(shots).join(proj(shots), "goalie_id")
    label = numeric.trend_label(F.col("dsis_true_talent_gsax_per_shot"), F.col("proj_1yr_talent_per_shot"), 0.002)
    return rows.select("goalie_id", label.alias("trend"))


@register("replace_column", "SELECT * EXCLUDE (l_discount), round(l_discount * 100) / 10 AS l_discount FROM (SELECT l_orderkey, l_discount, l_quantity FROM lineitem)", "l_discount")
def replace_column(spark, path):
    rows = roles.table(spark, path, "lineitem").select("l_orderkey", "l_discount", "l_quantity")
    return rows.withColumn("__new", F.round(F.col("l_discount") * 100) / 10).drop("l_discount").withColumnRenamed("__new", "l_discount")


@register("json_records", using("scored") + """
SELECT '{"goalie_id":' || goalie_in_net_id || ',"shots":' || count(*) || ',"half":' ||
  CASE WHEN sum(is_goal) = 0 THEN 'null' ELSE CAST(sum(is_goal) AS BIGINT) || '.5' END || '}' AS record FROM scored GROUP BY goalie_in_net_id""")
def json_records(spark, path):
    rows = scored(spark, path).groupBy(F.col("goalie_in_net_id").alias("goalie_id")).agg(
        F.count(F.lit(1)).alias("shots"), F.sum("is_goal").alias("g")
    )
    half = F.when(F.col("g") > 0, F.col("g") + 0.5).otherwise(F.lit(float("nan")))
    return datasets.to_json_records(rows.select("goalie_id", "shots", half.alias("half")))
