"""SQL texts of the role views, shared by the oracles."""

from __future__ import annotations

_PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, needs: tuple[str, ...], text: str) -> None:
    _PARTS[name] = (needs, text)


def using(*names: str) -> str:
    """``WITH`` clause of the named parts and everything they need."""
    done: list[str] = []

    def visit(n: str) -> None:
        if n in done:
            return
        for m in _PARTS[n][0]:
            visit(m)
        done.append(n)

    for n in names:
        visit(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_PARTS[n][1]})" for n in done) + "\n"


def _pbp(pad: bool) -> str:
    minutes = "lpad(CAST(t // 60 AS VARCHAR), 4, '0')" if pad else "CAST(t // 60 AS VARCHAR)"
    return f"""
SELECT e.*, 'T' || home_team_id AS home_team_abbrev, 'T' || away_team_id AS away_team_abbrev,
  t AS time_seconds, {minutes} || ':' || lpad(CAST(t % 60 AS VARCHAR), 2, '0') AS time_in_period,
  CASE event_id % 5 WHEN 0 THEN '{{}}' WHEN 1 THEN '{{"goalieInNetId":null}}' WHEN 2 THEN 'bad{{'
    ELSE '{{"goalieInNetId":' || coalesce(goalie_in_net_id, 0) || ',"shotType":"tip"}}' END AS details_json
FROM (
  SELECT user_id AS game_id,
    CAST(20212022 + 10001 * floor((day(ts) - 1) / 10.0) AS BIGINT) AS season, CAST(2 AS BIGINT) AS game_type,
    CASE WHEN event_id % 53 = 0 THEN '' ELSE 'arena_' || (user_id % 12) END AS venue,
    1 + user_id % 8 AS home_team_id, 11 + user_id % 8 AS away_team_id, event_id, CAST(day(ts) AS BIGINT) AS period,
    'REG' AS period_type,
    CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS BIGINT) AS t,
    CASE event_type WHEN 'purchase' THEN 'goal' WHEN 'click' THEN 'shot-on-goal' WHEN 'view' THEN 'missed-shot'
      WHEN 'signup' THEN 'faceoff' WHEN 'error' THEN 'hit' END AS event_type,
    CASE WHEN event_id % 37 != 0 THEN (CAST(json_extract_string(props, '$.k') AS DOUBLE) - 50.0) * 2 END AS x_coord,
    CASE WHEN event_id % 37 != 0 THEN value % 85 - 42.5 END AS y_coord,
    CASE WHEN event_id % 2 = 0 THEN 1 + user_id % 8 ELSE 11 + user_id % 8 END AS event_owner_team_id,
    CASE WHEN event_id % 41 != 0 THEN
      8470000 + (CASE WHEN event_id % 2 = 0 THEN 11 + user_id % 8 ELSE 1 + user_id % 8 END) * 10 + user_id % 3
    END AS goalie_in_net_id,
    CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 4 = 0 THEN 'wrist' WHEN event_id % 4 = 1 THEN 'snap'
      ELSE 'slap' END AS shot_type
  FROM events) e"""


part("pbp", (), _pbp(True))
part("pbp_plain", (), _pbp(False))
part(
    "shifts",
    ("pbp",),
    """
SELECT game_id, period, event_owner_team_id AS team_id,
  CASE WHEN event_id % 6 = 0 THEN 8470000 + event_owner_team_id * 10 + game_id % 3 ELSE event_id % 25 END AS player_id,
  time_seconds AS start_sec, time_seconds + 600 + 60 * (event_id % 20) AS end_sec, 517 AS type_code
FROM pbp""",
)
part("goalies", ("pbp",), "SELECT DISTINCT goalie_in_net_id AS player_id FROM pbp WHERE goalie_in_net_id IS NOT NULL")
part(
    "names",
    ("goalies",),
    """
SELECT player_id AS goalie_id, n_name || ' ' || player_id AS goalie_name
FROM goalies JOIN nation ON player_id % 25 = n_nationkey WHERE player_id % 7 != 0""",
)
part(
    "scored_li",
    (),
    """
SELECT l_suppkey AS goalie_id, CAST(year(l_shipdate) AS BIGINT) AS season, l_orderkey AS game_id,
  l_partkey % 32 AS team_id, CAST(l_returnflag = 'R' AS INT) AS is_goal, 0.2::DOUBLE + 2 * l_discount AS xg_prob,
  l_quantity AS traffic_density, l_tax AS puck_speed
FROM lineitem""",
)
part(
    "series",
    (),
    """
SELECT *, CAST(season - 1975 + goalie_id % 5 AS DOUBLE) AS age FROM (
  SELECT CAST(c_nationkey AS BIGINT) AS goalie_id, CAST(year(o_orderdate) AS BIGINT) AS season,
    avg(o_totalprice) / 1e6 AS talent, count(*) AS shots_faced
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)""",
)
part("curve", (), "SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice / 1000 AS y FROM part")
part(
    "status_log",
    (),
    """
SELECT CASE WHEN event_id % 2 = 0 THEN 'pbp' ELSE 'shifts' END AS data_type, user_id AS game_id,
  CASE WHEN event_type IN ('purchase', 'click') THEN 'complete' ELSE 'failed' END AS state,
  'HTTP ' || (500 + event_id % 4) AS message, event_id AS seq
FROM events""",
)

part(
    "nets",
    ("pbp",),
    """
SELECT game_id, period, event_owner_team_id, 89 * (CASE WHEN sum(x_coord) > 0 THEN 1 ELSE -1 END) AS net_x
FROM pbp WHERE event_type IN ('shot-on-goal', 'goal', 'missed-shot') AND x_coord IS NOT NULL GROUP BY ALL""",
)
part(
    "marked",
    ("pbp", "nets"),
    """
SELECT pbp.*, net_x, event_type IN ('shot-on-goal', 'goal') AS on_goal,
  event_type = 'goal' AND event_owner_team_id = home_team_id AS home_scored,
  event_type = 'goal' AND event_owner_team_id = away_team_id AS away_scored,
  x_coord * net_x > 0 AND list_contains(
    ['hit', 'blocked-shot', 'faceoff', 'giveaway', 'takeaway', 'shot-on-goal', 'missed-shot'], event_type) AS crowding
FROM pbp LEFT JOIN nets USING (game_id, period, event_owner_team_id)""",
)


def _context(own: str) -> str:
    """Context of every event; ``own`` is the partition of neighbours and range frames."""
    return f"""
SELECT * EXCLUDE (last1, last2), last1.kind AS prev_event_type, last1.x AS prev_x, last1.y AS prev_y, last1.t AS prev_time_seconds,
  last2.kind || '->' || last1.kind AS sequence_2_events
FROM (
  SELECT *, lag({{'kind': event_type, 'x': x_coord, 'y': y_coord, 't': time_seconds}}) OVER steps AS last1,
    lag({{'kind': event_type}}, 2) OVER steps AS last2,
    ifnull(max(time_seconds) FILTER (WHERE event_type = 'faceoff') OVER until_now, 0) AS last_stoppage_time,
    count(*) FILTER (WHERE home_scored) OVER earlier AS home_goals,
    count(*) FILTER (WHERE away_scored) OVER earlier AS away_goals,
    count(*) FILTER (WHERE on_goal) OVER hour_before AS shot_sequence_num,
    count(*) FILTER (WHERE crowding) OVER two_hours_before AS traffic_density
  FROM marked
  WINDOW steps AS (PARTITION BY {own} ORDER BY event_id),
    until_now AS (PARTITION BY game_id, period ORDER BY event_id ROWS UNBOUNDED PRECEDING),
    earlier AS (PARTITION BY game_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    hour_before AS (PARTITION BY {own} ORDER BY time_seconds RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING),
    two_hours_before AS (PARTITION BY {own} ORDER BY time_seconds RANGE BETWEEN 7200 PRECEDING AND 1 PRECEDING))"""


part("context", ("marked",), _context("game_id, period"))
part("context_ref", ("marked",), _context("game_id"))


def _on_ice(shifts: str, team: str) -> str:
    return f"""(SELECT count(*) FROM {shifts} h WHERE h.game_id = s.game_id AND h.period = s.period AND h.team_id = s.{team}
    AND s.time_seconds BETWEEN h.start_sec AND h.end_sec - 1)"""


def _on_ice_counts(shifts: str) -> str:
    return f"""
SELECT game_id, period, event_id, {_on_ice(shifts, 'home_team_id')} AS home_skaters, {_on_ice(shifts, 'away_team_id')} AS away_skaters
FROM marked s WHERE on_goal AND x_coord IS NOT NULL"""


part("skaters", ("shifts", "goalies"), "SELECT * FROM shifts WHERE player_id NOT IN (SELECT player_id FROM goalies)")
part("strength", ("marked", "skaters"), _on_ice_counts("skaters"))
part("all_counts", ("marked", "shifts"), _on_ice_counts("shifts"))
part(
    "strength_ref",
    ("all_counts",),
    """
SELECT event_id, CAST(sum(home_skaters) AS BIGINT) AS home_skaters, CAST(sum(away_skaters) AS BIGINT) AS away_skaters
FROM all_counts GROUP BY event_id""",
)


def _features(context: str, strength: str, key: str, angle: str) -> str:
    return f"""
SELECT *, CASE WHEN home_skaters IS NULL OR away_skaters IS NULL THEN 'unknown'
    WHEN event_owner_team_id = away_team_id THEN away_skaters || 'v' || home_skaters
    ELSE home_skaters || 'v' || away_skaters END AS strength_state,
  abs(shot_angle - prev_angle) AS delta_angle,
  CASE WHEN time_since_last_event > 0 THEN distance_from_prev / time_since_last_event ELSE 0 END AS puck_speed,
  CASE WHEN time_since_last_event <= 3 AND sign(y_coord) != sign(prev_y) AND sign(prev_x) = sign(net_x)
    THEN 1 ELSE 0 END AS royal_road_cross
FROM (
  SELECT *, CASE WHEN shot_distance > 0 THEN {angle.format(y='adjusted_y', x='adjusted_x')} ELSE 0 END AS shot_angle,
    CASE WHEN prev_distance > 0 THEN {angle.format(y='prev_adjusted_y', x='prev_adjusted_x')} ELSE 0 END AS prev_angle,
    sqrt((x_coord - prev_x) * (x_coord - prev_x) + (y_coord - prev_y) * (y_coord - prev_y)) AS distance_from_prev
  FROM (
    SELECT *, sqrt((89 - adjusted_x) * (89 - adjusted_x) + adjusted_y * adjusted_y) AS shot_distance,
      sqrt((89 - prev_adjusted_x) * (89 - prev_adjusted_x) + prev_adjusted_y * prev_adjusted_y) AS prev_distance
    FROM (
      SELECT *, CASE WHEN net_x = 89 THEN x_coord ELSE -x_coord END AS adjusted_x,
        CASE WHEN net_x = 89 THEN y_coord ELSE -y_coord END AS adjusted_y,
        CASE WHEN net_x = 89 THEN prev_x ELSE -prev_x END AS prev_adjusted_x,
        CASE WHEN net_x = 89 THEN prev_y ELSE -prev_y END AS prev_adjusted_y
      FROM (
        SELECT c.game_id, c.season, c.game_type, c.venue, c.home_team_id, c.away_team_id, c.home_team_abbrev,
          c.away_team_abbrev, c.event_id, c.period, c.period_type, c.time_in_period, c.event_type, c.x_coord, c.y_coord,
          c.goalie_in_net_id, c.event_owner_team_id, c.details_json, CAST(coalesce(c.net_x, 89) AS INT) AS net_x,
          c.time_seconds, coalesce(prev_event_type, 'None') AS prev_event_type,
          coalesce(prev_x, 89.0) AS prev_x, coalesce(prev_y, 0.0) AS prev_y, prev_time_seconds,
          coalesce(sequence_2_events, 'None') AS sequence_2_events, last_stoppage_time, home_goals, away_goals,
          shot_sequence_num, traffic_density, st.home_skaters, st.away_skaters,
          CAST(coalesce(c.time_seconds - prev_time_seconds, 999) AS DOUBLE) AS time_since_last_event,
          CAST(coalesce(c.time_seconds - last_stoppage_time, 999) AS DOUBLE) AS time_since_last_stoppage,
          CASE WHEN c.event_owner_team_id = c.home_team_id THEN home_goals - away_goals
            ELSE away_goals - home_goals END AS score_differential,
          coalesce(c.shot_type, CASE WHEN json_valid(details_json)
            THEN json_extract_string(details_json, '$.shotType') END, 'unknown') AS shot_type,
          CASE WHEN json_valid(details_json)
            THEN CAST(json_extract_string(details_json, '$.goalieInNetId') IS NULL AS INT) ELSE 0 END AS is_empty_net,
          CAST(c.event_type = 'goal' AS INT) AS is_goal
        FROM {context} c LEFT JOIN {strength} st ON {key}
        WHERE c.event_type IN ('shot-on-goal', 'goal') AND c.x_coord IS NOT NULL))))
WHERE is_empty_net = 0 AND goalie_in_net_id IS NOT NULL"""


part(
    "feats",
    ("context", "strength"),
    _features(
        "context",
        "strength",
        "c.game_id = st.game_id AND c.period = st.period AND c.event_id = st.event_id",
        "degrees(atan2({y} + 0.0, 89 - {x}))",
    ),
)
part(
    "feats_ref",
    ("context_ref", "strength_ref"),
    _features("context_ref", "strength_ref", "c.event_id = st.event_id", "degrees(atan2({y}, 89 - {x}))"),
)
part("scored", ("feats",), "SELECT *, 1.0 / (1.0 + exp(0.04 * shot_distance - 1.0)) AS xg_prob FROM feats")
