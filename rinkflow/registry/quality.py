"""Queries of the quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinkflow.plans import quality as Q
from rinkflow.registry.core import register
from rinkflow.registry.sql import part, using
from rinkflow.sources import roles

# Limits moved inside the rink and thresholds lowered, so that the test events give findings.
X, Y, MIN_N, GAP, PCT = 95.0, 40.0, 100, 3600.0, 3.0

part("shots3", ("pbp",), "SELECT * FROM pbp WHERE event_type IN ('shot-on-goal', 'goal', 'missed-shot')")
part("located", ("shots3",), "SELECT * FROM shots3 WHERE x_coord IS NOT NULL AND y_coord IS NOT NULL")
part("outside", ("located",), f"""
SELECT game_id, event_id, x_coord, y_coord, event_type, venue FROM located
WHERE x_coord < -{X} OR x_coord > {X} OR y_coord < -{Y} OR y_coord > {Y}""")
part("venue_stats", ("located",), f"""
SELECT venue, count(*) AS n_shots, avg(x_coord) AS mean_x, avg(y_coord) AS mean_y, stddev_samp(x_coord) AS std_x,
  stddev_samp(y_coord) AS std_y FROM located WHERE venue IS NOT NULL AND venue != '' GROUP BY venue HAVING count(*) >= {MIN_N}""")


def _biased(sigma: float) -> str:
    return f"""
SELECT venue, n_shots, round(mean_x, 2) AS mean_x, round(mean_y, 2) AS mean_y, round(std_x, 2) AS std_x,
  round(std_y, 2) AS std_y, round(zx, 2) AS x_zscore, round(zy, 2) AS y_zscore
FROM (SELECT *, abs(mean_x - avg(mean_x) OVER ()) / nullif(stddev_samp(mean_x) OVER (), 0) AS zx,
    abs(mean_y - avg(mean_y) OVER ()) / nullif(stddev_samp(mean_y) OVER (), 0) AS zy FROM venue_stats)
WHERE greatest(zx, zy) > {sigma}"""


part("biased1", ("venue_stats",), _biased(1.0))
part("biased2", ("venue_stats",), _biased(2.0))


def _anomalies(source: str, order: str) -> str:
    return f"""
SELECT game_id, period, event_id, prev_event, event_type AS curr_event,
  CAST(time_seconds - prev_seconds AS DOUBLE) AS time_gap_s,
  CASE WHEN time_seconds < prev_seconds THEN 'non_monotonic' ELSE 'impossible_sequence' END AS issue
FROM (SELECT *, lag(event_type) OVER w AS prev_event, lag(event_type, 2) OVER w AS prev2,
    lag(time_seconds) OVER w AS prev_seconds
  FROM {source} WINDOW w AS (PARTITION BY game_id, period ORDER BY {order}))
WHERE time_seconds < prev_seconds OR (time_seconds - prev_seconds < {GAP} AND prev_event IN ('faceoff', 'stoppage')
  AND event_type IN ('shot-on-goal', 'goal', 'missed-shot') AND prev2 IN ('shot-on-goal', 'goal', 'missed-shot'))"""


part("anomalies", ("pbp",), _anomalies("pbp", "event_id"))
part("anomalies_ref", ("pbp_plain",), _anomalies("pbp_plain", "time_in_period, event_id"))

part("holes", ("shots3",), "SELECT season, venue, x_coord IS NULL OR y_coord IS NULL AS hole FROM shots3")
part("missing", ("holes",), f"""
SELECT season, NULL::VARCHAR AS venue, count(*) AS total_shots, CAST(count_if(hole) AS BIGINT) AS null_coords,
  round(avg(hole::INT) * 100, 2) AS null_pct, 'season' AS scope FROM holes GROUP BY season
UNION ALL
SELECT season, venue, count(*), CAST(count_if(hole) AS BIGINT), round(avg(hole::INT) * 100, 2), 'season_arena'
FROM holes WHERE venue > '' GROUP BY season, venue HAVING avg(hole::INT) * 100 > {PCT}""")


@register("coord_bounds", using("outside") + "SELECT * FROM outside", "x_coord y_coord")
def coord_bounds(spark, path):
    return Q.check_bounds(roles.pbp(spark, path), X, Y).details


@register("arena_bias", using("biased1") + "SELECT * FROM biased1", "mean_x mean_y std_x std_y x_zscore y_zscore", 2)
def arena_bias(spark, path):
    return Q.check_venue_bias(roles.pbp(spark, path), MIN_N, 1.0).details


@register("sequence_anomalies", using("anomalies") + "SELECT * FROM anomalies")
def sequence_anomalies(spark, path):
    return Q.sequence_anomalies(roles.pbp(spark, path), GAP)


@register("sequence_anomalies_ref", using("anomalies_ref") + "SELECT * FROM anomalies_ref")
def sequence_anomalies_ref(spark, path):
    return Q.sequence_anomalies(roles.pbp(spark, path, pad=False), GAP, "reference")


@register("sequence_flagged", using("anomalies") + "SELECT game_id, count(*) AS n_anomalies FROM anomalies GROUP BY 1 HAVING count(*) > 0")
def sequence_flagged(spark, path):
    return Q.sequence_flagged(Q.sequence_anomalies(roles.pbp(spark, path), GAP), 0)


@register("missing_audit", using("missing") + "SELECT * FROM missing", "null_pct", 2)
def missing_audit(spark, path):
    return Q.check_missing(roles.pbp(spark, path), PCT).details


part("report", ("outside", "located", "shots3", "biased2", "anomalies", "missing"), f"""
SELECT 1 AS position, 'Coordinate Bounds' AS "check", bad = 0 AS passed,
  format('{{:,}}', bad) || ' out-of-bounds coordinates found (' || format('{{:.3f}}', bad * 100.0 / n)
  || '% of ' || format('{{:,}}', n) || ' shots with coordinates)' AS summary
FROM (SELECT (SELECT count(*) FROM outside) AS bad, (SELECT count(*) FROM located) AS n)
UNION ALL
SELECT 2, 'Arena Bias Detection', bad = 0,
  bad || ' arena(s) flagged for bias (>2.0 sigma from league mean) out of ' || n || ' total arenas'
FROM (SELECT (SELECT count(*) FROM biased2) AS bad,
  (SELECT count(DISTINCT venue) FROM shots3 WHERE venue IS NOT NULL AND venue != '') AS n)
UNION ALL
SELECT 3, 'Event Sequence Validation', bad = 0,
  n || ' temporal anomalies found, ' || bad || ' games with >5 anomalies'
FROM (SELECT (SELECT count(*) FROM (SELECT game_id FROM anomalies GROUP BY 1 HAVING count(*) > 5)) AS bad,
  (SELECT count(*) FROM anomalies) AS n)
UNION ALL
SELECT 4, 'Missing Data Audit', bad = 0 AND worst <= {PCT},
  'Max null-coordinate rate by season: ' || format('{{:.1f}}', worst) || '%. ' || bad
  || ' season/arena combinations exceed {PCT}% threshold.'
FROM (SELECT (SELECT count(*) FROM missing WHERE scope = 'season_arena') AS bad,
  (SELECT max(null_pct) FROM missing WHERE scope = 'season') AS worst)""")


@register("quality_report", using("report") + """
SELECT * FROM report UNION ALL SELECT 5, 'Result', bool_and(passed),
  CASE WHEN bool_and(passed) THEN 'ALL CHECKS PASSED' ELSE 'SOME CHECKS FAILED' END FROM report""")
def quality_report(spark, path):
    return Q.run_checks(roles.pbp(spark, path), MIN_N, GAP, PCT, x_limit=X, y_limit=Y)


@register("report_preview", using("outside") + """
SELECT game_id, event_id, (SELECT count(*) FROM outside) - 10 AS more_rows FROM outside ORDER BY game_id, event_id LIMIT 10""")
def report_preview(spark, path):
    details = Q.check_bounds(roles.pbp(spark, path), X, Y).details.select("game_id", "event_id")
    return Q.preview(details, ["game_id", "event_id"], 10).withColumn("more_rows", F.col("more_rows").cast("bigint"))
