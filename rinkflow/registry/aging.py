"""Queries of ages, the ageing curve, the filter and its projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinkflow.functions.numeric import obs_noise
from rinkflow.operators import interpolation as I
from rinkflow.plans import aging as A
from rinkflow.plans import kalman as K
from rinkflow.plans import metrics as M
from rinkflow.registry import metrics as _metric_parts  # noqa: F401  (its SQL parts are used below)
from rinkflow.registry.core import register
from rinkflow.registry.features import scored
from rinkflow.registry.sql import part, using
from rinkflow.sources import roles

part("mean_curve", ("curve",), "SELECT x, avg(y) AS y FROM curve GROUP BY x")
part("segs", ("mean_curve",), """
SELECT x AS x0, lead(x) OVER (ORDER BY x) AS x1, y AS y0, lead(y) OVER (ORDER BY x) AS y1 FROM mean_curve""")
part("bounded", ("segs",), """
SELECT *, CASE WHEN x0 = (SELECT min(x) FROM mean_curve) THEN -1e300 ELSE x0 END AS a,
  CASE WHEN x1 = (SELECT max(x) FROM mean_curve) THEN 1e300 ELSE x1 END AS b FROM segs WHERE x1 IS NOT NULL""")
# Drift of the mean curve: change over the next unit.
part("drift", ("mean_curve", "bounded"), """
SELECT x AS age, (SELECT y0 + (y1 - y0) / (x1 - x0) * (m.x + 1 - x0) FROM bounded WHERE m.x + 1 >= a AND m.x + 1 < b) - y AS yearly_drift
FROM mean_curve m""")
part("drift_segs", ("drift",), """
SELECT *, CASE WHEN x0 = (SELECT min(age) FROM drift) THEN -1e300 ELSE x0 END AS a,
  CASE WHEN x1 = (SELECT max(age) FROM drift) THEN 1e300 ELSE x1 END AS b
FROM (SELECT age AS x0, lead(age) OVER (ORDER BY age) AS x1, yearly_drift AS y0, lead(yearly_drift) OVER (ORDER BY age) AS y1 FROM drift)
WHERE x1 IS NOT NULL""")


def mean_curve(spark, path):
    return I.curve_sums(roles.curve(spark, path), "x", "y")


def drift(spark, path):
    return I.forward_diff(mean_curve(spark, path), "x", "y", "yearly_drift").select(F.col("x").alias("age"), "yearly_drift")


def steps(spark, path, compat="fixed"):
    # Yearly drift of the test curve is far larger than a talent, so it is scaled down.
    small = drift(spark, path).withColumn("yearly_drift", F.col("yearly_drift") / 100)
    return K.steps(roles.series(spark, path), small, compat=compat)


part("aged", ("series",), """
SELECT *, lag(age) OVER (PARTITION BY goalie_id ORDER BY season) AS prev_age,
  row_number() OVER (PARTITION BY goalie_id ORDER BY season) AS i, count(*) OVER (PARTITION BY goalie_id) AS n FROM series""")
part("steps", ("aged", "drift_segs"), f"""
SELECT s.*, age - prev_age AS age_step, {K.BASE_NOISE!r}::DOUBLE * greatest(1800.0::DOUBLE / greatest(shots_faced, 1), 1.0) AS noise,
  coalesce((y0 + (y1 - y0) / (x1 - x0) * (prev_age - x0)) / 100 * (age - prev_age), 0) AS "offset"
FROM aged s LEFT JOIN drift_segs ON prev_age >= a AND prev_age < b""")
part("steps_ref", ("steps",), """
SELECT * EXCLUDE ("offset"), coalesce(lag("offset") OVER (PARTITION BY goalie_id ORDER BY season), 0) AS "offset" FROM steps""")


def _filter(source: str, name: str) -> str:
    return f"""
SELECT goalie_id, season, i, m0 + p0 / (p0 + noise) * (talent - m0) AS mean, (1 - p0 / (p0 + noise)) * p0 AS var
FROM (SELECT *, 0.0::DOUBLE AS m0, 0.001::DOUBLE AS p0 FROM {source} WHERE i = 1 AND n >= 2)
UNION ALL
SELECT s.goalie_id, s.season, s.i,
  f.mean + s."offset" + (f.var + 1e-5) / (f.var + 1e-5 + s.noise) * (s.talent - f.mean - s."offset"),
  (1 - (f.var + 1e-5) / (f.var + 1e-5 + s.noise)) * (f.var + 1e-5)
FROM {name} f JOIN {source} s ON s.goalie_id = f.goalie_id AND s.i = f.i + 1"""


part("traded", ("drift_segs",), f"""
SELECT s.*, coalesce((y0 + (y1 - y0) / (x1 - x0) * (prev_age - x0)) / 100 * (age - prev_age), 0) AS "offset"
FROM (
  SELECT *, {K.BASE_NOISE!r}::DOUBLE * greatest(1800.0::DOUBLE / greatest(shots_faced, 1), 1.0) AS noise, lag(age) OVER w AS prev_age,
    row_number() OVER w AS i, count(*) OVER (PARTITION BY goalie_id) AS n
  FROM (
    SELECT CAST(c_nationkey AS BIGINT) AS goalie_id, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS team_id,
      CAST(year(o_orderdate) AS BIGINT) AS season, avg(o_totalprice) / 1e6 AS talent, count(*) AS shots_faced,
      CAST(year(o_orderdate) - 1975 + c_nationkey % 5 AS DOUBLE) AS age
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, 2, year(o_orderdate))
  WINDOW w AS (PARTITION BY goalie_id ORDER BY season, team_id)) s
LEFT JOIN drift_segs ON prev_age >= a AND prev_age < b""")
part("filtered_traded", ("traded",), _filter("traded", "filtered_traded"))
part("filtered", ("steps",), _filter("steps", "filtered"))
part("filtered_ref", ("steps_ref",), _filter("steps_ref", "filtered_ref"))


@register("age_steps", using("aged") + "SELECT goalie_id, season, age - prev_age AS age_step FROM aged")
def age_steps(spark, path):
    return steps(spark, path).select("goalie_id", "season", "age_step")


@register("obs_noise", using("steps") + "SELECT goalie_id, season, noise * 1e6 AS noise_e6 FROM steps", "noise_e6")
def noise(spark, path):
    n = obs_noise(K.BASE_NOISE, F.col("shots_faced"))
    return roles.series(spark, path).select("goalie_id", "season", (n * 1e6).alias("noise_e6"))


@register("kalman_filter", using("filtered") + "SELECT goalie_id, season, mean AS kalman_talent, var * 1e6 AS variance_e6 FROM filtered", "kalman_talent variance_e6")
def kalman_filter(spark, path):
    out = K.kalman_filter(steps(spark, path))
    return out.select("goalie_id", "season", "kalman_talent", (F.col("variance") * 1e6).alias("variance_e6"))


@register("kalman_filter_ref", using("filtered_ref") + "SELECT goalie_id, season, mean AS kalman_talent, var * 1e6 AS variance_e6 FROM filtered_ref", "kalman_talent variance_e6")
def kalman_filter_ref(spark, path):
    out = K.kalman_filter(steps(spark, path, "reference"))
    return out.select("goalie_id", "season", "kalman_talent", (F.col("variance") * 1e6).alias("variance_e6"))


@register("kalman_trajectory", using("filtered") + """
SELECT goalie_id, season, age, shots_faced, talent AS observed_talent, mean AS kalman_talent, sqrt(var) AS kalman_uncertainty
FROM filtered JOIN series USING (goalie_id, season)""", "observed_talent kalman_talent kalman_uncertainty")
def kalman_trajectory(spark, path):
    return K.trajectory(roles.series(spark, path), K.kalman_filter(steps(spark, path)))


def traded_steps(spark, path):
    small = drift(spark, path).withColumn("yearly_drift", F.col("yearly_drift") / 100)
    return K.steps(roles.traded_series(spark, path), small)


@register("kalman_traded", using("filtered_traded") + """
SELECT goalie_id, team_id, season, CAST(i AS BIGINT) AS step, talent AS observed_talent, mean AS kalman_talent, sqrt(var) AS kalman_uncertainty
FROM filtered_traded f JOIN traded t USING (goalie_id, season, i)""", "observed_talent kalman_talent kalman_uncertainty")
def kalman_traded(spark, path):
    """Filter and trajectory of series with several teams in one season."""
    series = K.number_steps(roles.traded_series(spark, path))
    rows = K.trajectory(series, K.kalman_filter(traded_steps(spark, path)), keep=("team_id", "step"))
    return rows.select("goalie_id", "team_id", "season", "step", "observed_talent", "kalman_talent", "kalman_uncertainty")


@register("kalman_traded_last", using("filtered_traded") + """
SELECT goalie_id, season AS latest_season, round_even(mean, 6) AS current_filtered_talent_per_shot, round_even(sqrt(var), 6) AS current_uncertainty
FROM filtered_traded JOIN traded USING (goalie_id, season, i) WHERE i = n""", "current_filtered_talent_per_shot current_uncertainty")
def kalman_traded_last(spark, path):
    """The projection of such a series starts from its last step."""
    small = drift(spark, path).withColumn("yearly_drift", F.col("yearly_drift") / 100)
    found = K.projections(roles.traded_series(spark, path), K.kalman_filter(traded_steps(spark, path)), small)
    return found.select("goalie_id", "latest_season", "current_filtered_talent_per_shot", "current_uncertainty")


def _at(age: str) -> str:
    return f"(SELECT (y0 + (y1 - y0) / (x1 - x0) * ({age} - x0)) / 100 FROM drift_segs WHERE {age} >= a AND {age} < b)"


part("projected", ("filtered", "drift_segs"), f"""
SELECT goalie_id, season AS latest_season, round(age, 1) AS current_age, shots_faced AS latest_shots_faced,
  round_even(mean, 6) AS current_filtered_talent_per_shot, round_even(sqrt(var), 6) AS current_uncertainty,
  round_even(mean + d0, 6) AS proj_1yr_talent_per_shot, round_even(mean + d0 - 1.28 * sqrt(var + 1e-5), 6) AS proj_1yr_ci_lower,
  round_even(mean + d0 + 1.28 * sqrt(var + 1e-5), 6) AS proj_1yr_ci_upper, round_even(mean + d0 + d1 + d2, 6) AS proj_3yr_talent_per_shot,
  CAST(goalie_id AS VARCHAR) AS "Goalie"
FROM (SELECT f.*, s.age, s.shots_faced, {_at('s.age')} AS d0, {_at('s.age + 1')} AS d1, {_at('s.age + 2')} AS d2
  FROM filtered f JOIN steps s USING (goalie_id, season) WHERE f.i = s.n)""")


def projected(spark, path):
    small = drift(spark, path).withColumn("yearly_drift", F.col("yearly_drift") / 100)
    return K.projections(roles.series(spark, path), K.kalman_filter(steps(spark, path)), small)


_PROJ = "current_filtered_talent_per_shot current_uncertainty proj_1yr_talent_per_shot proj_1yr_ci_lower proj_1yr_ci_upper proj_3yr_talent_per_shot"


@register("kalman_projection", using("projected") + "SELECT * FROM projected", _PROJ)
def kalman_projection(spark, path):
    return projected(spark, path)


@register("projection_ranking", using("projected") + """
SELECT row_number() OVER (ORDER BY proj_1yr_talent_per_shot DESC, goalie_id) AS rank, goalie_id, "Goalie", current_age, latest_shots_faced,
  current_filtered_talent_per_shot * 30 AS current_per_game, proj_1yr_talent_per_shot * 30 AS proj_per_game,
  proj_1yr_ci_lower * 30 AS ci_lower_per_game, proj_1yr_ci_upper * 30 AS ci_upper_per_game
FROM projected WHERE latest_season = 2001 ORDER BY rank LIMIT 15""", "current_per_game proj_per_game ci_lower_per_game ci_upper_per_game", 5)
def projection_ranking(spark, path):
    return K.projection_ranking(projected(spark, path), 2001)


part("forecast", ("filtered", "steps"), """
SELECT * FROM (SELECT f.mean, s.talent, lead(s.talent) OVER w AS actual, lead(s."offset") OVER w AS next_offset,
    (s.talent * s.shots_faced + coalesce(lag(s.talent * s.shots_faced, 1) OVER w, 0) + coalesce(lag(s.talent * s.shots_faced, 2) OVER w, 0))
    / (s.shots_faced + coalesce(lag(s.shots_faced, 1) OVER w, 0) + coalesce(lag(s.shots_faced, 2) OVER w, 0)) AS weighted
  FROM filtered f JOIN steps s USING (goalie_id, season) WINDOW w AS (PARTITION BY s.goalie_id ORDER BY s.season)) WHERE actual IS NOT NULL""")


@register("projection_backtest", using("forecast") + """
SELECT 'kalman' AS method, count(*) AS n, sqrt(avg((actual - mean - next_offset) ** 2)) AS rmse FROM forecast
UNION ALL SELECT 'last_season', count(*), sqrt(avg((actual - talent) ** 2)) FROM forecast
UNION ALL SELECT 'weighted_3yr', count(*), sqrt(avg((actual - weighted) ** 2)) FROM forecast""", "rmse")
def projection_backtest(spark, path):
    return K.projection_backtest(steps(spark, path))


@register("interp_linear", using("bounded") + """
SELECT l_orderkey, l_partkey, l_quantity * 1.3::DOUBLE - 3.1::DOUBLE AS x_at, y0 + (y1 - y0) / (x1 - x0) * (l_quantity * 1.3::DOUBLE - 3.1::DOUBLE - x0) AS value
FROM lineitem LEFT JOIN bounded ON l_quantity * 1.3::DOUBLE - 3.1::DOUBLE >= a AND l_quantity * 1.3::DOUBLE - 3.1::DOUBLE < b""", "x_at value", 4)
def interp_linear(spark, path):
    at = F.col("l_quantity") * F.lit(1.3) - F.lit(3.1)
    points = roles.table(spark, path, "lineitem").select("l_orderkey", "l_partkey", at.alias("x_at"))
    return I.interpolate_linear(points, F.col("x_at"), mean_curve(spark, path), "x", "y", "value")


@register("yearly_drift", using("drift") + "SELECT * FROM drift", "yearly_drift")
def yearly_drift(spark, path):
    return drift(spark, path)


@register("age_grid", using("curve") + """
SELECT g.x, count(c.x) AS n FROM (SELECT i, lo + i * ((hi - lo) / 220) AS x FROM (SELECT min(x) AS lo, max(x) AS hi FROM curve), range(221) t(i)) g
LEFT JOIN (SELECT x, CAST(round((x - (SELECT min(x) FROM curve)) / ((SELECT max(x) - min(x) FROM curve) / 220)) AS BIGINT) AS i FROM curve) c USING (i)
GROUP BY 1""", "x")
def age_grid(spark, path):
    rows = roles.curve(spark, path)
    lo, hi = rows.agg(F.min("x"), F.max("x")).first()
    step = (hi - lo) / 220
    spots = I.grid(spark, lo, hi, 221).withColumn("i", F.round((F.col("x") - lo) / step).cast("bigint"))
    counts = rows.groupBy(F.round((F.col("x") - lo) / step).cast("bigint").alias("i")).agg(F.count(F.lit(1)).alias("n"))
    return spots.join(counts, "i", "left").select("x", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


part("grid", ("mean_curve", "bounded"), """
SELECT age, (SELECT y0 + (y1 - y0) / (x1 - x0) * (g.age - x0) FROM bounded WHERE g.age >= a AND g.age < b) AS expected_true_talent
FROM (SELECT 5.0::DOUBLE + i * ((55.0::DOUBLE - 5.0) / 220) AS age FROM range(221) t(i)) g""")
part("grid_segs", ("grid",), """
SELECT *, CASE WHEN x0 = (SELECT min(age) FROM grid) THEN -1e300 ELSE x0 END AS a,
  CASE WHEN x1 = (SELECT max(age) FROM grid) THEN 1e300 ELSE x1 END AS b
FROM (SELECT age AS x0, lead(age) OVER (ORDER BY age) AS x1, expected_true_talent AS y0,
    lead(expected_true_talent) OVER (ORDER BY age) AS y1 FROM grid) WHERE x1 IS NOT NULL""")
part("grid_drift", ("grid_segs",), """
SELECT round(age, 1) AS age, expected_true_talent, (SELECT y0 + (y1 - y0) / (x1 - x0) * (g.age + 1 - x0)
  FROM grid_segs WHERE g.age + 1 >= a AND g.age + 1 < b) - expected_true_talent AS yearly_drift FROM grid g""")


@register("age_curve_grid", using("grid_drift") + "SELECT * FROM grid_drift", "age expected_true_talent yearly_drift", 5)
def age_curve_grid(spark, path):
    return A.age_curve_grid(mean_curve(spark, path), "x", "y", 5.0, 55.0)


@register("peak_age", using("grid_drift") + """
SELECT * FROM (SELECT 'peak' AS kind, * FROM grid_drift ORDER BY expected_true_talent DESC LIMIT 1)
UNION ALL SELECT 'sample', * FROM grid_drift WHERE age IN (10, 20, 30, 40, 50)""", "age expected_true_talent yearly_drift", 5)
def peak_age(spark, path):
    return A.peak_age(A.age_curve_grid(mean_curve(spark, path), "x", "y", 5.0, 55.0), (10, 20, 30, 40, 50))


part("dense", ("curve",), "SELECT x, count(*) AS n, sum(y) AS sy FROM curve GROUP BY x")
part("width", ("dense", "curve"), """
SELECT x, min(d) AS h FROM (
  SELECT t.x, abs(s.x - t.x) AS d, sum(s.n) OVER (PARTITION BY t.x ORDER BY abs(s.x - t.x)
    RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM dense t CROSS JOIN dense s)
WHERE seen >= (SELECT CAST(floor(0.3 * count(*) + 1e-10) AS BIGINT) FROM curve) GROUP BY x""")


@register("loess_local_linear", using("width") + """
SELECT x, (c * p - b * q) / (a * c - b * b) AS fitted FROM (
  SELECT t.x, sum(w * n) AS a, sum(w * n * d) AS b, sum(w * n * d * d) AS c, sum(w * sy) AS p, sum(w * sy * d) AS q
  FROM (SELECT t.x, s.n, s.sy, s.x - t.x AS d, (1 - (abs(s.x - t.x) / h) ** 3) ** 3 AS w
    FROM width t JOIN dense s ON abs(s.x - t.x) <= h) t GROUP BY t.x)""", "fitted")
def loess_local_linear(spark, path):
    return I.loess(roles.curve(spark, path), "x", "y", 0.3, 0)


def _robust_part(i):
    """One fit, and the weights that its residuals give the rows of the next one."""
    dense = "dense" if i == 0 else f"dense{i}"
    part(f"fit{i}", ("width", dense), f"""
SELECT x, CASE WHEN a * c - b * b <= 1e-12 * a * a * greatest(h * h, 1e-300) THEN p / a ELSE (c * p - b * q) / (a * c - b * b) END AS fitted
FROM (SELECT x, max(h) AS h, sum(w * n) AS a, sum(w * n * d) AS b, sum(w * n * d * d) AS c, sum(w * sy) AS p, sum(w * sy * d) AS q
  FROM (SELECT t.x, t.h, s.n, s.sy, s.x - t.x AS d, (1 - (abs(s.x - t.x) / h) ** 3) ** 3 AS w
    FROM width t JOIN {dense} s ON abs(s.x - t.x) <= h) t GROUP BY x) t""")
    part(f"dense{i + 1}", ("curve", f"fit{i}"), f"""
SELECT x, sum(d) AS n, sum(d * y) AS sy FROM (
  SELECT x, y, CASE WHEN r < 6 * scale THEN (1 - (r / (6 * scale)) * (r / (6 * scale))) * (1 - (r / (6 * scale)) * (r / (6 * scale))) ELSE 0 END AS d
  FROM (SELECT x, y, r, median(r) OVER () AS scale FROM (SELECT c.x, c.y, abs(c.y - f.fitted) AS r FROM curve c JOIN fit{i} f ON f.x = c.x) z) z) z
GROUP BY x""")


for _i in range(4):
    _robust_part(_i)


@register("loess_robust", using("fit3") + "SELECT x, fitted FROM fit3", "fitted", 4)
def loess_robust(spark, path):
    return I.loess(roles.curve(spark, path), "x", "y", 0.3, 3)


part("effects0", ("team_season",), """
SELECT team_id, season, 0.001::DOUBLE * (team_id - 10) AS dsis_team_defense_impact_per_shot
FROM (SELECT DISTINCT team_id, season FROM team_season) WHERE team_id % 5 != 0""")
part("births0", ("team_season",), """
SELECT goalie_id, make_date(CAST(1985 + goalie_id % 12 AS INT), CAST(1 + goalie_id % 9 AS INT), CAST(1 + goalie_id % 27 AS INT)) AS birth_date
FROM (SELECT DISTINCT goalie_id FROM team_season) WHERE goalie_id % 4 != 0""")
part("talent0", ("team_season", "effects0"), """
SELECT t.*, coalesce(dsis_team_defense_impact_per_shot, 0) AS dsis_team_defense_impact_per_shot,
  raw_gsax_2_0 / shots_faced AS raw_gsax_per_shot,
  raw_gsax_2_0 / shots_faced - coalesce(dsis_team_defense_impact_per_shot, 0) AS seasonal_true_talent
FROM team_season t LEFT JOIN effects0 USING (team_id, season)""")
part("ages0", ("talent0", "births0"), """
SELECT goalie_id, team_id, season, seasonal_true_talent, birth_date, season // 10000 AS season_start_year,
  make_date(CAST(season // 10000 AS INT), 10, 1) AS season_start_date,
  date_diff('day', birth_date, make_date(CAST(season // 10000 AS INT), 10, 1)) / 365.25::DOUBLE AS exact_age
FROM talent0 JOIN births0 USING (goalie_id)""")


def talents(spark, path):
    rows = M.goalie_team_season(scored(spark, path), 3)
    effects = (
        rows.select("team_id", "season")
        .distinct()
        .filter(F.col("team_id") % 5 != 0)
        .withColumn("dsis_team_defense_impact_per_shot", F.lit(0.001) * (F.col("team_id") - 10))
    )
    return rows, A.true_talent(rows, effects)


def births(rows):
    g = F.col("goalie_id")
    date = F.make_date((1985 + g % 12).cast("int"), (1 + g % 9).cast("int"), (1 + g % 27).cast("int"))
    return rows.select("goalie_id").distinct().filter(g % 4 != 0).withColumn("birth_date", date)


@register("true_talent", using("talent0") + "SELECT goalie_id, team_id, season, raw_gsax_per_shot, seasonal_true_talent FROM talent0", "raw_gsax_per_shot seasonal_true_talent")
def true_talent(spark, path):
    return talents(spark, path)[1].select("goalie_id", "team_id", "season", "raw_gsax_per_shot", "seasonal_true_talent")


@register("exact_age", using("ages0") + "SELECT * FROM ages0", "exact_age seasonal_true_talent")
def exact_age(spark, path):
    rows, talent = talents(spark, path)
    return A.exact_age(talent, births(rows)).select(
        "goalie_id", "team_id", "season", "seasonal_true_talent", "birth_date", "season_start_year", "season_start_date", "exact_age"
    )


@register("age_filter", using("ages0") + "SELECT goalie_id, team_id, season, exact_age FROM ages0 WHERE exact_age BETWEEN 25 AND 33", "exact_age")
def age_filter(spark, path):
    rows, talent = talents(spark, path)
    return A.age_filter(A.exact_age(talent, births(rows)), 25, 33).select("goalie_id", "team_id", "season", "exact_age")


@register("age_curve")
def age_curve(spark, path):
    rows, talent = talents(spark, path)
    return A.age_curve(A.exact_age(talent, births(rows)))


@register("resolve_fallback", using("team_season", "births0") + """
SELECT goalie_id, coalesce(a.birth_date, b.birth_date) AS birth_date FROM (SELECT DISTINCT goalie_id FROM team_season)
LEFT JOIN births0 a USING (goalie_id)
LEFT JOIN (SELECT DISTINCT goalie_id, DATE '1990-06-01' AS birth_date FROM team_season WHERE goalie_id % 3 = 0) b USING (goalie_id)
WHERE coalesce(a.birth_date, b.birth_date) IS NOT NULL""")
def resolve_fallback(spark, path):
    rows = M.goalie_team_season(scored(spark, path), 3)
    ids = rows.select("goalie_id").distinct()
    fallback = ids.filter(F.col("goalie_id") % 3 == 0).withColumn("birth_date", F.to_date(F.lit("1990-06-01")))
    return A.resolve_fallback(ids, births(rows), fallback, "goalie_id", "birth_date")
