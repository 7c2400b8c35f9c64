"""Queries of calibration and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinkflow.operators import ranks
from rinkflow.plans import metrics as M
from rinkflow.plans import scoring as S
from rinkflow.registry.core import register
from rinkflow.registry.features import scored
from rinkflow.registry.sql import part, using
from rinkflow.session import fresh_path
from rinkflow.sources import datasets, roles

part("factors", ("scored",), "SELECT season, sum(is_goal) / sum(xg_prob) AS calib_factor FROM scored GROUP BY season")
part("calibrated", ("factors",), "SELECT s.* EXCLUDE (xg_prob), xg_prob * calib_factor AS xg_prob FROM scored s JOIN factors USING (season)")
part("factors_li", ("scored_li",), "SELECT season, sum(is_goal) / sum(xg_prob) AS calib_factor FROM scored_li GROUP BY season")


@register("calibration_factor", using("factors") + "SELECT * FROM factors", "calib_factor")
def calibration_factor(spark, path):
    return S.calibration_factor(scored(spark, path))


@register("calibrate_season", using("calibrated") + "SELECT event_id, season, xg_prob FROM calibrated", "xg_prob")
def calibrate_season(spark, path):
    return S.calibrate(scored(spark, path)).select("event_id", "season", "xg_prob")


@register("calibrate_season_volume", using("factors_li") + """
SELECT goalie_id, s.season, sum(xg_prob * calib_factor) AS expected, CAST(sum(is_goal) AS BIGINT) AS goals
FROM scored_li s JOIN factors_li USING (season) GROUP BY 1, 2""", "expected", 4)
def calibrate_season_volume(spark, path):
    sums = S.calibrate(roles.scored_lineitem(spark, path)).groupBy("goalie_id", "season")
    return sums.agg(F.sum("xg_prob").alias("expected"), F.sum("is_goal").cast("bigint").alias("goals"))


@register("recalibrate_check", using("scored", "calibrated") + """
SELECT 'original' AS version, sum(xg_prob) AS expected, CAST(sum(is_goal) AS BIGINT) AS goals FROM scored
UNION ALL SELECT 'calibrated', sum(xg_prob), CAST(sum(is_goal) AS BIGINT) FROM calibrated""", "expected", 4)
def recalibrate_check(spark, path):
    return S.recalibrate_check(scored(spark, path))


@register("recalibrate_rewrite", using("calibrated") + "SELECT event_id, season, is_goal, xg_prob FROM calibrated", "xg_prob")
def recalibrate_rewrite(spark, path):
    rows = scored(spark, path).select("event_id", "season", "is_goal", "xg_prob")
    return S.recalibrate(datasets.rewrite_dataset(rows, "uncalibrated"))


@register("eval_log_loss", using("scored_li") + """
SELECT avg(-(is_goal * ln(xg_prob) + (1 - is_goal) * ln(1 - xg_prob))) AS log_loss FROM scored_li""", "log_loss")
def eval_log_loss(spark, path):
    return roles.scored_lineitem(spark, path).agg(S.log_loss("is_goal", "xg_prob").alias("log_loss"))


@register("eval_brier", using("scored_li") + "SELECT avg((xg_prob - is_goal) * (xg_prob - is_goal)) AS brier_score FROM scored_li", "brier_score")
def eval_brier(spark, path):
    return roles.scored_lineitem(spark, path).agg(S.brier("is_goal", "xg_prob").alias("brier_score"))


_AUC = """
SELECT (sum(pos * (before + (n + 1) / 2.0)) - sum(pos) * (sum(pos) + 1) / 2.0) / (sum(pos) * (sum(n) - sum(pos))) AS auc
FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY xg_prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT xg_prob, count(*) AS n, sum(is_goal) AS pos FROM {} GROUP BY 1))"""


@register("eval_auc", using("scored_li") + _AUC.format("scored_li"), "auc")
def eval_auc(spark, path):
    return S.auc(roles.scored_lineitem(spark, path), "is_goal", "xg_prob")


@register("eval_report", using("scored") + f"""
SELECT avg(-(is_goal * ln(xg_prob) + (1 - is_goal) * ln(1 - xg_prob))) AS log_loss,
  avg((xg_prob - is_goal) * (xg_prob - is_goal)) AS brier_score, ({_AUC.format("scored")}) AS auc FROM scored""", "log_loss brier_score auc", 4)
def eval_report(spark, path):
    return S.evaluate(scored(spark, path), "is_goal", "xg_prob")


@register("metrics_report", using("scored") + f"""
SELECT avg(-(is_goal * ln(xg_prob) + (1 - is_goal) * ln(1 - xg_prob))) AS log_loss,
  avg((xg_prob - is_goal) * (xg_prob - is_goal)) AS brier_score, ({_AUC.format("scored")}) AS auc FROM scored""", "log_loss brier_score auc", 4)
def metrics_report(spark, path):
    """The report of a model, written as JSON and read again."""
    target = fresh_path(spark, "report")
    datasets.write_metrics(S.evaluate(scored(spark, path), "is_goal", "xg_prob"), target)
    return spark.read.schema("log_loss double, brier_score double, auc double").json(target)


_BIN = " + ".join(f"CAST(xg_prob > CAST('{e!r}' AS DOUBLE) AS INT)" for e in S.bin_edges())


@register("eval_calibration", using("scored_li") + f"""
SELECT {_BIN} AS bin, avg(is_goal) AS prob_true, avg(xg_prob) AS prob_pred, count(*) AS n FROM scored_li GROUP BY 1""", "prob_true prob_pred")
def eval_calibration(spark, path):
    return S.calibration_curve(roles.scored_lineitem(spark, path), "is_goal", "xg_prob")


@register("class_weights", using("scored_li") + """
SELECT is_goal, (SELECT count(*) FROM scored_li) / (2.0 * count(*)) AS weight FROM scored_li GROUP BY 1""", "weight")
def class_weights(spark, path):
    return S.class_weights(roles.scored_lineitem(spark, path), "is_goal")


part("sized", ("scored_li",), """
SELECT season, n, row_number() OVER (ORDER BY n DESC, season DESC) AS i
FROM (SELECT season, count(*) AS n FROM scored_li GROUP BY season)""")
part("dealt", ("sized",), """
SELECT CAST(0 AS BIGINT) AS i, [0, 0, 0, 0, 0]::BIGINT[] AS load, CAST(NULL AS BIGINT) AS season, CAST(NULL AS BIGINT) AS fold
UNION ALL
SELECT s.i, list_transform(d.load, lambda v, j: CASE WHEN j = list_position(d.load, list_min(d.load)) THEN v + s.n ELSE v END),
  s.season, list_position(d.load, list_min(d.load)) - 1
FROM dealt d JOIN sized s ON s.i = d.i + 1""")


@register("group_folds", using("dealt") + "SELECT season, CAST(fold AS BIGINT) AS fold FROM dealt WHERE i > 0")
def group_folds(spark, path):
    return S.group_folds(roles.scored_lineitem(spark, path), "season", 5)


@register("stratified_split", using("scored") + """
SELECT event_id, is_goal, row_number() OVER (PARTITION BY is_goal ORDER BY event_id)
  <= round(count(*) OVER (PARTITION BY is_goal) * 0.2) AS is_test FROM scored""")
def stratified_split(spark, path):
    rows = scored(spark, path).select("event_id", "is_goal")
    return S.stratified_split(rows, "is_goal", "event_id", 0.2, order="event_id")


@register("stratified_split_hashed", using("scored") + """
SELECT is_goal, t.is_test, CASE WHEN t.is_test THEN held ELSE n - held END AS n
FROM (SELECT is_goal, count(*) AS n, CAST(round(0.2 * count(*)) AS BIGINT) AS held FROM scored GROUP BY 1), (VALUES (true), (false)) t(is_test)""")
def stratified_split_hashed(spark, path):
    rows = scored(spark, path).select("event_id", "is_goal")
    split = S.stratified_split(rows, "is_goal", "event_id", 0.2)
    return split.groupBy("is_goal", "is_test").agg(F.count(F.lit(1)).alias("n"))


@register("sample_n")
def sample_n(spark, path):
    rows = roles.table(spark, path, "orders").select("o_orderkey", "o_totalprice")
    return ranks.sample_n(rows, "o_orderkey", 1000)


@register("shot_sample")
def shot_sample(spark, path):
    rows = scored(spark, path).select("event_id", "adjusted_x", "adjusted_y", "is_goal")
    return ranks.sample_n(rows, "event_id", 2000)


def _sample_totals(sample, table, key):
    """What holds of any sample: its rows, their distinct keys, and how many of them the table has."""
    found = sample.join(table.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("n_found"))
    sums = sample.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys"))
    return sums.withColumn("n_found", found.scalar())


@register("sample_n_totals", "SELECT least(1000, count(*)) AS n_rows, least(1000, count(*)) AS n_keys, least(1000, count(*)) AS n_found FROM orders")
def sample_n_totals(spark, path):
    return _sample_totals(sample_n(spark, path), roles.table(spark, path, "orders"), "o_orderkey")


@register("shot_sample_totals", using("scored") + "SELECT least(2000, count(*)) AS n_rows, least(2000, count(*)) AS n_keys, least(2000, count(*)) AS n_found FROM scored")
def shot_sample_totals(spark, path):
    return _sample_totals(shot_sample(spark, path), scored(spark, path), "event_id")


@register("factorize", using("scored_li") + """
SELECT goalie_id, first_seen, row_number() OVER (ORDER BY first_seen) - 1 AS code
FROM (SELECT goalie_id, min(game_id * 1000000 + goalie_id) AS first_seen FROM scored_li GROUP BY 1)""")
def factorize(spark, path):
    rows = roles.scored_lineitem(spark, path).withColumn("seen", F.col("game_id") * 1000000 + F.col("goalie_id"))
    return ranks.dense_codes(rows, "goalie_id", "seen")


@register("group_size_stats", using("scored_li") + """
SELECT count(*) AS n_groups, avg(n) AS mean_n, min(n) AS min_n, max(n) AS max_n
FROM (SELECT team_id, season, count(*) AS n FROM scored_li GROUP BY 1, 2)""", "mean_n")
def group_size_stats(spark, path):
    return M.group_size_stats(roles.scored_lineitem(spark, path), ["team_id", "season"])


@register("semi_min_rows", using("scored_li") + """
SELECT goalie_id, game_id, is_goal FROM scored_li
WHERE goalie_id IN (SELECT goalie_id FROM scored_li GROUP BY 1 HAVING count(*) >= 600)""")
def semi_min_rows(spark, path):
    return M.semi_min_rows(roles.scored_lineitem(spark, path), "goalie_id", 600).select("goalie_id", "game_id", "is_goal")


@register("partitioned_roundtrip", using("scored") + "SELECT season, count(*) AS n, sum(xg_prob) AS expected FROM scored GROUP BY season", "expected", 4)
def partitioned_roundtrip(spark, path):
    target = fresh_path(spark, "roundtrip")
    datasets.write_dataset(scored(spark, path).select("event_id", "season", "xg_prob"), target)
    back = datasets.read_union_by_name(spark, target)
    return back.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum("xg_prob").alias("expected"))
