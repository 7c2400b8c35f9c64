"""Queries of the models and the effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinkflow.operators.ranks import falling
from rinkflow.plans import effects as E
from rinkflow.plans import encoding as N
from rinkflow.plans import models as L
from rinkflow.plans import scoring as S
from rinkflow.plans.quality import union_scoped
from rinkflow.registry.core import register
from rinkflow.registry.features import features
from rinkflow.registry.sql import part, using
from rinkflow.session import cut_lineage, fresh_path
from rinkflow.sources import roles
from rinkflow.sources.datasets import rewrite_dataset

part("li_cells", ("scored_li",), """
SELECT goalie_id, team_id, season, sum(xg_prob - is_goal) / count(*) AS y, CAST(count(*) AS DOUBLE) AS w FROM scored_li GROUP BY 1, 2, 3""")
part("one_way", ("li_cells",), "SELECT goalie_id, sum(w * y) / (sum(w) + 25.0::DOUBLE) AS a FROM li_cells GROUP BY 1")


def _cells(spark, path):
    return roles.scored_lineitem(spark, path).groupBy("goalie_id", "team_id", "season").agg(
        (F.sum(F.col("xg_prob") - F.col("is_goal")) / F.count(F.lit(1))).alias("y"), F.count(F.lit(1)).cast("double").alias("w")
    )


@register("shrinkage_one_way", using("one_way") + "SELECT goalie_id, a AS effect FROM one_way", "effect", 5)
def shrinkage_one_way(spark, path):
    return E.shrinkage_one_way(_cells(spark, path), ["goalie_id"], F.col("y"), F.col("w"), 25.0).select("goalie_id", "effect")


@register("shrinkage_sweep2", using("one_way") + """
SELECT team_id, season, sum(w * (y - a)) / (sum(w) + 40.0::DOUBLE) AS b FROM li_cells JOIN one_way USING (goalie_id) GROUP BY 1, 2""", "b", 5)
def shrinkage_sweep2(spark, path):
    return E.shrinkage_sweep2(_cells(spark, path), ["goalie_id"], ["team_id", "season"], "y", "w", (25.0, 40.0))[1]


def _fitted(spark, path):
    """Effects of the volume table, whose games are single orders."""
    li = roles.scored_lineitem(spark, path)
    shots = li.withColumns(
        {
            "goalie_in_net_id": F.col("goalie_id"),
            "is_empty_net": F.lit(0),
            "event_owner_team_id": F.lit(0).cast("bigint"),
            "home_team_id": F.col("team_id"),
            "away_team_id": F.lit(-1).cast("bigint"),
        }
    )
    fitted = E.fit_effects(E.cell_table(E.observations(shots, 0, 20)))
    if not fitted.converged:
        raise RuntimeError(f"effects did not settle in {fitted.sweeps} sweeps: {fitted.parameters}")
    return fitted


@register("dsis_effects")
def dsis_effects(spark, path):
    tables = _fitted(spark, path).tables
    kinds = {"g": ("goalie", ["goalie_id"]), "t": ("team_season", ["team_id", "season"]), "s": ("season", ["season"])}
    return union_scoped({name: tables[f].select(*keys, "effect", "sd", "sd_alone") for f, (name, keys) in kinds.items()})


@register("dsis_goalies")
def dsis_goalies(spark, path):
    return _fitted(spark, path).goalies()


@register("dsis_teams")
def dsis_teams(spark, path):
    return _fitted(spark, path).teams()


def _stored_features(spark, path):
    keep = ["event_id", "season", "is_goal", "is_empty_net", *L.MODEL_FEATURES]
    return rewrite_dataset(features(spark, path).select(*keep), "xg_features")


@register("model_logistic")
def model_logistic(spark, path):
    _, held = L.train_baseline(_stored_features(spark, path))
    return S.evaluate(held, "is_goal", "xg_prob")


@register("model_boosted")
def model_boosted(spark, path):
    rows = _stored_features(spark, path)
    model = L.fit_boosted(rows)
    return S.evaluate(L.score(model, L.prepare(rows)), "is_goal", "xg_prob")


def _stored_oof(spark, path):
    """Out-of-fold scores, written once: the calibration reads them several times, and each row passes hundreds of trees."""
    return cut_lineage(L.oof_predictions(_stored_features(spark, path)).select("event_id", "season", "is_goal", "oof_prob"))


@register("oof_predictions")
def oof_predictions(spark, path):
    return L.oof_predictions(_stored_features(spark, path)).select("event_id", "season", "is_goal", "oof_prob")


@register("score_shots")
def score_shots(spark, path):
    rows = _stored_features(spark, path)
    target = fresh_path(spark, "model")
    L.save_model(L.fit_logistic(rows), target)
    scored = L.score(L.load_model(target), L.prepare(rows, ("shot_distance", "shot_angle", "is_empty_net"), ("shot_type",)))
    return S.calibrate(scored).select("event_id", "season", "is_goal", "xg_prob")


@register("score_shots_totals", using("feats") + "SELECT season, count(*) AS n, CAST(sum(is_goal) AS BIGINT) AS goals, true AS agrees FROM feats GROUP BY 1")
def score_shots_totals(spark, path):
    """After calibration the probabilities of a season sum to its goals."""
    sums = score_shots(spark, path).groupBy("season").agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_goal").cast("bigint").alias("goals"), F.sum("xg_prob").alias("p")
    )
    return sums.select("season", "n", "goals", (F.abs(F.col("p") - F.col("goals")) < 1e-6 * F.greatest(F.lit(1), "goals")).alias("agrees"))


part("feats_sized", ("feats",), """
SELECT season, n, row_number() OVER (ORDER BY n DESC, season DESC) AS i FROM (SELECT season, count(*) AS n FROM feats GROUP BY season)""")
part("feats_dealt", ("feats_sized",), """
SELECT CAST(0 AS BIGINT) AS i, [0, 0, 0, 0, 0]::BIGINT[] AS load, CAST(NULL AS BIGINT) AS season, CAST(NULL AS BIGINT) AS fold
UNION ALL
SELECT s.i, list_transform(d.load, lambda v, j: CASE WHEN j = list_position(d.load, list_min(d.load)) THEN v + s.n ELSE v END),
  s.season, list_position(d.load, list_min(d.load)) - 1
FROM feats_dealt d JOIN feats_sized s ON s.i = d.i + 1""")


@register("oof_totals", using("feats", "feats_dealt") + """
SELECT fold, count(*) AS n, count(DISTINCT event_id) AS events, count(DISTINCT season) AS seasons, count(*) AS inside, CAST(1 AS BIGINT) AS models
FROM feats JOIN feats_dealt USING (season) GROUP BY fold""")
def oof_totals(spark, path):
    """Every shot is predicted once, with a probability between 0 and 1, by the one model that has not seen its fold's seasons."""
    inside = F.count_if((F.col("oof_prob") > 0) & (F.col("oof_prob") < 1))
    return L.oof_predictions(_stored_features(spark, path)).groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("event_id").alias("events"),
        F.count_distinct("season").alias("seasons"),
        inside.alias("inside"),
        F.count_distinct("rounds").alias("models"),
    )


@register("isotonic_totals", using("feats") + "SELECT count(*) AS n, true AS agrees, CAST(0 AS BIGINT) AS inversions FROM feats")
def isotonic_totals(spark, path):
    """An isotonic fit keeps the sum of labels and never falls."""
    oof = cut_lineage(L.calibrate_isotonic(_stored_oof(spark, path)))
    steps = oof.groupBy("oof_prob").agg(F.min("calibrated_prob").alias("low"), F.max("calibrated_prob").alias("high"))
    falls = falling(steps, "oof_prob", "low", "high", 1e-12).agg(F.count(F.lit(1)).alias("inversions"))
    sums = oof.agg(F.count(F.lit(1)).alias("n"), (F.abs(F.sum("calibrated_prob") - F.sum("is_goal")) < 1e-6 * F.count(F.lit(1))).alias("agrees"))
    return sums.withColumn("inversions", falls.scalar())


@register("tune_boosted")
def tune_boosted(spark, path):
    return L.tune(_stored_features(spark, path))


@register("feature_importance")
def feature_importance(spark, path):
    rows = _stored_features(spark, path)
    return L.permutation_importance(rows, L.fit_boosted(rows), L.MODEL_FEATURES)


@register("calibrate_isotonic")
def calibrate_isotonic(spark, path):
    return L.calibrate_isotonic(_stored_oof(spark, path)).select("event_id", "oof_prob", "calibrated_prob")



def _mean_sql(c):
    value, fold = f"coalesce(CAST({c} AS VARCHAR), 'None')", "event_id % 5"

    def outside(f):
        return f"({f} OVER (PARTITION BY {value}) - {f} OVER (PARTITION BY {value}, {fold}))"

    prior = f"(sum(is_goal) OVER () - sum(is_goal) OVER (PARTITION BY {fold})) / (count(*) OVER () - count(*) OVER (PARTITION BY {fold}))::DOUBLE"
    return f"({outside('sum(is_goal)')} + {N.SMOOTHING!r}::DOUBLE * {prior}) / ({outside('count(*)')} + {N.SMOOTHING!r}::DOUBLE) AS {c}_mean"


_MEANS = {c: f"{c}_mean" for c in L.CATEGORY_FEATURES}


@register("target_encoding", using("feats") + f"SELECT event_id, {', '.join(map(_mean_sql, _MEANS))} FROM feats", " ".join(_MEANS.values()))
def target_encoding(spark, path):
    """Every category as the mean of the label over the rows of the other folds."""
    rows = L.prepare(features(spark, path)).select("event_id", "is_goal", *_MEANS).withColumn("fold", F.col("event_id") % 5)
    rows = rewrite_dataset(rows, "categories")
    return N.encode(rows, N.label_sums(rows, list(_MEANS), "is_goal", "fold"), _MEANS, "fold").select("event_id", *_MEANS.values())
