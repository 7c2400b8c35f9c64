import numpy as np
import pytest
from pyspark.sql import functions as F

from rinkflow.plans import encoding as N
from rinkflow.plans import models as L
from rinkflow.plans import scoring as S
from rinkflow.sources.datasets import write_metrics

QUICK = {"rounds": 8, "depth": 3, "rate": 0.3}


@pytest.fixture(scope="module")
def shots(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(1500):
        d, a = float(rng.uniform(5, 80)), float(rng.uniform(-90, 90))
        traffic = int(rng.integers(0, 5))
        kind = ["wrist", "snap", "slap"][int(rng.integers(0, 3))]
        p = 1 / (1 + np.exp(0.06 * d - 1.5 - 0.5 * traffic * (kind == "slap")))
        rows.append((i, 20202021 + 10001 * (i % 4), d, a, kind, traffic, int(rng.random() < p)))
    df = spark.createDataFrame(rows, "event_id bigint, season bigint, shot_distance double, shot_angle double, shot_type string, traffic_density bigint, is_goal int")
    fill = {c: F.lit(0.0) for c in L.MODEL_FEATURES if c not in df.columns and c not in L.CATEGORY_FEATURES}
    fill |= {c: F.lit("x") for c in L.CATEGORY_FEATURES if c not in df.columns}
    return df.withColumns(fill).withColumn("is_empty_net", F.lit(0)).persist()


def test_baseline(spark, shots, tmp_path):
    model, held = L.train_baseline(shots)
    quality = S.evaluate(held, "is_goal", "xg_prob").first()
    assert quality["auc"] > 0.65 and abs(held.count() - 300) <= 1
    path = str(tmp_path / "model")
    L.save_model(model, path)
    numbers = ("shot_distance", "shot_angle", "is_empty_net")
    again = L.score(L.load_model(path), L.prepare(shots, numbers, ("shot_type",))).agg(F.sum("xg_prob")).first()[0]
    assert again == pytest.approx(L.score(model, L.prepare(shots, numbers, ("shot_type",))).agg(F.sum("xg_prob")).first()[0])
    write_metrics(S.evaluate(held, "is_goal", "xg_prob"), str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics")).count() == 1


def losses(df, p):
    return df.select("is_goal", F.col(p).alias("p")).agg(S.log_loss("is_goal", "p")).first()[0]


def test_stop_round():
    assert L.stop_round([5, 4, 3, 4, 4], 2) == (3, True)
    assert L.stop_round([5, 4, 3, 4], 2) == (3, False)
    assert L.stop_round([5, 4, 3, 4, 2, 3], 3) == (5, False)  # inside the patience a lower loss counts
    assert L.stop_round([1], 50) == (1, False)


def test_patience_keeps_the_best_rounds(shots):
    """Rounds stop by the held-out loss, after patience; the model is that of the least loss, and better than one tree."""
    marked = shots.withColumn("held", F.col("event_id") % 4 == 0)
    held = L.prepare(marked.where("held"))
    model = L.fit_boosted(marked, validation="held", rounds=60, depth=2, rate=0.1, patience=6)
    n = L.rounds_of(model)
    assert 1 < n < 60
    by_round = []
    for k in (1, n // 2, n, n + 3):
        other = L.fit_boosted(marked.where("NOT held"), rounds=k, depth=2, rate=0.1)
        assert L.rounds_of(other) == k
        by_round.append(losses(L.score(other, held, "p"), "p"))
    assert by_round[2] == pytest.approx(losses(L.score(model, held, "p"), "p"), abs=1e-9)
    assert by_round[2] < by_round[1] < by_round[0] and by_round[2] < by_round[3]


def test_first_rounds_are_saved(shots, tmp_path):
    marked = shots.withColumn("held", F.col("event_id") % 4 == 0)
    model = L.fit_boosted(marked, validation="held", rounds=20, depth=2, rate=0.3, patience=3)
    path = str(tmp_path / "boosted")
    L.save_model(model, path)
    rows = L.prepare(shots)
    again = L.load_model(path)
    assert L.rounds_of(again) == L.rounds_of(model)
    assert losses(L.score(again, rows, "p"), "p") == pytest.approx(losses(L.score(model, rows, "p"), "p"), abs=1e-12)


def test_budget_grows_until_the_loss_stops_falling(shots, monkeypatch):
    fitted = []
    plain = L.GBTClassifier.setMaxIter
    monkeypatch.setattr(L.GBTClassifier, "setMaxIter", lambda self, n: fitted.append(n) or plain(self, n))
    marked = shots.withColumn("held", F.col("event_id") % 4 == 0)
    L.fit_boosted(marked, validation="held", rounds=30, depth=1, rate=0.02, patience=4)
    assert fitted == [6, 12, 24, 30]
    fitted.clear()
    L.fit_boosted(marked.withColumn("held", F.lit(False)), validation="held", rounds=5, depth=1)
    assert fitted == [5]  # nothing held out: all rounds


@pytest.mark.parametrize("fold", [None, "fold"])
def test_target_means_leave_out_the_own_fold(spark, fold):
    rng = np.random.default_rng(4)
    rows = [(i, ["a", "b", None][int(rng.integers(0, 3))], f"k{int(rng.integers(0, 40))}", int(rng.random() < 0.3) if i % 11 else None, i % 5 if i % 13 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, u string, v string, y int, fold long")
    got = {r["id"]: r for r in N.encode(df, N.label_sums(df, ["u", "v"], "y", "fold"), {"u": "eu", "v": "ev"}, fold, 4.0).collect()}
    for i, u, v, _, f in rows:
        others = [r for r in rows if r[3] is not None and (fold is None or f is None or r[4] != f)]
        m = sum(r[3] for r in others) / len(others)
        for value, at, new in ((u, 1, "eu"), (v, 2, "ev")):
            same = [r[3] for r in others if r[at] == value]
            assert got[i][new] == pytest.approx((sum(same) + 4 * m) / (len(same) + 4), abs=1e-12)


def test_target_means_of_unknown_values_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a", 1, 0), (2, "a", 0, 1), (3, "b", 1, 1)], "id long, u string, y int, fold long")
    sums = N.label_sums(df, ["u"], "y", "fold")
    new = spark.createDataFrame([("c",), (None,)], "u string")
    assert [r["e"] for r in N.encode(new, sums, {"u": "e"}).collect()] == pytest.approx([2 / 3, 2 / 3])
    none = N.label_sums(df.limit(0), ["u"], "y", "fold")
    assert [r["e"] for r in N.encode(new, none, {"u": "e"}).collect()] == [None, None]


def test_category_without_signal_of_its_own_label(spark):
    """A category that is a row's own number must not give its label away: held-out means don't, codes of single rows don't."""
    rng = np.random.default_rng(9)
    rows = [(i, f"s{i}", int(rng.random() < 0.3)) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, c string, is_goal int").withColumn("x", F.lit(0.0))
    model = L.fit_boosted(df, numbers=("x",), categories=("c",), rounds=3, depth=2)
    p = L.score(model, L.prepare(df, ("x",), ("c",)), "p").select("p").toPandas()["p"]
    assert p.std() < 0.12  # in-sample means would tell both classes apart


def test_held_out_scores_and_isotonic(shots):
    oof = L.oof_predictions(shots, k=2, rounds=12, depth=2, rate=0.1, patience=5).persist()
    assert oof.count() == 1500 and S.auc(oof, "is_goal", "oof_prob").first()["auc"] > 0.7
    rate = shots.agg(F.avg("is_goal")).first()[0]
    assert losses(oof, "oof_prob") < -(rate * np.log(rate) + (1 - rate) * np.log(1 - rate)) - 0.02
    assert oof.agg(F.min("rounds")).first()[0] > 1
    iso = L.calibrate_isotonic(oof)
    sums = iso.agg(F.sum("calibrated_prob").alias("p"), F.sum("is_goal").alias("y")).first()
    assert sums["p"] == pytest.approx(sums["y"], rel=1e-6)


def test_search_and_importance(shots, tmp_path):
    trials = L.tune(shots, trials=2, folds=2, rounds=12, patience=4)
    found = trials.collect()
    assert len(found) == 2 and found[0]["log_loss"] <= found[1]["log_loss"] and max(r["rounds"] for r in found) > 1
    best = L.best_choice(trials)
    assert best == {c: found[0][c] for c in ("depth", "rate", "min_rows")}
    L.save_choice(trials, str(tmp_path / "choice"))
    assert L.best_choice(trials.sparkSession.read.json(str(tmp_path / "choice"))) == best
    assert L.best_choice(trials.limit(0)) == {}
    model = L.fit_boosted(shots, **QUICK)
    found = L.permutation_importance(shots, model, ["shot_distance", "puck_speed"], rows=500).collect()
    assert found[0]["feature"] == "shot_distance" and found[1]["loss_increase"] == pytest.approx(0, abs=1e-9)


def test_registered_models_have_whole_budgets(spark, shots, monkeypatch):
    """No query depends on what ran before it, and none cuts the defaults."""
    from rinkflow.registry import models as R

    calls = []
    trials = spark.createDataFrame([(1, 9, 0.07, 3, 8.0, 0.2)], "trial int, depth int, rate double, min_rows int, rounds double, log_loss double")
    monkeypatch.setattr(R, "_stored_features", lambda spark, path: shots)
    monkeypatch.setattr(R.L, "tune", lambda df, **k: calls.append(k) or trials)
    monkeypatch.setattr(R.L, "fit_boosted", lambda df, **k: calls.append(k))
    monkeypatch.setattr(R.L, "score", lambda model, df: df)
    monkeypatch.setattr(R.S, "evaluate", lambda *a: None)
    R.model_boosted(spark, "/no/such/folder")
    R.tune_boosted(spark, "/no/such/folder")
    R.model_boosted(spark, "/no/such/folder")
    assert calls == [{}, {}, {}]
