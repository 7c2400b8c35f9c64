import numpy as np
import pytest
from pyspark.sql import functions as F

from rinkflow.operators.sizing import guard_rows, settle
from rinkflow.plans import aging, effects, kalman, models, quality, scoring, serving
from rinkflow.plans import features as P
from rinkflow.plans import metrics as M
from rinkflow.registry.features import FRAMES, scored
from rinkflow.sources import roles
from rinkflow.streaming import ingest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shots(spark):
    return scored(spark, SMALL).persist()


def test_calibrated_sums_agree(shots):
    rows = scoring.calibrate(shots).groupBy("season").agg(F.sum("xg_prob").alias("p"), F.sum("is_goal").alias("y")).collect()
    assert rows and all(r["p"] == pytest.approx(r["y"]) for r in rows)


def test_factor_of_an_empty_sum(spark):
    df = spark.createDataFrame([(1, 1, 0.0)], "season int, is_goal int, xg_prob double")
    assert scoring.calibration_factor(df).first()["calib_factor"] is None
    assert scoring.calibration_factor(df, compat="reference").first()["calib_factor"] == float("inf")


def test_evaluation(spark):
    rng = np.random.default_rng(0)
    p = np.round(rng.random(300), 2)
    y = (rng.random(300) < p).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "p double, y int")
    got = scoring.evaluate(df, "y", "p").first()
    pos, neg = p[y == 1], p[y == 0]
    area = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    q = np.clip(p, 2.2e-16, 1 - 2.2e-16)
    assert got["auc"] == pytest.approx(area)
    assert got["log_loss"] == pytest.approx(-np.mean(y * np.log(q) + (1 - y) * np.log(1 - q)))
    assert got["brier_score"] == pytest.approx(np.mean((p - y) ** 2))
    assert scoring.auc(df.filter("y = 1"), "y", "p").first()["auc"] == 0.5
    bins = scoring.calibration_curve(df, "y", "p").collect()
    assert sum(r["n"] for r in bins) == 300


def test_group_folds_hold_whole_groups(spark, tight):
    rows = [(s, i) for s, n in ((1, 50), (2, 40), (3, 30), (4, 5), (5, 5), (6, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "season bigint, i int")
    for limit in ("100", "3"):
        tight.conf.set("rinkflow.maxSmallRows", limit)
        folds = {r["season"]: r["fold"] for r in scoring.group_folds(df, "season", 3).collect()}
        assert set(folds) == {1, 2, 3, 4, 5, 6} and set(folds.values()) == {0, 1, 2}
    tight.conf.set("rinkflow.maxSmallRows", "100")
    assert {r["season"]: r["fold"] for r in scoring.group_folds(df, "season", 3).collect()} == {1: 0, 2: 1, 3: 2, 5: 2, 4: 2, 6: 1}
    assert scoring.group_folds(df, "season", None).select("fold").distinct().count() == 6


def test_split_shares(shots):
    split = scoring.stratified_split(shots.select("event_id", "is_goal"), "is_goal", "event_id")
    counts = {(r["is_goal"], r["is_test"]): r["n"] for r in split.groupBy("is_goal", "is_test").agg(F.count("*").alias("n")).collect()}
    for label in (0, 1):
        n = counts[(label, True)] + counts[(label, False)]
        assert counts[(label, True)] == round(0.2 * n)


def test_rebound_control_has_mean_zero(shots):
    base = M.goalie_season_metrics(shots, 3, max_gap=7200, max_distance=120)
    rows = base.filter(F.col("rci").isNotNull()).collect()
    assert rows and np.mean([r["rci"] for r in rows]) == pytest.approx(0, abs=1e-9)
    seasons = M.goalie_season_metrics(shots, 3, max_gap=7200, max_distance=120, rci_by=["season"]).groupBy("season").agg(F.avg("rci").alias("m"))
    assert all(r["m"] is None or r["m"] == pytest.approx(0, abs=1e-9) for r in seasons.collect())


def test_both_modes_agree_on_one_period(spark):
    """With one game, one period and no goalie shifts the accidental semantics cannot differ."""
    one = roles.pbp(spark, SMALL).withColumn("game_id", F.lit(1).cast("bigint")).withColumn("period", F.lit(1).cast("bigint"))
    one = one.withColumn("home_team_id", F.lit(1).cast("bigint")).withColumn("away_team_id", F.lit(11).cast("bigint"))
    one = one.withColumn("event_owner_team_id", F.expr("if(event_id % 2 = 0, 1L, 11L)")).filter("event_id < 400").persist()
    cols = ["event_id", "traffic_density", "shot_sequence_num", "delta_angle", "puck_speed", "score_differential"]
    a = P.shot_features(one, None, compat="fixed", **FRAMES).select(*cols).orderBy("event_id").toPandas()
    b = P.shot_features(one, None, compat="reference", **FRAMES).select(*cols).orderBy("event_id").toPandas()
    assert len(a) and a.equals(b)


def test_features_do_not_depend_on_splitting(spark):
    cols = ["event_id", "net_x", "traffic_density", "shot_sequence_num", "delta_angle", "puck_speed", "score_differential",
            "strength_state", "time_since_last_stoppage", "sequence_2_events"]

    def table():
        f = P.shot_features(roles.pbp(spark, SMALL), roles.shifts(spark, SMALL), roles.goalies(spark, SMALL), **FRAMES)
        return f.select(*cols).orderBy("event_id").toPandas()

    plain = table()
    spark.conf.set("rinkflow.maxGroupRows", "5")
    split = table()
    spark.conf.unset("rinkflow.maxGroupRows")
    assert len(plain) and plain.equals(split)


def test_one_exchange_for_the_context(spark):
    plan = P.event_context(roles.pbp(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "PythonUDF" not in plan


def test_kalman_fixture(spark):
    rows = [(1, 2020, 0.01, 4e-5, 0.0), (1, 2021, 0.02, 8e-5, 0.001), (2, 2020, 0.5, 4e-5, 0.0)]
    df = spark.createDataFrame(rows, "goalie_id bigint, season bigint, talent double, noise double, offset double")
    got = kalman.kalman_filter(df).orderBy("season").collect()
    assert [r["kalman_talent"] for r in got] == [pytest.approx(0.0096153846), pytest.approx(0.0141556886)]
    assert got[1]["variance"] == pytest.approx(3.0179641e-05)


def test_long_series_are_cut(spark):
    rng = np.random.default_rng(8)
    rows = [(g, i, float(rng.normal(scale=0.01)), float(4e-5 * (1 + rng.random())), float(rng.normal(scale=1e-3))) for g in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "goalie_id bigint, season bigint, talent double, noise double, offset double")
    plain = kalman.kalman_filter(df).orderBy("goalie_id", "season").toPandas()
    spark.conf.set("rinkflow.maxGroupRows", "7")
    cut = kalman.kalman_filter(df).orderBy("goalie_id", "season").toPandas()
    spark.conf.unset("rinkflow.maxGroupRows")
    np.testing.assert_allclose(plain["kalman_talent"], cut["kalman_talent"], rtol=1e-9)
    np.testing.assert_allclose(plain["variance"], cut["variance"], rtol=1e-9)
    assert len(plain) == 120 and (plain["variance"] <= 0.001).all()


def test_effects_recover_planted_ones(spark):
    rng = np.random.default_rng(9)
    goalies = rng.normal(scale=0.02, size=40)
    teams = rng.normal(scale=0.01, size=(10, 3))
    rows = []
    for g in range(40):
        for s in range(3):
            for game in range(30):
                t = int(rng.integers(0, 10))
                n = int(rng.integers(20, 40))
                traffic, speed = rng.normal(size=2)
                y = 0.005 + 0.01 * traffic + goalies[g] + teams[t, s] + rng.normal(scale=0.1 / np.sqrt(n))
                rows.append((g, t, s, game, n, float(y), float(traffic), float(speed)))
    obs = spark.createDataFrame(rows, "goalie_id bigint, team_id bigint, season bigint, game_id bigint, shots_faced bigint, gsax_per_shot double, traffic_std double, speed_std double")
    fit = effects.fit_effects(effects.cell_table(obs), sweeps=8)
    got = {r["goalie_id"]: r["dsis_true_talent_gsax_per_shot"] for r in fit.goalies().collect()}
    assert np.corrcoef([got[g] for g in range(40)], goalies)[0, 1] > 0.97
    assert fit.parameters["beta_traffic"] == pytest.approx(0.01, abs=0.003)
    assert fit.teams().count() == 30


def test_deviations_are_those_of_the_whole_system(spark, monkeypatch):
    """Against the inverse of the dense precision of all goalies, team-seasons, seasons and coefficients."""
    rng = np.random.default_rng(3)
    rows = [
        (g, int(rng.integers(0, 4)), int(rng.integers(0, 3)), k, int(rng.integers(5, 60)), float(rng.normal(0, 0.1)), float(rng.normal()), float(rng.normal()))
        for g in range(25) for k in range(int(rng.integers(1, 12)))
    ]
    obs = spark.createDataFrame(rows, "goalie_id bigint, team_id bigint, season bigint, game_id bigint, shots_faced bigint, gsax_per_shot double, traffic_std double, speed_std double")
    cells = effects.cell_table(obs)
    tables = {
        f: settle(cells.groupBy(*k).agg(F.sum("w").alias("__w")).withColumns({"effect": F.lit(0.0), "sd": F.lit(1.0)})) for f, k in effects.FACTORS.items()
    }
    p = {"sigma2": 0.4, "g": 0.02, "t": 0.01, "s": 0.005, "alpha": 0.0, "beta_traffic": 0.0, "beta_speed": 0.0}
    got = effects.marginal_deviations(cells, tables, p)
    names = [("g", g) for g in sorted({r[0] for r in rows})] + [("t", *x) for x in sorted({r[1:3] for r in rows})] + [("s", x) for x in sorted({r[2] for r in rows})]
    at = {n: i for i, n in enumerate(names)}
    a = np.diag([1 / p[n[0]] for n in names] + [1.0] * 3)
    for g, t, s, _, n, _, traffic, speed in rows:
        x = np.zeros(len(a))
        x[[at["g", g], at["t", t, s], at["s", s], -3]] = 1
        x[-2:] = traffic, speed
        a += np.outer(x, x) * n / p["sigma2"]
    want = np.sqrt(np.diag(np.linalg.inv(a)))
    seen = 0
    for f, keys in effects.FACTORS.items():
        for r in got[f].collect():
            assert r["sd"] == pytest.approx(want[at[f, *[r[k] for k in keys]]], rel=1e-9) and r["sd_alone"] == 1.0
            seen += 1
    assert seen == len(names)
    monkeypatch.setattr(effects, "MOST_LEVELS", 5)
    assert {r["sd"] for r in effects.marginal_deviations(cells, tables, p)["g"].collect()} == {1.0}


def test_percentiles_are_shares(spark, shots):
    board = serving.leaderboard(shots, roles.names(spark, SMALL), min_shots=3)
    rows = board.collect()
    assert rows and all(0 < r["gsax_pct"] <= 100 for r in rows)
    assert [r["gsax"] for r in rows] == sorted([r["gsax"] for r in rows], reverse=True)


def test_comparison_keeps_goalies_without_shots(spark, shots):
    ids = spark.createDataFrame([(1,), (2,)], "goalie_id bigint")
    rows = serving.head_to_head(shots, roles.names(spark, SMALL), ids).collect()
    assert [(r["shots"], r["goals"], r["goalie_name"]) for r in sorted(rows, key=lambda r: r["goalie_id"])] == [(0, None, "1"), (0, None, "2")]


def test_quality_on_empty_and_missing_tables(spark):
    empty = roles.pbp(spark, SMALL).limit(0)
    report = {r["check"]: r for r in quality.run_checks(empty).collect()}
    assert report["Coordinate Bounds"]["passed"] and report["Result"]["passed"]
    assert report["Event Sequence Validation"]["summary"] == "No PBP data to validate"
    with pytest.raises(ValueError):
        quality.run_checks(None)


def test_report_is_that_of_the_single_checks(spark):
    pbp = roles.pbp(spark, SMALL)
    single = [
        quality.check_bounds(pbp, 95.0, 40.0), quality.check_venue_bias(pbp, 5, 1.0), quality.check_sequences(pbp, 30.0, 0), quality.check_missing(pbp, 2.0),
    ]
    want = [tuple(c.result.first()) for c in single]
    got = quality.run_checks(pbp, 5, 30.0, 2.0, sigma=1.0, max_per_group=0, x_limit=95.0, y_limit=40.0).orderBy("position").collect()
    assert [tuple(r)[:3] for r in got[:4]] == want and not got[4]["passed"]
    assert any(not w[1] for w in want)


def test_report_reads_the_table_twice(spark, tmp_path):
    """One scan for the sums and one for the windowed pass, however many checks there are."""
    path = str(tmp_path / "pbp")
    roles.pbp(spark, SMALL).write.parquet(path)
    read = spark.read.parquet(path)
    plans = [quality.shot_sums(read), quality.anomaly_sums(read)]
    assert [p._jdf.queryExecution().executedPlan().toString().count("FileScan") for p in plans] == [1, 1]
    # What is left after that reads no file.
    final = quality.run_checks(read)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in final and "Window" not in final


def test_report_of_a_named_table(spark):
    with pytest.raises(ValueError, match="not found"):
        quality.check_table(spark, "no_such_table")
    roles.pbp(spark, SMALL).createOrReplaceTempView("plays_here")
    assert quality.check_table(spark, "plays_here").count() == 5


def test_guard(spark):
    assert guard_rows(spark.range(5), 5) and not guard_rows(spark.range(4), 5)


def test_features_without_shots_are_not_written(spark, tmp_path):
    path = str(tmp_path / "features")
    rows = spark.createDataFrame([(1, 20202021)], "event_id long, season long")
    assert P.write_features(rows, path)
    with pytest.warns(UserWarning, match="no shots"):
        assert not P.write_features(rows.limit(0), path)
    assert spark.read.parquet(path).count() == 1


def test_few_rows_are_trained_on_with_a_warning(spark):
    with pytest.warns(UserWarning, match="fewer than 50"):
        assert models.warn_if_few(spark.range(49))
    assert not models.warn_if_few(spark.range(50))


def test_status(spark):
    log = [("pbp", 3, "complete", "", 1), ("pbp", 5, "failed", "HTTP 500", 2), ("pbp", 6, "failed", "x", 3), ("pbp", 6, "complete", "", 4),
           ("pbp", 7, "complete", "", 5), ("pbp", 7, "failed", "late", 6), ("shifts", 3, "failed", "y", 7)]
    df = spark.createDataFrame(log, "data_type string, game_id bigint, state string, message string, seq bigint")
    got = {(r["data_type"], r["game_id"]): (r["completed"], r["failed"], r["message"]) for r in ingest.status_latest(df).collect()}
    assert got[("pbp", 3)] == (True, False, None) and got[("pbp", 5)] == (False, True, "HTTP 500")
    assert got[("pbp", 6)] == (True, False, None) and got[("pbp", 7)] == (True, True, "late")
    assert got[("shifts", 3)] == (False, True, "y")
    assert {r["game_id"] for r in ingest.pending(spark.createDataFrame([(3,), (5,)], "game_id bigint"), ingest.status_latest(df).filter("data_type = 'pbp'")).collect()} == {5}


def test_ages(spark):
    rows = spark.createDataFrame([(1, 20242025), (2, 20242025)], "goalie_id bigint, season bigint")
    births = spark.createDataFrame([(1, "1995-10-01")], "goalie_id bigint, d string").select("goalie_id", F.to_date("d").alias("birth_date"))
    got = aging.exact_age(rows, births).collect()
    assert len(got) == 1 and got[0]["exact_age"] == pytest.approx(10593 / 365.25)
