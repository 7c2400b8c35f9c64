"""What the findings of the fourth round were about."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rinkflow.llm import secrets
from rinkflow.operators.sizing import settle
from rinkflow.plans import effects
from rinkflow.plans import models as L
from rinkflow.plans.scoring import log_loss


def _whole_system(rows, p):
    """Deviations from the inverse of the dense precision of all goalies, team-seasons, seasons and coefficients."""
    names = [("g", g) for g in sorted({r[0] for r in rows})] + [("t", *x) for x in sorted({r[1:3] for r in rows})] + [("s", x) for x in sorted({r[2] for r in rows})]
    at = {n: i for i, n in enumerate(names)}
    a = np.diag([1 / p[n[0]] for n in names] + [1.0] * 3)
    for g, t, s, _, n, _, traffic, speed in rows:
        x = np.zeros(len(a))
        x[[at["g", g], at["t", t, s], at["s", s], -3]] = 1
        x[-2:] = traffic, speed
        some = np.flatnonzero(x)
        a[np.ix_(some, some)] += np.outer(x[some], x[some]) * n / p["sigma2"]
    return dict(zip(names, np.sqrt(np.diag(np.linalg.inv(a))), strict=False))


@pytest.mark.parametrize("block", [None, 7, 10])
def test_deviations_do_not_depend_on_the_number_of_levels(spark, monkeypatch, block):
    """Over 1000 team-seasons, and few ones in blocks: always those of the whole system."""
    rng = np.random.default_rng(3)
    goalies, teams = (60, 180) if block is None else (25, 4)
    seasons = 8 if block is None else 3
    rows = [
        (g, int(rng.integers(0, teams)), int(rng.integers(0, seasons)), k, int(rng.integers(5, 60)), float(rng.normal(0, 0.1)), float(rng.normal()), float(rng.normal()))
        for g in range(goalies) for k in range(60 if block is None else int(rng.integers(1, 12)))
    ]
    if block:
        monkeypatch.setattr(effects, "BLOCK", block)
        monkeypatch.setattr(effects, "GOALIES", 4)
    levels = len({r[1:3] for r in rows}) + seasons
    assert levels > (block or 1000)
    obs = spark.createDataFrame(rows, "goalie_id bigint, team_id bigint, season bigint, game_id bigint, shots_faced bigint, gsax_per_shot double, traffic_std double, speed_std double")
    cells = effects.cell_table(obs)
    tables = {
        f: settle(cells.groupBy(*k).agg(F.sum("w").alias("__w")).withColumns({"effect": F.lit(0.0), "sd": F.lit(0.1)})) for f, k in effects.FACTORS.items()
    }
    p = {"sigma2": 0.4, "g": 0.02, "t": 0.01, "s": 0.005, "alpha": 0.0, "beta_traffic": 0.0, "beta_speed": 0.0}
    got, want = effects.marginal_deviations(cells, tables, p), _whole_system(rows, p)
    found = {(f, *[r[k] for k in keys]): (r["sd"], r["sd_alone"]) for f, keys in effects.FACTORS.items() for r in got[f].collect()}
    assert found.keys() == want.keys()
    assert all(sd == pytest.approx(want[k], rel=1e-9) and alone == 0.1 for k, (sd, alone) in found.items())


TEXTS = [None, "", "a-b_c+d/e", "ABCDEFGhij 0123456789abcdef0123456789", "éa🙂bcdé---", "x" * 10, "PassWord = Zz9/Zz9- AKIA" + "Q7" * 9]


def test_symbols_are_counted_in_pieces(spark):
    """The counts of single symbols, from a third of the rows: pieces hold three symbols and nothing else."""
    docs = spark.createDataFrame([(t,) for t in TEXTS * 3], "text string")
    got = secrets.symbol_skew(docs)
    for kind, order in secrets.ORDERS.items():
        plain = "".join(t or "" for t in TEXTS).translate(str.maketrans("-_", "+/"))
        plain = plain.lower() if kind == "hex" else plain
        counts = [3 * plain.count(c) for c in order]
        assert got[kind] == pytest.approx(len(order) * sum(n * n for n in counts) / sum(counts) ** 2 - 1, rel=1e-12)
    seen = []
    plain = type(docs).collect
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(docs), "collect", lambda df: seen.append(df._jdf.queryExecution().analyzed().toString()) or plain(df))
        secrets.symbol_skew(docs)
    assert "{1,3}" in seen[0]


def test_a_token_is_cut_from_its_text_once(spark):
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("kind"), F.lit(21).alias("end")))
    df = spark.createDataFrame([("thestoneriverandthemou and",)], "t string").select(secrets._tested(F.col("t"), spans).alias("x"))
    assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("substring(") == 1
    assert df.first()["x"][0]["n"] == 21


def test_short_words_are_searched_for_assignments_only(spark):
    """Access keys and hexadecimal runs lie in runs of 20 symbols; assignments need a colon or an equals sign."""
    texts = ["token abc", "token=abcdef", "pASSWORD:abcdef", "Api_key = 'abcdef", "AKIA" + "Z" * 16, "AKIA" + "Z" * 15, "a" * 24, "a" * 23, "b" * 23 + "é" + "c" * 24]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] < 3] for r in secrets.find_secrets(df).collect()}
    assert got == {0: [], 1: [(0, 0, 12)], 2: [(0, 0, 15)], 3: [(0, 0, 17)], 4: [(1, 0, 20)], 5: [], 6: [(2, 0, 24)], 7: [], 8: [(2, 24, 48)]}


@pytest.fixture(scope="module")
def shots(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(600):
        d, kind = float(rng.uniform(5, 80)), [None, "snap", "slap"][int(rng.integers(0, 3))]
        rows.append((i, d, kind, int(rng.integers(0, 5)), int(rng.random() < 1 / (1 + np.exp(0.06 * d - 1.5 - 2 * (kind == "slap"))))))
    df = spark.createDataFrame(rows, "event_id bigint, shot_distance double, shot_type string, traffic_density bigint, is_goal int")
    fill = {c: F.lit("x") if c in L.CATEGORY_FEATURES else F.lit(0.0) for c in L.MODEL_FEATURES if c not in df.columns}
    return df.withColumns(fill).persist()


def test_trials_share_the_encoded_rows_of_a_fold(shots, monkeypatch):
    """Rows are encoded once per fold, and the trials are those of fits that each encode their rows."""
    fits = []
    plain = L.TargetEncoder.fit
    monkeypatch.setattr(L.TargetEncoder, "fit", lambda self, df: fits.append(1) or plain(self, df))
    found = L.tune(shots, trials=3, folds=2, rounds=6, patience=2).collect()
    assert len(found) == 3 and len(fits) == 2
    weighted = L.with_class_weights(shots, "is_goal", "weight")
    numbers = L.row_numbers(weighted.withColumn("__h", F.xxhash64(F.lit(42), F.col("event_id")).cast("double")), "__h", "event_id", "__rn", ["is_goal"])
    for r in found[:1]:
        losses = []
        for fold in range(2):
            marked = numbers.withColumn("held_out", F.col("__rn") % 2 == fold)
            model = L.fit_boosted(
                marked, weight="weight", validation="held_out", rounds=6, patience=2, depth=r["depth"], rate=r["rate"], min_rows=r["min_rows"]
            )
            held = L.score(model, L.prepare(marked.where("held_out")), "p")
            losses.append(held.agg(log_loss("is_goal", "p")).first()[0])
        assert r["log_loss"] == pytest.approx(np.mean(losses), rel=1e-9)


def test_categories_are_encoded_before_columns_are_dealt_anew(shots, monkeypatch):
    """The encoders see a row once, not once per column; the losses are those of whole rows with one column dealt anew."""
    model = L.fit_boosted(shots, rounds=4, depth=3, rate=0.3)
    cols = ["shot_type", "shot_distance", "traffic_density"]
    scored = []
    plain = L.score
    with monkeypatch.context() as m:
        m.setattr(L, "score", lambda model, df, new: scored.append([type(s).__name__ for s in model.stages]) or plain(model, df, new))
        got = {r["feature"]: r["loss_increase"] for r in L.permutation_importance(shots, model, cols).collect()}
    assert scored == [["VectorAssembler", "GBTClassificationModel"]]
    rows = L.prepare(shots)
    here = L.row_numbers(rows.withColumn("__k", F.col("event_id").cast("double")), "__k", "event_id", "__pos")
    mixed = L.row_numbers(rows.withColumn("__h", F.xxhash64(F.lit(8), F.col("event_id")).cast("double")), "__h", "event_id", "__pos")

    def loss(df):
        return plain(model, df, "p").agg(log_loss("is_goal", "p")).first()[0]

    for c in cols:
        other = here.drop(c).join(mixed.select("__pos", c), "__pos")
        assert got[c] == pytest.approx(loss(other) - loss(rows), abs=1e-12)
    assert got["shot_type"] > 0
