"""The same answers whether groups are split or not, on null keys, null and repeated order values, null labels and owners."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from rinkflow.operators import sequences as Q
from rinkflow.operators.intervals import cover_counts
from rinkflow.operators.skew import measure_groups
from rinkflow.plans import kalman, scoring
from rinkflow.plans.features import attacking_net
from rinkflow.session import GROUP_ROWS_CONF, SMALL_ROWS_CONF, drop_version, fresh_path, shared_dir

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
MODULES = "ingest features quality scoring metrics aging serving models".split()


@pytest.fixture
def rows(spark):
    data = []
    for key in (1, 2, None):
        for i in range(20):
            order = None if i % 9 == 0 else i // 2 if i < 8 else i
            data.append((key, order, i, i % 3))
    return spark.createDataFrame(data, "k int, o bigint, v bigint, f int")


def both(spark, run, groups=("7",), small=None):
    plain = sorted(map(str, run().collect()))
    for limit in groups:
        spark.conf.set(GROUP_ROWS_CONF, limit)
        if small:
            spark.conf.set(SMALL_ROWS_CONF, small)
        split = sorted(map(str, run().collect()))
        spark.conf.unset(GROUP_ROWS_CONF)
        spark.conf.unset(SMALL_ROWS_CONF)
        assert split == plain
    return plain


@pytest.mark.parametrize("small", [None, "2"])
def test_sequences(spark, rows, small):
    assert len(both(spark, lambda: Q.neighbours(rows, ["k"], "o", {"p": ("v", 1), "q": ("v", -2)}), ("7", "3"), small)) == 60
    both(spark, lambda: Q.running(rows, ["k"], "o", {"s": (F.col("v"), "sum", True), "m": (F.col("v"), "max", False)}), ("7",), small)
    both(spark, lambda: Q.range_counts(rows, ["k"], "o", {"c": (F.col("f") == 1, -4, -1)}), ("7",), small)
    both(spark, lambda: Q.group_values(rows, ["k"], {"t": F.sum("v")}, measure_groups(rows, ["k"]).hot), ("7",), small)


def test_null_labels_and_keys_are_covered_by_nothing(spark):
    points = spark.createDataFrame([(1, 1, 5, "a"), (1, 2, 5, None), (None, 3, 5, "a")], "g int, e int, t bigint, l string")
    spells = spark.createDataFrame([(1, "a", 0, 9), (1, None, 0, 9), (None, "a", 0, 9), (1, "a", 5, 6)], "g int, l string, s bigint, x bigint")
    def run():
        return cover_counts(points, spells, ["g", "e"], ["g"], "t", "s", "x", {"n": "l"}, "l")
    both(spark, run, ("1",))
    assert {(r["e"], r["n"]) for r in run().collect()} == {(1, 2), (2, 0), (3, 0)}


def test_no_net_without_an_owner(spark):
    rows = [(1, 1, None, "goal", 50.0), (1, 1, 9, "goal", 50.0), (1, 1, 8, "goal", -3.0), (1, 1, 7, "hit", 4.0)]
    pbp = spark.createDataFrame(rows, "game_id int, period int, event_owner_team_id int, event_type string, x_coord double")
    for hot in (True, False):
        assert {r["event_owner_team_id"]: r["net_x"] for r in attacking_net(pbp, hot).collect()} == {None: None, 9: 89, 8: -89, 7: None}


def test_folds_have_one_rule(spark, monkeypatch):
    df = spark.createDataFrame([(g, i) for g, n in enumerate((40, 5, 5, 5, 5, 3, 3)) for i in range(n)], "g int, i int")
    def folds(k):
        return {r["g"]: r["fold"] for r in scoring.group_folds(df, "g", k).collect()}
    plain, alone = folds(3), folds(None)
    assert len(set(alone.values())) == 7
    spark.conf.set(SMALL_ROWS_CONF, "3")
    assert folds(3) == plain and folds(None) == alone
    spark.conf.unset(SMALL_ROWS_CONF)
    monkeypatch.setattr(scoring, "LARGEST", 4)
    assert set(folds(3).values()) == {0, 1, 2} and len(folds(3)) == 7 and sorted(folds(None).values()) == list(range(7))


@pytest.mark.parametrize("key", ["int", "string"])
def test_folds_of_many_groups_are_those_of_few(spark, key):
    # One group of a third of all rows beside many small ones, and a null group.
    sizes = [300, 70, 70, 7, 7, 7, *[3] * 30, *[2] * 100, *[1] * 150]
    rows = [(None if g == 8 else g * 7919 % 1009, i) for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, i int").select(F.col("g").cast(key).alias("g"))
    for k in (2, 3, 5, None):
        plain, many = [{r["g"]: r["fold"] for r in scoring.group_folds(df, "g", k, largest=n).collect()} for n in (10_000, 3)]
        assert len(plain) == len(sizes) and many == plain
    loads = [r["count"] for r in df.join(scoring.group_folds(df.dropna(), "g", 3, largest=3), "g").groupBy("fold").count().collect()]
    assert max(loads) - min(loads) <= 1


def test_traded_goalies_keep_their_rows(spark):
    rows = [(1, 20, 2001, 0.01, 30, 25.0), (1, 10, 2001, 0.03, 10, 25.0), (1, 10, 2002, 0.02, 40, 26.0), (1, 20, 2002, 0.0, 5, 26.0)]
    series = spark.createDataFrame(rows, "goalie_id bigint, team_id bigint, season bigint, talent double, shots_faced bigint, age double")
    drift = spark.createDataFrame([(20.0, 0.0), (40.0, 0.0)], "age double, yearly_drift double")
    filtered = kalman.kalman_filter(kalman.steps(series, drift))
    path = kalman.trajectory(series, filtered, keep=("team_id", "step")).orderBy("step").collect()
    assert [(r["step"], r["team_id"]) for r in path] == [(1, 10), (2, 20), (3, 10), (4, 20)]
    last = kalman.projections(series, filtered, drift).first()
    assert last["current_filtered_talent_per_shot"] == pytest.approx(path[3]["kalman_talent"], abs=1e-6)
    errors = {r["method"]: r["n"] for r in kalman.projection_backtest(kalman.steps(series, drift)).collect()}
    assert set(errors.values()) == {3}


def test_shared_folder(spark, monkeypatch):
    path = fresh_path(spark, "gone")
    spark.range(3).write.parquet(path)
    drop_version(spark, path)
    assert not os.path.exists(path.removeprefix("file:"))
    with pytest.raises(ValueError):
        drop_version(spark, "/tmp")

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())


@pytest.mark.parametrize("module", MODULES)
def test_registry_modules_import_alone(module):
    subprocess.run([sys.executable, "-c", f"import rinkflow.registry.{module}"], cwd=ROOT, check=True, timeout=120)


def test_entry_in_a_fresh_process():
    code = "import __spark_entry__ as e; from rinkflow.session import local_session; print('rows', e.entry(local_session('2', 2)).count())"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=600, capture_output=True, text=True)
    assert int(done.stdout.split("rows")[1]) > 0
