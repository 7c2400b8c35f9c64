"""Streams replayed in any order of arrival against the batch operators."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rinkflow.operators.sequences import neighbours, range_counts
from rinkflow.plans import kalman as K
from rinkflow.streaming import online

PLAYS = "game_id bigint, event_id bigint, ts timestamp, axis bigint, kind string, x double"
SENTINEL = -1


def plays(seed=3, games=6, n=40):
    """(game, event, second, kind, x): the event number and the axis rise with the second."""
    rng = random.Random(seed)
    rows = []
    for g in range(games):
        t = rng.randrange(100)
        for i in range(n):
            t += rng.choice([0, 1, 5, 20])
            rows.append((g, 1000 * g + i, t, rng.choice(["shot", "hit", None]), None if rng.random() < 0.1 else rng.random()))
    return rows


def frame(spark, rows):
    made = spark.createDataFrame([(g, e, t, k, x) for g, e, t, k, x in rows], "game_id bigint, event_id bigint, t bigint, kind string, x double")
    return made.select("game_id", "event_id", F.timestamp_seconds(F.col("t") + 1_000_000).alias("ts"), F.col("t").alias("axis"), "kind", "x")


def land(spark, rows, folder, name, make=frame):
    make(spark, rows).coalesce(1).write.parquet(f"{folder}/{name}")


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


LAGS = {"prev": ("kind", 1), "prev_x": ("x", 1), "third": ("event_id", 3)}


def context(df):
    return online.online_context(df, ["game_id"], "event_id", "ts", LAGS, {"shots": (F.col("kind") == "shot", "axis", -30, -1), "all": (F.lit(True), "axis", -60, -5)}, tie="event_id", late="20 seconds")


def batch_context(df):
    found = neighbours(df, ["game_id"], "event_id", LAGS, tie="event_id")
    return range_counts(found, ["game_id"], "axis", {"shots": (F.col("kind") == "shot", -30, -1), "all": (F.lit(True), -60, -5)})


def rows_of(df):
    columns = ["game_id", "event_id", "ts", "axis", "kind", "x", "prev", "prev_x", "third", "shots", "all"]
    return sorted((tuple(r) for r in df.where(F.col("game_id") != SENTINEL).select(*columns).collect()), key=lambda r: r[:2])


def test_context_of_a_stream(spark, tmp_path):
    """Rows out of order inside the watermark, a query that is started again, and rows that come too late."""
    rows = sorted(plays(), key=lambda r: r[2])
    rng = random.Random(1)
    # Arrival: displaced by less than the watermark's delay.
    arrived = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 15))
    landed, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    step = len(arrived) // 6
    parts = [arrived[i : i + step] for i in range(0, len(arrived), step)]
    for i, part in enumerate(parts[:3]):
        land(spark, part, landed, f"{i}")
    online.run_available(context(stream(spark, landed, PLAYS)), out, state)
    some = spark.read.parquet(out).count()
    for i, part in enumerate(parts[3:]):
        land(spark, part, landed, f"{i + 3}")
    online.run_available(context(stream(spark, landed, PLAYS)), out, state)
    assert 0 < some < spark.read.parquet(out).count()
    end = max(r[2] for r in rows)
    land(spark, [(SENTINEL, 0, end + 1000, None, None)], landed, "y")
    online.run_available(context(stream(spark, landed, PLAYS)), out, state)
    # Far behind the watermark by now: dropped, and nothing written twice.
    land(spark, [(0, 1, 5, "shot", 0.5), (SENTINEL, 1, end + 2000, None, None)], landed, "z")
    online.run_available(context(stream(spark, landed, PLAYS)), out, state)
    assert rows_of(spark.read.parquet(out)) == rows_of(batch_context(frame(spark, rows)))


def test_state_of_an_idle_game_is_dropped(spark, tmp_path):
    landed, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    first, later = [(0, 1, 10, "shot", 1.0), (0, 2, 11, "hit", 2.0)], [(0, 3, 9000, "hit", 3.0)]
    land(spark, first, landed, "a")
    land(spark, [(SENTINEL, 0, 8000, None, None)], landed, "b")
    land(spark, [(SENTINEL, 1, 8001, None, None)], landed, "c")
    land(spark, later, landed, "ca")
    land(spark, [(SENTINEL, 2, 20_000, None, None)], landed, "d")
    online.run_available(context(stream(spark, landed, PLAYS)), out, state)
    got = {r["event_id"]: r["prev"] for r in spark.read.parquet(out).where("game_id = 0").collect()}
    # An hour without rows: the third event finds no context any more.
    assert got == {1: None, 2: "shot", 3: None}


def test_context_needs_earlier_rows(spark, tmp_path):
    df = spark.readStream.schema(PLAYS).parquet(str(tmp_path))
    for lags, counts in (({"n": ("x", -1)}, {}), ({}, {"n": (F.lit(True), "axis", -5, 0)}), ({}, {"a": (F.lit(True), "axis", -5, -1), "b": (F.lit(True), "x", -5, -1)})):
        with pytest.raises(ValueError):
            online.online_context(df, ["game_id"], "event_id", "ts", lags, counts)


SERIES = "goalie_id bigint, season bigint, ts timestamp, talent double, age double, shots_faced bigint"


def series_frame(spark, rows):
    made = spark.createDataFrame(rows, "goalie_id bigint, season bigint, talent double, age double, shots_faced bigint")
    return made.select("goalie_id", "season", F.timestamp_seconds(F.col("season") * 1000).alias("ts"), "talent", "age", "shots_faced")


@pytest.mark.parametrize("seed", [0, 1])
def test_filter_of_a_stream(spark, tmp_path, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(5):
        age = 20 + float(rng.random())
        for s in range(1, int(rng.integers(2, 12))):
            age += float(rng.choice([1.0, 1.0, 2.0]))
            rows.append((g, 2000 + s, float(rng.normal(0, 0.01)), age, int(rng.integers(50, 2000))))
    rows.append((9, 2003, 0.5, 25.0, 100))  # one season only: no series
    drift = spark.createDataFrame([(18.0, 0.001), (25.0, 0.0), (33.0, -0.002)], "age double, yearly_drift double")

    def run():
        filtered = online.online_filter(stream(spark, landed, SERIES), drift, "ts", late="4000 seconds")
        online.run_available(filtered, out, state)

    landed, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    # Seasons arrive up to three places late.
    arrived = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 3))
    step = max(1, len(arrived) // 5)
    for i in range(0, len(arrived), step):
        land(spark, arrived[i : i + step], landed, f"{i}", series_frame)
        if i < 3 * step:
            run()
    land(spark, [(-1, 9000, 0.0, 30.0, 100)], landed, "end", series_frame)
    run()
    written = spark.read.parquet(out).where("goalie_id >= 0")
    got = written.where("final").select("goalie_id", "season", "step", "kalman_talent", "variance").toPandas()
    batch = K.kalman_filter(K.steps(series_frame(spark, rows), drift)).select("goalie_id", "season", "step", "kalman_talent", "variance").toPandas()
    order = ["goalie_id", "step"]
    pd.testing.assert_frame_equal(got.sort_values(order).reset_index(drop=True), batch.sort_values(order).reset_index(drop=True), rtol=1e-12)
    # The last provisional value of every step is the final one.
    assert written.where("NOT final").select("goalie_id", "season").distinct().count() == len(rows)
