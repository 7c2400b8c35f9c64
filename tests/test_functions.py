import math

import pytest
from pyspark.sql import functions as F

from rinkflow.functions import clock, details, geometry, numeric


def value(spark, column, **inputs):
    kinds = {int: "bigint", float: "double", str: "string", type(None): "double"}
    df = spark.range(1).select(*[F.lit(v).cast(kinds[type(v)]).alias(k) for k, v in inputs.items()] or [F.lit(1).alias("one")])
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,seconds", [("00:00", 0), ("01:30", 90), ("20:00", 1200), ("", None), ("invalid", None), ("5:05", 305)])
def test_clock(spark, text, seconds):
    assert value(spark, clock.clock_regex(F.col("c")), c=text) == seconds
    assert value(spark, clock.clock_seconds(F.col("c")), c=text) == seconds


def test_clock_regex_is_strict(spark):
    for text in ("1:5", "1:555", "a1:55", "1:55x"):
        assert value(spark, clock.clock_regex(F.col("c")), c=text) is None
    assert value(spark, clock.clock_regex(F.col("c")), c=" 1:55 ") == 115


def test_seasons_and_ages(spark):
    assert value(spark, clock.season_code(F.col("y")), y=2024) == 20242025
    assert str(value(spark, clock.season_start(F.col("s")), s=20242025)) == "2024-10-01"
    age = clock.age_years(F.to_date(F.lit("1994-10-01")), clock.season_start(F.col("s")))
    assert value(spark, age, s=20242025) == pytest.approx(10958 / 365.25)


@pytest.mark.parametrize("x,y,net,distance,angle", [
    (0.0, 0.0, 89, 89, 0), (89.0, 42.0, 89, 42, 90), (60.0, 20.0, 89, math.sqrt(1241), 34.592), (-60.0, -20.0, -89, math.sqrt(1241), 34.592)])
def test_shots(spark, x, y, net, distance, angle):
    ax, ay = geometry.mirror(F.col("x"), F.col("n")), geometry.mirror(F.col("y"), F.col("n"))
    assert value(spark, geometry.net_distance(ax, ay), x=x, y=y, n=net) == pytest.approx(distance)
    assert value(spark, geometry.net_angle(ax, ay), x=x, y=y, n=net) == pytest.approx(angle, abs=1e-3)


def test_angle_behind_the_net(spark):
    ax, ay, net = geometry.mirror(F.col("x"), F.col("n")), geometry.mirror(F.col("y"), F.col("n")), F.col("n")
    inputs = {"x": -95.0, "y": 0.0, "n": -89}
    assert value(spark, geometry.net_angle(ax, ay, net, "reference"), **inputs) == -180
    assert abs(value(spark, geometry.net_angle(ax, ay, net), **inputs)) == 180


@pytest.mark.parametrize("dt,y,py,px,net,flag", [(2.0, -15.0, 15.0, 70.0, 89, 1), (2.0, 15.0, 25.0, 70.0, 89, 0), (5.0, -15.0, 15.0, 70.0, 89, 0), (2.0, -15.0, 15.0, -70.0, 89, 0)])
def test_royal_road(spark, dt, y, py, px, net, flag):
    c = geometry.royal_road(F.col("dt"), F.col("y"), F.col("py"), F.col("px"), F.col("net"))
    assert value(spark, c, dt=dt, y=y, py=py, px=px, net=net) == flag


@pytest.mark.parametrize("text,flag", [('{"goalieInNetId":5}', 0), ('{"goalieInNetId":null}', 1), ("{}", 1), ("bad{", 0), ("[1]", 1)])
def test_json_flag(spark, text, flag):
    assert value(spark, details.json_absent_flag(F.col("t"), "goalieInNetId"), t=text) == flag


def test_json_null_text(spark):
    assert spark.range(1).select(details.json_absent_flag(F.lit(None).cast("string"), "k").alias("v")).first()["v"] == 0
    c = details.json_coalesce(F.lit(None).cast("string"), F.col("t"), "shotType", "unknown")
    assert [value(spark, c, t=t) for t in ('{"shotType":"tip"}', "{}", "bad{")] == ["tip", "unknown", "unknown"]


def test_formats(spark):
    assert value(spark, numeric.fmt_season(F.col("s")), s=20242025) == "2024-25"
    assert value(spark, numeric.fmt_pct(F.col("p")), p=0.915) == ".915"
    assert value(spark, numeric.fmt_pct(F.col("p")), p=0.05) == ".050"
    assert value(spark, numeric.fmt_pct(F.col("p"), "reference"), p=0.05) == ".50"
    assert value(spark, numeric.fmt_signed(F.col("p")), p=0.01) == "+0.0100"
    assert value(spark, numeric.trend_label(F.col("a"), F.col("b")), a=0.01, b=0.01) == "STABLE"
    assert value(spark, numeric.obs_noise(4e-5, F.col("n")), n=900) == pytest.approx(8e-5)
    assert value(spark, numeric.safe_ratio(F.col("a"), F.col("b")), a=1, b=0) is None
    assert value(spark, numeric.safe_ratio(F.col("a"), F.col("b"), "reference"), a=1, b=0) == math.inf


def test_strength_text(spark):
    c = details.strength_state(F.col("o"), F.col("a"), F.col("hn"), F.col("an"))
    assert value(spark, c, o=2, a=2, hn=4, an=5) == "5v4"
    assert value(spark, c, o=1, a=2, hn=4, an=5) == "4v5"
    assert value(spark, c, o=1, a=2, hn=None, an=5) == "unknown"
