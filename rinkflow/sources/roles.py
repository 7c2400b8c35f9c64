"""The test tables seen as play-by-play, shifts, scored shots and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def _clock(seconds: str, pad: bool) -> str:
    minutes = f"cast(({seconds}) div 60 as string)"
    if pad:
        minutes = f"lpad({minutes}, 4, '0')"
    return f"{minutes} || ':' || lpad(cast(({seconds}) % 60 as string), 2, '0')"


def pbp(spark: SparkSession, path: str, pad: bool = True) -> DataFrame:
    """``events`` as play-by-play: users are games, days are periods."""
    base = table(spark, path, "events").selectExpr(
        "user_id AS game_id",
        "cast(20212022 + 10001 * floor((day(ts) - 1) / 10.0) as bigint) AS season",
        "2L AS game_type",
        "if(event_id % 53 = 0, '', 'arena_' || (user_id % 12)) AS venue",
        "1 + user_id % 8 AS home_team_id",
        "11 + user_id % 8 AS away_team_id",
        "event_id",
        "cast(day(ts) as bigint) AS period",
        "'REG' AS period_type",
        "cast(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) as bigint) AS time_seconds",
        # Event names of the test table and their roles.
        "CASE event_type WHEN 'purchase' THEN 'goal' WHEN 'click' THEN 'shot-on-goal' WHEN 'view' THEN 'missed-shot' "
        "WHEN 'signup' THEN 'faceoff' WHEN 'error' THEN 'hit' END AS event_type",
        "if(event_id % 37 != 0, (cast(get_json_object(props, '$.k') as double) - 50.0D) * 2, null) AS x_coord",
        "if(event_id % 37 != 0, value % 85 - 42.5D, null) AS y_coord",
        "if(event_id % 2 = 0, 1, 11) + user_id % 8 AS event_owner_team_id",
        "if(event_id % 41 != 0, 8470000 + (if(event_id % 2 = 0, 11, 1) + user_id % 8) * 10 + user_id % 3, null) "
        "AS goalie_in_net_id",
        "CASE WHEN event_id % 3 = 0 THEN null WHEN event_id % 4 = 0 THEN 'wrist' WHEN event_id % 4 = 1 THEN 'snap' "
        "ELSE 'slap' END AS shot_type",
    )
    return base.selectExpr(
        "*",
        "'T' || home_team_id AS home_team_abbrev",
        "'T' || away_team_id AS away_team_abbrev",
        f"{_clock('time_seconds', pad)} AS time_in_period",
        "CASE event_id % 5 WHEN 0 THEN '{}' WHEN 1 THEN '{\"goalieInNetId\":null}' WHEN 2 THEN 'bad{' "
        "ELSE '{\"goalieInNetId\":' || coalesce(goalie_in_net_id, 0) || ',\"shotType\":\"tip\"}' END AS details_json",
    )


def shifts(spark: SparkSession, path: str) -> DataFrame:
    """``events`` as shifts of 10 to 29 minutes; every sixth one belongs to a goalie."""
    return pbp(spark, path).selectExpr(
        "game_id",
        "period",
        "event_owner_team_id AS team_id",
        "if(event_id % 6 = 0, 8470000 + event_owner_team_id * 10 + game_id % 3, event_id % 25) AS player_id",
        f"{_clock('time_seconds', True)} AS start_time",
        f"{_clock('time_seconds + 600 + 60 * (event_id % 20)', True)} AS end_time",
        "517L AS type_code",
    )


def goalies(spark: SparkSession, path: str) -> DataFrame:
    """Known goalies."""
    return pbp(spark, path).filter(F.col("goalie_in_net_id").isNotNull()).select(
        F.col("goalie_in_net_id").alias("player_id")
    ).distinct()


def names(spark: SparkSession, path: str) -> DataFrame:
    """Goalie names from ``nation``, dealt to the known goalies; ids divisible by 7 have none."""
    nation = table(spark, path, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name"))
    ids = goalies(spark, path).select(F.col("player_id").alias("goalie_id")).filter(F.col("goalie_id") % 7 != 0)
    return ids.join(nation, ids.goalie_id % 25 == nation.k).select(
        "goalie_id", F.concat_ws(" ", "n_name", F.col("goalie_id").cast("string")).alias("goalie_name")
    )


def scored_lineitem(spark: SparkSession, path: str) -> DataFrame:
    """``lineitem`` as scored shots, for volume."""
    return table(spark, path, "lineitem").select(
        F.col("l_suppkey").alias("goalie_id"),
        F.year("l_shipdate").cast("bigint").alias("season"),
        F.col("l_orderkey").alias("game_id"),
        (F.col("l_partkey") % 32).alias("team_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("is_goal"),
        (F.lit(0.2) + 2 * F.col("l_discount")).alias("xg_prob"),
        F.col("l_quantity").alias("traffic_density"),
        F.col("l_tax").alias("puck_speed"),
    )


def series(spark: SparkSession, path: str) -> DataFrame:
    """``orders`` per nation and year as a talent series."""
    orders = table(spark, path, "orders").select("o_custkey", "o_totalprice", F.year("o_orderdate").cast("bigint").alias("season"))
    customer = table(spark, path, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("goalie_id")
    )
    return (
        orders.join(customer, "o_custkey")
        .groupBy("goalie_id", "season")
        .agg((F.avg("o_totalprice") / 1e6).alias("talent"), F.count(F.lit(1)).alias("shots_faced"))
        .withColumn("age", (F.col("season") - 1975 + F.col("goalie_id") % 5).cast("double"))
    )


def traded_series(spark: SparkSession, path: str) -> DataFrame:
    """``orders`` per nation, year and priority: a talent series with several rows, one for each team, in a season."""
    orders = table(spark, path, "orders").select(
        "o_custkey",
        "o_totalprice",
        F.year("o_orderdate").cast("bigint").alias("season"),
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("team_id"),
    )
    customer = table(spark, path, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("goalie_id")
    )
    return (
        orders.join(customer, "o_custkey")
        .groupBy("goalie_id", "team_id", "season")
        .agg((F.avg("o_totalprice") / 1e6).alias("talent"), F.count(F.lit(1)).alias("shots_faced"))
        .withColumn("age", (F.col("season") - 1975 + F.col("goalie_id") % 5).cast("double"))
    )


def curve(spark: SparkSession, path: str) -> DataFrame:
    """``part`` as points of a curve."""
    return table(spark, path, "part").select(
        F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 1000).alias("y")
    )


def status_log(spark: SparkSession, path: str) -> DataFrame:
    """``events`` as a log of document states."""
    eid = F.col("event_id")
    return table(spark, path, "events").select(
        F.when(eid % 2 == 0, "pbp").otherwise("shifts").alias("data_type"),
        F.col("user_id").alias("game_id"),
        F.when(F.col("event_type").isin("purchase", "click"), "complete").otherwise("failed").alias("state"),
        F.concat(F.lit("HTTP "), (500 + eid % 4).cast("string")).alias("message"),
        eid.alias("seq"),
    )
