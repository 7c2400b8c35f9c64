"""Queries of landed documents, datasets and ingestion state."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinkflow.operators import topk
from rinkflow.plans.features import shift_seconds
from rinkflow.registry.core import register
from rinkflow.registry.sql import part, using
from rinkflow.schemas import PBP_DOCUMENT, SCHEDULE_PAGE, SHIFT_DOCUMENT, SHOT_TYPES
from rinkflow.session import fresh_path
from rinkflow.sources import datasets, roles
from rinkflow.sources import documents as D
from rinkflow.streaming import ingest

# A document holds at most this many events, so that no document grows with its game.
CHUNK = 4096


def _documents(df, keys, item, head):
    """Rows grouped into JSON documents of bounded length."""
    chunked = df.withColumn("chunk", F.floor(F.col("event_id") / CHUNK))
    packed = chunked.groupBy(*keys, "chunk").agg(F.collect_list(item).alias("items"))
    return packed.select(*keys, "chunk", F.to_json(head, {"ignoreNullFields": "true"}).alias("doc"))


def pbp_documents(spark, path):
    p = roles.pbp(spark, path)
    item = F.struct(
        F.col("event_id").alias("eventId"),
        F.struct(F.col("period").alias("number"), F.col("period_type").alias("periodType")).alias("periodDescriptor"),
        F.col("time_in_period").alias("timeInPeriod"),
        F.col("event_type").alias("typeDescKey"),
        F.struct(
            F.col("x_coord").alias("xCoord"),
            F.col("y_coord").alias("yCoord"),
            F.col("goalie_in_net_id").alias("goalieInNetId"),
            F.col("shot_type").alias("shotType"),
            F.col("event_owner_team_id").alias("eventOwnerTeamId"),
        ).alias("details"),
    )
    keys = ["game_id", "season", "home_team_id", "away_team_id", "home_team_abbrev", "away_team_abbrev"]
    head = F.struct(
        F.col("game_id").alias("id"),
        "season",
        F.struct(F.col("home_team_id").alias("id"), F.col("home_team_abbrev").alias("abbrev")).alias("homeTeam"),
        F.struct(F.col("away_team_id").alias("id"), F.col("away_team_abbrev").alias("abbrev")).alias("awayTeam"),
        F.col("items").alias("plays"),
    )
    return _documents(p, keys, item, head)


_FLAT = """
SELECT game_id, season, '' AS venue, home_team_id, away_team_id, home_team_abbrev, away_team_abbrev, event_id, period, period_type,
  time_in_period, '' AS time_remaining, event_type, x_coord, y_coord, goalie_in_net_id, shot_type, event_owner_team_id, '' AS zone_code FROM pbp"""
_FLAT_COLUMNS = (
    "game_id season venue home_team_id away_team_id home_team_abbrev away_team_abbrev event_id period period_type time_in_period "
    "time_remaining event_type x_coord y_coord goalie_in_net_id shot_type event_owner_team_id zone_code"
).split()


@register("flatten_nested_events", using("pbp") + _FLAT, "x_coord y_coord")
def flatten_nested_events(spark, path):
    docs = D.parse_documents(pbp_documents(spark, path).select("doc"), "doc", PBP_DOCUMENT)
    return D.flatten_pbp(D.split_bad(docs)[0]).select(*_FLAT_COLUMNS)


@register("empty_documents", using("pbp") + f"""
SELECT game_id AS id, season, count(*) AS n_empty FROM (
  SELECT game_id, season, event_id // {CHUNK} AS chunk FROM pbp GROUP BY 1, 2, 3 HAVING chunk % 2 = 0) GROUP BY 1, 2""")
def empty_documents(spark, path):
    texts = pbp_documents(spark, path)
    emptied = texts.withColumn(
        "doc", F.when(F.col("chunk") % 2 == 0, F.regexp_replace("doc", r'"plays":\[.*\]\}$', '"plays":[]}')).otherwise(F.col("doc"))
    )
    docs = D.parse_documents(emptied.select("doc"), "doc", PBP_DOCUMENT)
    return D.empty_documents(docs).groupBy("id", "season").agg(F.count(F.lit(1)).alias("n_empty"))


@register("quarantine", using("pbp") + f"""
SELECT chunk % 3 = 0 AS broken, count(*) AS n_documents, CAST(sum(n) AS BIGINT) AS n_events
FROM (SELECT game_id, season, event_id // {CHUNK} AS chunk, count(*) AS n FROM pbp GROUP BY 1, 2, 3) GROUP BY 1""")
def quarantine(spark, path):
    texts = pbp_documents(spark, path)
    cut = texts.withColumn("doc", F.expr("if(chunk % 3 = 0, substring(doc, 1, length(doc) - 2), doc)"))
    events = F.size(F.split("doc", '"eventId"')) - 1
    docs = D.parse_documents(cut.select("doc", events.cast("bigint").alias("n_events"), F.col("doc").alias("raw")).drop("raw"), "doc", PBP_DOCUMENT)
    good, bad = D.split_bad(docs)
    sides = [df.select(F.lit(b).alias("broken"), "n_events") for df, b in ((good, False), (bad, True))]
    return sides[0].unionByName(sides[1]).groupBy("broken").agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum("n_events").alias("n_events")
    )


@register("flatten_fallback_key", using("shifts") + """
SELECT game_id, player_id, team_id, period, start_sec, end_sec, type_code::BIGINT AS type_code FROM shifts""")
def flatten_fallback_key(spark, path):
    s = roles.shifts(spark, path).withColumn("event_id", F.xxhash64("game_id", "period", "team_id", "player_id", "start_time") % 1_000_000)
    item = F.struct(
        F.when(F.col("player_id") % 2 == 0, F.col("game_id")).alias("gameId"),
        F.col("player_id").alias("playerId"),
        F.col("team_id").alias("teamId"),
        "period",
        F.col("start_time").alias("startTime"),
        F.col("end_time").alias("endTime"),
        F.col("type_code").alias("typeCode"),
    )
    texts = _documents(s, ["game_id"], item, F.struct(F.col("items").alias("data")))
    docs = D.parse_documents(texts.select(F.col("game_id").alias("doc_game_id"), "doc"), "doc", SHIFT_DOCUMENT)
    flat = D.flatten_shifts(docs)
    return shift_seconds(flat).select("game_id", "player_id", "team_id", "period", "start_sec", "end_sec", "type_code")


def schedule(spark, path):
    """Schedule pages of one team pair and season each, flattened."""
    games = roles.pbp(spark, path).groupBy("game_id", "season", "home_team_id", "away_team_id", "period").agg(F.count(F.lit(1)).alias("n"))
    item = F.struct(
        F.col("game_id").alias("id"),
        "season",
        (1 + F.col("game_id") % 4).alias("gameType"),
        F.when(F.col("n") % 3 == 0, "LIVE").when(F.col("n") % 3 == 1, "OFF").otherwise("FINAL").alias("gameState"),
        F.struct(F.col("home_team_id").alias("id")).alias("homeTeam"),
        F.struct(F.col("away_team_id").alias("id")).alias("awayTeam"),
    )
    dated = games.withColumn("date", F.concat(F.lit("2024-01-"), F.lpad(F.col("period").cast("string"), 2, "0")))
    cut = dated.withColumn("chunk", F.floor(F.col("game_id") / CHUNK))
    days = cut.groupBy("season", "chunk", "date").agg(F.collect_list(item).alias("games"))
    pages = days.select(F.to_json(F.struct(F.array(F.struct("date", "games")).alias("gameWeek"))).alias("doc"))
    return D.flatten_schedule(D.parse_documents(pages, "doc", SCHEDULE_PAGE))


part("schedule", ("pbp",), """
SELECT game_id, season, 1 + game_id % 4 AS game_type, CASE n % 3 WHEN 0 THEN 'LIVE' WHEN 1 THEN 'OFF' ELSE 'FINAL' END AS game_state,
  '2024-01-' || lpad(CAST(period AS VARCHAR), 2, '0') AS date, home_team_id, away_team_id, '' AS home_team_abbrev
FROM (SELECT game_id, season, home_team_id, away_team_id, period, count(*) AS n FROM pbp GROUP BY ALL)""")


@register("flatten_two_level", using("schedule") + "SELECT * FROM schedule")
def flatten_two_level(spark, path):
    return schedule(spark, path).select(
        "game_id", "season", "game_type", "game_state", "date", "home_team_id", "away_team_id", "home_team_abbrev"
    )


@register("eligible_games", using("schedule") + """
SELECT DISTINCT game_id FROM schedule WHERE game_type IN (2, 3) AND game_state IN ('OFF', 'FINAL') AND season = 20222023""")
def eligible_games(spark, path):
    return D.eligible_games(schedule(spark, path), 20222023).select("game_id").distinct().orderBy("game_id")


@register("dedup_first", using("schedule") + """
SELECT game_id, arg_min(season, date) AS season, min(date) AS date, arg_min(game_state, date) AS game_state FROM schedule GROUP BY 1""")
def dedup_first(spark, path):
    rows = schedule(spark, path).select("game_id", "season", "date", "game_state")
    return topk.dedup_first(rows, "game_id", "date")


part("states", ("status_log",), """
SELECT data_type, game_id, done IS NOT NULL AS completed, coalesce(bad > coalesce(done, -1), false) AS failed,
  CASE WHEN bad > coalesce(done, -1) THEN message END AS message
FROM (SELECT data_type, game_id, max(CASE WHEN state = 'complete' THEN seq END) AS done, max(CASE WHEN state = 'failed' THEN seq END) AS bad,
    arg_max(message, CASE WHEN state = 'failed' THEN seq END) AS message FROM status_log GROUP BY 1, 2)""")


@register("status_latest", using("states") + "SELECT * FROM states")
def status_latest(spark, path):
    return ingest.status_latest(roles.status_log(spark, path))


@register("ingest_summary", using("states") + """
SELECT data_type, count_if(completed) AS n_completed, count_if(failed) AS n_failed, count(*) AS n_total FROM states GROUP BY 1""".replace(
    "count_if(completed)", "CAST(count_if(completed) AS BIGINT)").replace("count_if(failed)", "CAST(count_if(failed) AS BIGINT)"))
def ingest_summary(spark, path):
    return ingest.status_counts(status_latest(spark, path))


@register("resume_pending", using("states") + """
SELECT c_custkey AS game_id FROM customer WHERE c_custkey NOT IN (SELECT game_id FROM states WHERE completed AND data_type = 'pbp')""")
def resume_pending(spark, path):
    ids = roles.table(spark, path, "customer").select(F.col("c_custkey").alias("game_id"))
    return ingest.pending(ids, status_latest(spark, path).filter(F.col("data_type") == "pbp"))


@register("resume_pending_capped", using("states") + """
SELECT c_custkey AS game_id FROM customer WHERE c_custkey NOT IN (SELECT game_id FROM states WHERE completed AND data_type = 'pbp')
ORDER BY 1 LIMIT 25""")
def resume_pending_capped(spark, path):
    ids = roles.table(spark, path, "customer").select(F.col("c_custkey").alias("game_id"))
    return ingest.pending(ids, status_latest(spark, path).filter(F.col("data_type") == "pbp"), max_n=25)


@register("lookup_last_wins", using("status_log") + "SELECT game_id, arg_max(message, seq) AS message FROM status_log GROUP BY 1")
def lookup_last_wins(spark, path):
    return datasets.lookup_table(roles.status_log(spark, path), "game_id", "message", "seq")


@register("union_by_name", """
SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_totalprice, NULL::VARCHAR AS o_orderstatus FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, CAST(o_custkey AS DOUBLE), NULL, o_orderstatus FROM orders WHERE o_orderkey % 2 = 1""", "o_custkey o_totalprice")
def union_by_name(spark, path):
    orders = roles.table(spark, path, "orders")
    target = fresh_path(spark, "mixed")
    even = orders.filter(F.col("o_orderkey") % 2 == 0).select("o_orderkey", "o_custkey", "o_totalprice")
    odd = orders.filter(F.col("o_orderkey") % 2 == 1).select("o_orderkey", F.col("o_custkey").cast("double").alias("o_custkey"), "o_orderstatus")
    even.write.parquet(f"{target}/a")
    odd.write.parquet(f"{target}/b")
    return datasets.read_union_by_name(spark, target)


def _views(spark, path):
    tables = {"raw_pbp": roles.pbp(spark, path), "raw_shifts": roles.shifts(spark, path), "game_schedule": schedule(spark, path)}
    return datasets.register_views(spark, tables, SHOT_TYPES)


@register("shots_view", using("pbp") + """
SELECT season, event_type, count(*) AS n FROM pbp WHERE event_type IN ('shot-on-goal', 'goal', 'missed-shot') GROUP BY 1, 2""")
def shots_view(spark, path):
    _views(spark, path)
    return spark.table("v_shots").groupBy("season", "event_type").agg(F.count(F.lit(1)).alias("n"))


@register("table_counts", using("pbp", "shifts", "schedule") + """
SELECT 'raw_pbp' AS name, count(*) AS n_rows FROM pbp UNION ALL SELECT 'raw_shifts', count(*) FROM shifts
UNION ALL SELECT 'game_schedule', count(*) FROM schedule
UNION ALL SELECT 'v_shots', count(*) FROM pbp WHERE event_type IN ('shot-on-goal', 'goal', 'missed-shot')""")
def table_counts(spark, path):
    return datasets.table_counts(spark, _views(spark, path))
