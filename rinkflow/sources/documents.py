"""Landed JSON documents turned into typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkflow.schemas import DETAILS, PBP_DOCUMENT, SCHEDULE_PAGE, SHIFT_DOCUMENT

CORRUPT = "_corrupt_record"


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document per file, parsed with a fixed schema; broken ones keep their text in the corrupt column."""
    raw = spark.read.text(path, wholetext=True).withColumn("source_file", F.col("_metadata.file_path"))
    return parse_documents(raw, "value", schema)


def parse_documents(raw: DataFrame, text: str, schema: str) -> DataFrame:
    """Parse a column of JSON text; broken documents keep their text in the corrupt column."""
    full = f"{schema}, {CORRUPT} STRING"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    others = [c for c in raw.columns if c != text]
    # As the input of a generator the text is parsed once, however many fields and filters follow.
    return raw.select(*others, F.inline(F.array(F.from_json(text, full, options))))


def split_bad(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good documents without the corrupt column, and the broken ones."""
    return docs.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), docs.filter(F.col(CORRUPT).isNotNull())


def flatten_pbp(docs: DataFrame) -> DataFrame:
    """One row per play with the game's context; documents without plays give none."""
    play = docs.select(
        F.col("id").alias("game_id"),
        "season",
        F.col("gameType").alias("game_type"),
        _text("venue.default").alias("venue"),
        F.col("homeTeam.id").alias("home_team_id"),
        F.col("awayTeam.id").alias("away_team_id"),
        _text("homeTeam.abbrev").alias("home_team_abbrev"),
        _text("awayTeam.abbrev").alias("away_team_abbrev"),
        F.explode("plays").alias("p"),
    )
    play = play.select("*", F.explode(F.array(F.from_json("p.details", DETAILS))).alias("d"))
    return play.select(
        "game_id",
        "season",
        "game_type",
        "venue",
        "home_team_id",
        "away_team_id",
        "home_team_abbrev",
        "away_team_abbrev",
        F.col("p.eventId").alias("event_id"),
        F.col("p.periodDescriptor.number").alias("period"),
        _text("p.periodDescriptor.periodType").alias("period_type"),
        _text("p.timeInPeriod").alias("time_in_period"),
        _text("p.timeRemaining").alias("time_remaining"),
        _text("p.situationCode").alias("situation_code"),
        _text("p.typeDescKey").alias("event_type"),
        F.col("p.typeCode").alias("event_type_code"),
        F.col("d.xCoord").alias("x_coord"),
        F.col("d.yCoord").alias("y_coord"),
        F.col("d.shootingPlayerId").alias("shooting_player_id"),
        F.col("d.scoringPlayerId").alias("scoring_player_id"),
        F.col("d.assist1PlayerId").alias("assist1_player_id"),
        F.col("d.assist2PlayerId").alias("assist2_player_id"),
        F.col("d.goalieInNetId").alias("goalie_in_net_id"),
        F.col("d.shotType").alias("shot_type"),
        F.col("d.eventOwnerTeamId").alias("event_owner_team_id"),
        _text("d.zoneCode").alias("zone_code"),
        F.when(F.col("p.details") != "{}", F.col("p.details")).alias("details_json"),
    )


def empty_documents(docs: DataFrame, items: str = "plays") -> DataFrame:
    """Documents that give no rows."""
    return docs.filter(F.coalesce(F.size(F.col(items)), F.lit(0)) <= 0)


def flatten_shifts(docs: DataFrame, doc_id: str = "doc_game_id") -> DataFrame:
    """One row per shift; a missing game id falls back to the document's."""
    return docs.select(doc_id, F.explode("data").alias("s")).select(
        F.coalesce(F.col("s.gameId"), F.col(doc_id)).alias("game_id"),
        F.col("s.playerId").alias("player_id"),
        F.col("s.teamId").alias("team_id"),
        _text("s.teamAbbrev").alias("team_abbrev"),
        _text("s.firstName").alias("first_name"),
        _text("s.lastName").alias("last_name"),
        F.col("s.period").alias("period"),
        _text("s.startTime").alias("start_time"),
        _text("s.endTime").alias("end_time"),
        _text("s.duration").alias("duration"),
        F.col("s.shiftNumber").alias("shift_number"),
        F.col("s.typeCode").alias("type_code"),
    )


def flatten_schedule(pages: DataFrame) -> DataFrame:
    """One row per game of a schedule page; the date comes from the outer level."""
    return (
        pages.select(F.explode("gameWeek").alias("day"))
        .select(F.col("day.date").alias("date"), F.explode("day.games").alias("g"))
        .select(
            F.col("g.id").alias("game_id"),
            F.col("g.season").alias("season"),
            F.col("g.gameType").alias("game_type"),
            F.col("g.gameState").alias("game_state"),
            "date",
            _text("g.venue.default").alias("venue"),
            F.col("g.homeTeam.id").alias("home_team_id"),
            _text("g.homeTeam.abbrev").alias("home_team_abbrev"),
            F.col("g.awayTeam.id").alias("away_team_id"),
            _text("g.awayTeam.abbrev").alias("away_team_abbrev"),
        )
    )


def eligible_games(games: DataFrame, season: int | None = None) -> DataFrame:
    """Finished regular-season and playoff games, optionally of one season."""
    # Game types 2 (regular season) and 3 (playoffs); states of finished games.
    kept = games.filter(F.col("game_type").isin(2, 3) & F.col("game_state").isin("OFF", "FINAL"))
    return kept if season is None else kept.filter(F.col("season") == season)


SCHEMAS = {"pbp": PBP_DOCUMENT, "shifts": SHIFT_DOCUMENT, "schedule": SCHEDULE_PAGE}
