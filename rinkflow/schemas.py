"""Fixed schemas, as DDL text, of the landed documents and the tables made from them."""

from __future__ import annotations

# Event types that count as shots, and the narrower list used for features.
SHOT_TYPES = ("shot-on-goal", "goal", "missed-shot")
ON_GOAL_TYPES = ("shot-on-goal", "goal")
# Events that count as traffic near the net.
TRAFFIC_TYPES = ("hit", "blocked-shot", "faceoff", "giveaway", "takeaway", "shot-on-goal", "missed-shot")


DETAILS = (
    "xCoord DOUBLE, yCoord DOUBLE, shootingPlayerId BIGINT, scoringPlayerId BIGINT, assist1PlayerId BIGINT, "
    "assist2PlayerId BIGINT, goalieInNetId BIGINT, shotType STRING, eventOwnerTeamId BIGINT, zoneCode STRING"
)

PBP_DOCUMENT = (
    "id BIGINT, season BIGINT, gameType BIGINT, venue STRUCT<default: STRING>, "
    "homeTeam STRUCT<id: BIGINT, abbrev: STRING>, awayTeam STRUCT<id: BIGINT, abbrev: STRING>, "
    "plays ARRAY<STRUCT<eventId: BIGINT, periodDescriptor: STRUCT<number: BIGINT, periodType: STRING>, "
    "timeInPeriod: STRING, timeRemaining: STRING, situationCode: STRING, typeDescKey: STRING, typeCode: BIGINT, "
    "details: STRING>>"
)

SHIFT_DOCUMENT = (
    "data ARRAY<STRUCT<gameId: BIGINT, playerId: BIGINT, teamId: BIGINT, teamAbbrev: STRING, firstName: STRING, "
    "lastName: STRING, period: BIGINT, startTime: STRING, endTime: STRING, duration: STRING, shiftNumber: BIGINT, "
    "typeCode: BIGINT>>"
)

SCHEDULE_PAGE = (
    "gameWeek ARRAY<STRUCT<date: STRING, games: ARRAY<STRUCT<id: BIGINT, season: BIGINT, gameType: BIGINT, "
    "gameState: STRING, venue: STRUCT<default: STRING>, homeTeam: STRUCT<id: BIGINT, abbrev: STRING>, "
    "awayTeam: STRUCT<id: BIGINT, abbrev: STRING>>>>>"
)

RAW_PBP = (
    "game_id BIGINT, season BIGINT, game_type BIGINT, venue STRING, home_team_id BIGINT, away_team_id BIGINT, "
    "home_team_abbrev STRING, away_team_abbrev STRING, event_id BIGINT, period BIGINT, period_type STRING, "
    "time_in_period STRING, time_remaining STRING, situation_code STRING, event_type STRING, event_type_code BIGINT, "
    "x_coord DOUBLE, y_coord DOUBLE, shooting_player_id BIGINT, scoring_player_id BIGINT, assist1_player_id BIGINT, "
    "assist2_player_id BIGINT, goalie_in_net_id BIGINT, shot_type STRING, event_owner_team_id BIGINT, "
    "zone_code STRING, details_json STRING"
)

RAW_SHIFTS = (
    "game_id BIGINT, player_id BIGINT, team_id BIGINT, team_abbrev STRING, first_name STRING, last_name STRING, "
    "period BIGINT, start_time STRING, end_time STRING, duration STRING, shift_number BIGINT, type_code BIGINT"
)

GAME_SCHEDULE = (
    "game_id BIGINT, season BIGINT, game_type BIGINT, date STRING, venue STRING, home_team_id BIGINT, "
    "home_team_abbrev STRING, away_team_id BIGINT, away_team_abbrev STRING"
)
