import json

import pytest
from pyspark.sql import functions as F

from rinkflow.plans.features import shift_seconds, skater_shifts, strength_counts
from rinkflow.schemas import PBP_DOCUMENT, SCHEDULE_PAGE, SHIFT_DOCUMENT
from rinkflow.sources import datasets
from rinkflow.sources import documents as D

def play(number, kind, clock, period=1, **details):
    """A play of an invented match; a kind that no list knows and plays without details are allowed."""
    out = {"eventId": number, "periodDescriptor": {"number": period, "periodType": "OT" if period > 3 else "REG"}, "timeInPeriod": clock,
           "timeRemaining": "", "situationCode": "1441", "typeDescKey": kind, "typeCode": 900 + number}
    return out | ({"details": details} if details else {})


# An invented match: no venue, a shot without an owner, an unknown kind, a play without details, overtime.
MATCH = {
    "id": 31, "season": 20312032, "gameType": 3, "homeTeam": {"id": 801, "abbrev": "OAK"}, "awayTeam": {"id": 802, "abbrev": "ELM"},
    "plays": [
        play(2, "period-start", "00:00"),
        play(4, "shot-on-goal", "07:41", xCoord=61.5, yCoord=-12, shootingPlayerId=71, goalieInNetId=90, shotType="backhand", eventOwnerTeamId=801, zoneCode="O"),
        play(6, "missed-shot", "11:08", 2, xCoord=-33, yCoord=4, shootingPlayerId=72, shotType="tip-in"),
        play(8, "mascot-race", "19:59", 3, zoneCode="N"),
        play(9, "goal", "02:30", 4, xCoord=-80, yCoord=1, scoringPlayerId=73, assist1PlayerId=71, goalieInNetId=91, eventOwnerTeamId=802, zoneCode="O"),
    ],
}
# Shifts in two periods: one row names its match, the others take it from the document.
CHART = {
    "data": [
        {"playerId": 71, "teamId": 801, "period": 1, "startTime": "07:00", "endTime": "07:41"},
        {"playerId": 71, "teamId": 801, "period": 2, "startTime": "07:00", "endTime": "08:00"},
        {"playerId": 72, "teamId": 801, "period": 1, "startTime": "07:30", "endTime": "08:10"},
        {"playerId": 75, "teamId": 802, "period": 1, "startTime": "06:50", "endTime": "07:50"},
        {"gameId": 32, "playerId": 76, "teamId": 802, "period": 1, "startTime": "07:40", "endTime": "07:40"},
        {"playerId": 90, "teamId": 802, "period": 1, "startTime": "00:00", "endTime": "20:00"},
    ]
}


@pytest.fixture
def landed(spark, tmp_path):
    def write(name, *docs):
        folder = tmp_path / name
        folder.mkdir(exist_ok=True)
        for i, d in enumerate(docs):
            (folder / f"{i}.json").write_text(d if isinstance(d, str) else json.dumps(d, indent=1))
        return str(folder)

    return write


def test_plays_without_venue_owner_or_details(spark, landed):
    docs = D.read_documents(spark, landed("plays", MATCH, {"id": 33, "plays": []}, {"id": 34}), PBP_DOCUMENT)
    rows = {r["event_id"]: r for r in D.flatten_pbp(docs).collect()}
    assert sorted(rows) == [2, 4, 6, 8, 9]
    assert {r["venue"] for r in rows.values()} == {""} and {r["home_team_abbrev"] for r in rows.values()} == {"OAK"}
    assert rows[2]["details_json"] is None and rows[2]["x_coord"] is None and rows[2]["zone_code"] == ""
    assert (rows[4]["x_coord"], rows[4]["shot_type"], rows[4]["event_owner_team_id"]) == (61.5, "backhand", 801)
    assert rows[6]["event_owner_team_id"] is None and rows[6]["goalie_in_net_id"] is None and rows[6]["shooting_player_id"] == 72
    assert rows[8]["event_type"] == "mascot-race" and json.loads(rows[8]["details_json"]) == {"zoneCode": "N"}
    assert (rows[9]["period"], rows[9]["period_type"], rows[9]["assist1_player_id"], rows[9]["assist2_player_id"]) == (4, "OT", 71, None)
    assert 33 in [r["id"] for r in D.empty_documents(docs).collect()]


def test_shifts_of_two_periods(spark, landed):
    docs = D.read_documents(spark, landed("chart", CHART, {"data": []}), SHIFT_DOCUMENT)
    rows = D.flatten_shifts(docs.withColumn("doc_game_id", F.lit(31).cast("bigint"))).collect()
    assert sorted(r["game_id"] for r in rows) == [31, 31, 31, 31, 31, 32]
    assert sorted((r["period"], r["end_time"]) for r in rows if r["player_id"] == 71) == [(1, "07:41"), (2, "08:00")]


def test_skaters_at_a_shot(spark, landed):
    """Second 461: the first shift of 71 has just ended; 72 and 75 are on; the goalie does not count."""
    shifts = D.flatten_shifts(D.read_documents(spark, landed("chart", CHART), SHIFT_DOCUMENT).withColumn("doc_game_id", F.lit(31).cast("bigint")))
    shot = D.flatten_pbp(D.read_documents(spark, landed("plays", MATCH), PBP_DOCUMENT)).filter("event_id = 4")
    shot = shot.withColumn("time_seconds", F.lit(461).cast("bigint"))
    goalies = spark.createDataFrame([(90,)], "player_id bigint")
    found = strength_counts(shot, shifts, goalies).first()
    assert (found["home_skaters"], found["away_skaters"]) == (1, 1)
    assert skater_shifts(shift_seconds(shifts), goalies).filter("player_id = 90").count() == 0


def test_a_cut_document_is_set_aside(spark, landed):
    good, bad = D.split_bad(D.read_documents(spark, landed("plays", MATCH, '{"id": 35, "season": 2031, "pl'), PBP_DOCUMENT).cache())
    assert [r["id"] for r in good.collect()] == [31] and bad.count() == 1


def test_schedule_pages(spark, landed):
    page = {"gameWeek": [
        {"date": "2024-10-08", "games": [
            {"id": 1, "season": 20242025, "gameType": 2, "gameState": "OFF", "venue": {"default": "A"}, "homeTeam": {"id": 1, "abbrev": "X"},
             "awayTeam": {"id": 2, "abbrev": "Y"}},
            {"id": 2, "season": 20242025, "gameType": 1, "gameState": "OFF"}]},
        {"date": "2024-10-09", "games": [{"id": 3, "season": 20242025, "gameType": 3, "gameState": "FUT"}, {"id": 4, "season": 20232024, "gameType": 3, "gameState": "FINAL"}]},
    ]}
    games = D.flatten_schedule(D.read_documents(spark, landed("schedule", page), SCHEDULE_PAGE))
    assert {r["game_id"]: r["date"] for r in games.collect()} == {1: "2024-10-08", 2: "2024-10-08", 3: "2024-10-09", 4: "2024-10-09"}
    assert [r["game_id"] for r in D.eligible_games(games, 20242025).collect()] == [1]
    assert sorted(r["game_id"] for r in D.eligible_games(games).collect()) == [1, 4]


def test_datasets(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, 20222023, 0.5), (2, 20232024, 1.5)], "id bigint, season bigint, v double")
    assert datasets.write_dataset(rows, path)
    assert not datasets.write_dataset(rows.limit(0), str(tmp_path / "none"))
    assert datasets.write_dataset(rows.filter("season = 20222023").withColumn("v", F.lit(9.0)), path)
    back = {r["id"]: r["v"] for r in datasets.read_union_by_name(spark, path).collect()}
    assert back == {1: 9.0, 2: 1.5}
    assert dict(datasets.read_union_by_name(spark, path).dtypes)["season"] == "bigint"
    assert datasets.read_union_by_name(spark, str(tmp_path / "absent")) is None
    assert datasets.read_optional(spark, str(tmp_path / "absent"), "a int").count() == 0
    with pytest.raises(ValueError):
        datasets.compare_sums({"n": 2, "v": 2.0}, {"n": 2, "v": 2.5})
    assert datasets.rewrite_dataset(rows, "rows", ["v"]).count() == 2
    nan = spark.createDataFrame([(1, float("nan")), (2, None), (3, 1.5)], "id int, v double")
    assert [json.loads(r["record"])["v"] for r in datasets.to_json_records(nan).orderBy("record").collect()] == [None, None, 1.5]
    assert datasets.require_tables(spark, ["no_such_table"]) == ["no_such_table"]
