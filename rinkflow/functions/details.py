"""Team sides, strength text and JSON details."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def defending_team(owner: Column, home: Column, away: Column) -> Column:
    """The side that does not own the event; home when the owner is unknown."""
    return F.when(owner == home, away).otherwise(home)


def defending_abbrev(owner: Column, home: Column, away: Column, home_abbrev: Column, away_abbrev: Column) -> Column:
    return F.when(owner == home, away_abbrev).when(owner == away, home_abbrev)


def score_diff(owner: Column, home: Column, home_goals: Column, away_goals: Column) -> Column:
    return F.when(owner == home, home_goals - away_goals).otherwise(away_goals - home_goals)


def strength_state(owner: Column, away: Column, home_n: Column, away_n: Column) -> Column:
    """``{attackers}v{defenders}``, or ``unknown``."""
    h, a = home_n.cast("bigint").cast("string"), away_n.cast("bigint").cast("string")
    text = F.when(owner == away, F.concat(a, F.lit("v"), h)).otherwise(F.concat(h, F.lit("v"), a))
    return F.coalesce(text, F.lit("unknown"))


def json_absent_flag(text: Column, key: str) -> Column:
    """1 when valid JSON lacks the key or holds null there; 0 otherwise, also for invalid or missing text."""
    parsed = F.try_parse_json(text)
    value = F.try_variant_get(parsed, f"$.{key}", "string")
    return F.when(parsed.isNotNull() & value.isNull(), 1).otherwise(0)


def json_coalesce(value: Column, text: Column, key: str, default: str) -> Column:
    return F.coalesce(value, F.get_json_object(text, f"$.{key}"), F.lit(default))


def is_goal(event_type: Column) -> Column:
    return F.coalesce((event_type == "goal").cast("int"), F.lit(0))


def full_name(first: Column, last: Column) -> Column:
    return F.trim(F.concat_ws(" ", first, last))


def name_missing(key: Column, name: Column) -> Column:
    return name.isNull() | (name == key.cast("string"))


def compound_key(*parts: Column) -> Column:
    return F.concat_ws("_", *[p.cast("string") for p in parts])
