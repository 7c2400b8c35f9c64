"""Clock text, season codes and ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_seconds(clock: Column) -> Column:
    """Seconds of an ``MM:SS`` text; null when a part is not a number."""
    minutes = F.split_part(clock, F.lit(":"), F.lit(1)).try_cast("bigint")
    seconds = F.split_part(clock, F.lit(":"), F.lit(2)).try_cast("bigint")
    return minutes * 60 + seconds


def clock_regex(clock: Column) -> Column:
    """Seconds of a trimmed text of digits, a colon and exactly two digits; null for anything else."""
    pattern = r"^(\d+):(\d{2})$"
    text = F.trim(clock)
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit("")).try_cast("bigint")
    return part(1) * 60 + part(2)


def season_code(start_year: Column) -> Column:
    """Eight-digit season code such as 20242025."""
    return start_year.cast("bigint") * 10_000 + start_year.cast("bigint") + 1


def season_start_year(season: Column) -> Column:
    return F.floor(season / 10_000).cast("bigint")


def season_start(season: Column) -> Column:
    """October 1 of the season's first year."""
    return F.make_date(season_start_year(season).cast("int"), F.lit(10), F.lit(1))


def age_years(birth: Column, at: Column) -> Column:
    return F.datediff(at, birth) / F.lit(365.25)


def elapsed(now: Column, then: Column, default: float = 999.0) -> Column:
    """Seconds between two clocks; the default where one is missing."""
    return F.coalesce((now - then).cast("double"), F.lit(float(default)))
