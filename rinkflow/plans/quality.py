"""Checks of a play-by-play table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkflow.functions.clock import clock_regex
from rinkflow.functions.geometry import X_LIMIT, Y_LIMIT
from rinkflow.operators.sequences import neighbours
from rinkflow.operators.sizing import one_row, settle
from rinkflow.schemas import SHOT_TYPES
from rinkflow.sources.datasets import require_tables


# Names and summary texts of the checks.
BOUNDS, BOUNDS_TEXT = "Coordinate Bounds", "%,d out-of-bounds coordinates found (%.3f%% of %,d shots with coordinates)"
BIAS, BIAS_TEXT = "Arena Bias Detection", "%d arena(s) flagged for bias (>{sigma} sigma from league mean) out of %d total arenas"
SEQUENCE, SEQUENCE_TEXT = "Event Sequence Validation", "%d temporal anomalies found, %d games with >{limit} anomalies"
NO_EVENTS_TEXT = "No PBP data to validate"
MISSING = "Missing Data Audit"
MISSING_TEXT = "Max null-coordinate rate by season: %.1f%%. %d season/arena combinations exceed {limit}%% threshold."
PASSED_TEXT, FAILED_TEXT = "ALL CHECKS PASSED", "SOME CHECKS FAILED"


@dataclass(frozen=True)
class Check:
    """One row (check, passed, summary) and the rows behind it."""

    result: DataFrame
    details: DataFrame


def _result(totals: DataFrame, name: str, passed: Column, summary: Column) -> DataFrame:
    return totals.select(F.lit(name).alias("check"), passed.alias("passed"), summary.alias("summary"))


def _shots(pbp: DataFrame) -> DataFrame:
    return pbp.filter(F.col("event_type").isin(*SHOT_TYPES))


def _located(pbp: DataFrame) -> DataFrame:
    return _shots(pbp).filter(F.col("x_coord").isNotNull() & F.col("y_coord").isNotNull())


def _named(df: DataFrame) -> DataFrame:
    return df.filter(F.col("venue").isNotNull() & (F.col("venue") != ""))


def check_bounds(pbp: DataFrame, x_limit: float = X_LIMIT, y_limit: float = Y_LIMIT) -> Check:
    """Shots outside the rink."""
    outside = ~F.col("x_coord").between(-x_limit, x_limit) | ~F.col("y_coord").between(-y_limit, y_limit)
    shots = _located(pbp)
    totals = shots.agg(F.count_if(outside).alias("bad"), F.count(F.lit(1)).alias("n"))
    pct = F.coalesce(F.try_divide(F.col("bad") * 100.0, F.col("n")), F.lit(0.0))
    summary = F.format_string(BOUNDS_TEXT, F.col("bad"), pct, F.col("n"))
    details = shots.filter(outside).select("game_id", "event_id", "x_coord", "y_coord", "event_type", "venue")
    return Check(
        _result(totals, BOUNDS, F.col("bad") == 0, summary), details.orderBy("game_id", "event_id")
    )


def venue_stats(pbp: DataFrame, min_n: int = 100) -> DataFrame:
    """Mean and spread of shot positions per venue."""
    return (
        _named(_located(pbp))
        .groupBy("venue")
        .agg(
            F.count(F.lit(1)).alias("n_shots"),
            *[f(c).alias(f"{n}_{c[0]}") for n, f in (("mean", F.avg), ("std", F.stddev_samp)) for c in ("x_coord", "y_coord")],
        )
        .filter(F.col("n_shots") >= min_n)
    )


def check_venue_bias(pbp: DataFrame, min_n: int = 100, sigma: float = 2.0) -> Check:
    """Venues whose mean shot position lies more than ``sigma`` deviations from the mean of the venue means."""
    stats = settle(venue_stats(pbp, min_n)).df
    league = one_row(
        stats,
        mx=F.avg("mean_x"),
        my=F.avg("mean_y"),
        sx=F.stddev_samp("mean_x"),
        sy=F.stddev_samp("mean_y"),
    )
    scored = stats.withColumn("l", league)
    scored = scored.withColumns(
        {f"{a}_z": F.try_divide(F.abs(F.col(f"mean_{a}") - F.col(f"l.m{a}")), F.col(f"l.s{a}")) for a in "xy"}
    )
    flagged = scored.filter((F.col("x_z") > sigma) | (F.col("y_z") > sigma)).select(
        "venue",
        "n_shots",
        *[F.round(c, 2).alias(c) for c in ("mean_x", "mean_y", "std_x", "std_y")],
        F.round("x_z", 2).alias("x_zscore"),
        F.round("y_z", 2).alias("y_zscore"),
    )
    totals = _named(_shots(pbp)).agg(F.count_distinct("venue").alias("n")).withColumn(
        "bad", one_row(flagged, n=F.count(F.lit(1))).getField("n")
    )
    summary = F.format_string(BIAS_TEXT.format(sigma=sigma), F.col("bad"), F.col("n"))
    return Check(
        _result(totals, BIAS, F.col("bad") == 0, summary),
        flagged.orderBy(F.desc_nulls_last("x_zscore"), "venue"),
    )


def _text_order(c: Column) -> Column:
    """A whole number that orders text by its first bytes; the text itself decides among equals."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "utf-8"), 1, 7)), 14, "0"), 16, 10).cast("bigint")


def sequence_anomalies(pbp: DataFrame, min_gap: float = 2.0, compat: str = "fixed") -> DataFrame:
    """Events before their predecessor, and shots too soon after a faceoff or stoppage that follows a shot."""
    keys = ["game_id", "period"]
    timed = (
        pbp.filter(F.col("time_in_period").isNotNull() & (F.col("time_in_period") != ""))
        .select(*keys, "event_id", "event_type", "time_in_period")
        .withColumn("seconds", clock_regex(F.col("time_in_period")))
        .filter(F.col("seconds").isNotNull())
    )
    before = {"prev_event": ("event_type", 1), "prev2_event": ("event_type", 2), "prev_seconds": ("seconds", 1)}
    if compat == "reference":
        text = F.col("time_in_period")
        ordered = timed.withColumn("text_order", _text_order(text)).withColumn("text_tie", F.struct(text, F.col("event_id")))
        x = neighbours(ordered, keys, "text_order", before, tie="text_tie")
    else:
        x = neighbours(timed, keys, "event_id", before)
    gap = F.col("seconds") - F.col("prev_seconds")
    hasty = (
        (gap >= 0)
        & (gap < min_gap)
        & F.col("prev_event").isin("faceoff", "stoppage")
        & F.col("event_type").isin(*SHOT_TYPES)
        & F.col("prev2_event").isin(*SHOT_TYPES)
    )
    issue = F.when(gap < 0, "non_monotonic").when(hasty, "impossible_sequence")
    return (
        x.withColumn("issue", issue)
        .filter(F.col("issue").isNotNull())
        .select(
            *keys, "event_id", "prev_event", F.col("event_type").alias("curr_event"), gap.cast("double").alias("time_gap_s"), "issue"
        )
    )


def sequence_flagged(anomalies: DataFrame, max_per_group: int = 5, compat: str = "fixed") -> DataFrame:
    """Games with more anomalies than allowed, counted per game (per game and period with ``compat="reference"``)."""
    keys = ["game_id", "period"] if compat == "reference" else ["game_id"]
    counts = anomalies.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_anomalies"))
    return counts.filter(F.col("n_anomalies") > max_per_group)


def check_sequences(pbp: DataFrame, min_gap: float = 2.0, max_per_group: int = 5, compat: str = "fixed") -> Check:
    anomalies = sequence_anomalies(pbp, min_gap, compat)
    flagged = sequence_flagged(anomalies, max_per_group, compat)
    totals = anomalies.agg(F.count(F.lit(1)).alias("n")).withColumn(
        "bad", one_row(flagged, n=F.count_distinct("game_id")).getField("n")
    )
    if pbp.limit(1).count() == 0:
        summary = F.lit(NO_EVENTS_TEXT)
    else:
        summary = F.format_string(SEQUENCE_TEXT.format(limit=max_per_group), F.col("n"), F.col("bad"))
    return Check(_result(totals, SEQUENCE, F.col("bad") == 0, summary), anomalies)


def missing_rates(pbp: DataFrame, by: list[str], max_pct: float | None = None) -> DataFrame:
    """Share of shots without coordinates per group, optionally only groups above ``max_pct``."""
    missing = F.col("x_coord").isNull() | F.col("y_coord").isNull()
    rates = pbp.groupBy(*by).agg(F.count(F.lit(1)).alias("total_shots"), F.count_if(missing).alias("null_coords"))
    pct = 100.0 * F.col("null_coords") / F.col("total_shots")
    kept = rates if max_pct is None else rates.filter(pct > max_pct)
    return kept.withColumn("null_pct", F.round(pct, 2))


def union_scoped(parts: dict[str, DataFrame]) -> DataFrame:
    """Tables of different columns on top of each other, each row tagged with its scope."""
    tagged = [df.withColumn("scope", F.lit(scope)) for scope, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def check_missing(pbp: DataFrame, max_pct: float = 10.0) -> Check:
    """Missing coordinates by season, and by season and venue above the limit."""
    shots = _shots(pbp)
    seasons = missing_rates(shots, ["season"])
    venues = missing_rates(_named(shots), ["season", "venue"], max_pct)
    totals = seasons.agg(F.coalesce(F.max("null_pct"), F.lit(0.0)).alias("worst")).withColumn(
        "bad", one_row(venues, n=F.count(F.lit(1))).getField("n")
    )
    summary = F.format_string(MISSING_TEXT.format(limit=float(max_pct)), F.col("worst"), F.col("bad"))
    return Check(
        _result(totals, MISSING, (F.col("bad") == 0) & (F.col("worst") <= max_pct), summary),
        union_scoped({"season": seasons, "season_arena": venues}),
    )


def shot_sums(pbp: DataFrame, x_limit: float = X_LIMIT, y_limit: float = Y_LIMIT) -> DataFrame:
    """All that three checks need of the shots, by season and venue, and the number of events, from one scan and one aggregate."""
    shot = F.col("event_type").isin(*SHOT_TYPES)
    missing = F.col("x_coord").isNull() | F.col("y_coord").isNull()
    outside = ~F.col("x_coord").between(-x_limit, x_limit) | ~F.col("y_coord").between(-y_limit, y_limit)
    means = [F.avg(F.when(shot & ~missing, F.col(f"{c}_coord"))).alias(f"mean_{c}") for c in "xy"]
    return pbp.groupBy("season", "venue").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(shot).alias("n_shots"),
        F.count_if(shot & missing).alias("n_missing"),
        F.count_if(shot & ~missing).alias("n_located"),
        F.count_if(shot & ~missing & outside).alias("n_outside"),
        *means,
    )


def anomaly_sums(pbp: DataFrame, min_gap: float = 2.0, max_per_group: int = 5) -> DataFrame:
    """Rows of the table, anomalies, and games with too many of them, as one row: one windowed pass, counted per game before it ends."""
    games = sequence_anomalies(pbp, min_gap).groupBy("game_id").agg(F.count(F.lit(1)).alias("n"))
    return games.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > max_per_group).alias("bad"))


def run_checks(
    pbp: DataFrame | None, min_n: int = 100, min_gap: float = 2.0, max_pct: float = 10.0, sigma: float = 2.0, max_per_group: int = 5, **limits: float
) -> DataFrame:
    """All checks in order and the overall result as last row; without a table, the prerequisite fails.

    The table is read once for its sums by season and venue; bounds, venue bias, missing data and whether there are events at all
    follow from these few rows. The order of events takes one windowed pass. Each is computed once.
    """
    if pbp is None:
        raise ValueError("raw_pbp table not found: load the landed tables first")
    sums = settle(shot_sums(pbp, **limits)).df
    events = sums.agg(F.sum("n_events")).first()[0]
    order = settle(anomaly_sums(pbp, min_gap, max_per_group)).df
    sums = sums.filter("n_shots > 0")
    named = sums.filter(F.col("venue").isNotNull() & (F.col("venue") != ""))

    bounds = sums.agg(F.coalesce(F.sum("n_outside"), F.lit(0)).alias("bad"), F.coalesce(F.sum("n_located"), F.lit(0)).alias("n"))
    pct = F.coalesce(F.try_divide(F.col("bad") * 100.0, F.col("n")), F.lit(0.0))
    rows = [_result(bounds, BOUNDS, F.col("bad") == 0, F.format_string(BOUNDS_TEXT, "bad", pct, "n"))]

    mean = {c: (F.sum(F.col("n_located") * F.coalesce(f"mean_{c}", F.lit(0.0))) / F.sum("n_located")).alias(f"mean_{c}") for c in "xy"}
    venues = named.groupBy("venue").agg(F.sum("n_located").alias("n"), *[F.when(F.sum("n_located") > 0, m).alias(f"mean_{c}") for c, m in mean.items()])
    counted = venues.filter(F.col("n") >= min_n)
    league = one_row(counted, **{f"m{c}": F.avg(f"mean_{c}") for c in "xy"}, **{f"s{c}": F.stddev_samp(f"mean_{c}") for c in "xy"})
    far = [F.try_divide(F.abs(F.col(f"mean_{c}") - F.col(f"l.m{c}")), F.col(f"l.s{c}")) > sigma for c in "xy"]
    flagged = counted.withColumn("l", league).filter(far[0] | far[1])
    bias = venues.agg(F.count(F.lit(1)).alias("n")).withColumn("bad", one_row(flagged, n=F.count(F.lit(1))).getField("n"))
    rows.append(_result(bias, BIAS, F.col("bad") == 0, F.format_string(BIAS_TEXT.format(sigma=sigma), "bad", "n")))

    text = F.format_string(SEQUENCE_TEXT.format(limit=max_per_group), "n", "bad") if events else F.lit(NO_EVENTS_TEXT)
    rows.append(_result(order, SEQUENCE, F.col("bad") == 0, text))

    def share(df: DataFrame, *by: str) -> DataFrame:
        return df.groupBy(*by).agg((100.0 * F.sum("n_missing") / F.sum("n_shots")).alias("pct"))

    many = share(named, "season", "venue").filter(F.col("pct") > max_pct)
    worst = share(sums, "season").agg(F.coalesce(F.max(F.round("pct", 2)), F.lit(0.0)).alias("worst"))
    worst = worst.withColumn("bad", one_row(many, n=F.count(F.lit(1))).getField("n"))
    text = F.format_string(MISSING_TEXT.format(limit=float(max_pct)), "worst", "bad")
    rows.append(_result(worst, MISSING, (F.col("bad") == 0) & (F.col("worst") <= max_pct), text))

    report = settle(reduce(DataFrame.unionByName, [r.withColumn("position", F.lit(i)) for i, r in enumerate(rows, 1)])).df
    overall = report.agg(F.bool_and("passed").alias("passed")).select(
        F.lit("Result").alias("check"),
        "passed",
        F.when(F.col("passed"), PASSED_TEXT).otherwise(FAILED_TEXT).alias("summary"),
        F.lit(len(rows) + 1).alias("position"),
    )
    return report.unionByName(overall)


def check_table(spark: SparkSession, name: str = "raw_pbp", **options: float) -> DataFrame:
    """``run_checks`` on a table of the catalog; the catalog is asked first."""
    missing = require_tables(spark, [name])
    return run_checks(None if missing else spark.table(name), **options)


def preview(details: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The first rows of a detail table and, on each, how many more there are."""
    more = F.greatest(one_row(details, n=F.count(F.lit(1))).getField("n") - n, F.lit(0))
    return details.orderBy(*[F.asc_nulls_last(c) for c in order]).limit(n).withColumn("more_rows", more)
