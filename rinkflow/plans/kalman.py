"""Random-walk filter per series and its projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rinkflow.functions.numeric import Z_80, interval, obs_noise
from rinkflow.operators.interpolation import interpolate_linear
from rinkflow.operators.sequences import neighbours, row_hash
from rinkflow.operators.sizing import Settled, join_dim, settle
from rinkflow.operators.skew import HOT, SEGMENT, measure_groups
from rinkflow.session import max_group_rows

# Yearly process noise, noise of a full season, first mean and variance.
PROCESS_NOISE = 0.00001
BASE_NOISE = 0.00004
FIRST_MEAN = 0.0
FIRST_VARIANCE = 0.001
# Longest array folded in one row; longer series are cut.
MAX_STEPS = 500

_OUT = "array<struct<step:bigint,at:bigint,mean:double,var:double>>"


def number_steps(series: DataFrame, key: str = "goalie_id", order: str = "season", tie: str | None = None) -> DataFrame:
    """Number the rows of each series: by ``order``, then by ``tie`` (the team where the rows have one, else a hash of the row).

    A series may hold several rows of one season, one for each team, so steps are told apart by this number.
    """
    if "step" in series.columns:
        return series
    tie = tie or ("team_id" if "team_id" in series.columns else None)
    last = F.asc_nulls_last(tie) if tie else row_hash(series).asc()
    w = W.partitionBy(key).orderBy(F.asc_nulls_last(order), last)
    return series.withColumn("step", F.row_number().over(w).cast("bigint"))


def steps(
    series: DataFrame,
    drift: DataFrame | Settled,
    key: str = "goalie_id",
    order: str = "season",
    z: str = "talent",
    age: str = "age",
    shots: str = "shots_faced",
    compat: str = "fixed",
    drift_x: str = "age",
    drift_y: str = "yearly_drift",
) -> DataFrame:
    """Measurement, noise and age drift of every step.

    The drift of a step is the rate at the previous age times the years since. ``compat="reference"`` applies it one
    step late.
    """
    x = neighbours(number_steps(series, key, order), [key], "step", {"prev_age": (age, 1)})
    x = x.withColumn("age_step", F.col(age) - F.col("prev_age"))
    x = interpolate_linear(x, F.col("prev_age"), drift, drift_x, drift_y, "__rate")
    x = x.withColumn("offset", F.coalesce(F.col("__rate") * F.col("age_step"), F.lit(0.0))).drop("__rate")
    if compat == "reference":
        x = neighbours(x, [key], "step", {"__late": ("offset", 1)})
        x = x.withColumn("offset", F.coalesce("__late", F.lit(0.0))).drop("__late")
    return x.withColumn("noise", obs_noise(BASE_NOISE, F.col(shots)))


def _pack(order: str, z: str) -> Column:
    return F.array_sort(
        F.collect_list(
            F.struct(
                F.col("step"),
                F.col(order).cast("bigint").alias("at"),
                F.col(z).alias("z"),
                F.col("noise").alias("r"),
                F.col("offset").alias("b"),
                F.col("__first").alias("first"),
            )
        )
    )


def _fold(arr: Column, mean: Column, var: Column, q: float) -> Column:
    """Filtered mean and variance after every step of an ordered array."""

    def step(state, s):
        m = F.when(s["first"], state["mean"]).otherwise(state["mean"] + s["b"])
        p = F.when(s["first"], state["var"]).otherwise(state["var"] + q)
        gain = p / (p + s["r"])
        new_m, new_p = m + gain * (s["z"] - m), (1 - gain) * p
        row = F.struct(s["step"].alias("step"), s["at"].alias("at"), new_m.alias("mean"), new_p.alias("var"))
        return F.struct(new_m.alias("mean"), new_p.alias("var"), F.concat(state["out"], F.array(row)).alias("out"))

    start = F.struct(mean.cast("double").alias("mean"), var.cast("double").alias("var"), F.array().cast(_OUT).alias("out"))
    return F.aggregate(arr, start, step, lambda s: s["out"])


def _variance_map(arr: Column, q: float) -> Column:
    """What a stretch of steps does to the variance, as a ratio (a p + b) / (c p + d) of the variance before it."""

    def step(s, e):
        # One step is r (p + q) / (p + q + r); the first one has no q.
        add = F.when(e["first"], F.lit(0.0)).otherwise(F.lit(q))
        up_a, up_b = e["r"] * (s["a"] + add * s["c"]), e["r"] * (s["b"] + add * s["d"])
        dn_c, dn_d = s["a"] + (add + e["r"]) * s["c"], s["b"] + (add + e["r"]) * s["d"]
        size = F.abs(dn_c) + F.abs(dn_d)
        return F.struct((up_a / size).alias("a"), (up_b / size).alias("b"), (dn_c / size).alias("c"), (dn_d / size).alias("d"))

    one, zero = F.lit(1.0), F.lit(0.0)
    return F.aggregate(arr, F.struct(one.alias("a"), zero.alias("b"), zero.alias("c"), one.alias("d")), step)


def _mean_map(arr: Column, var: Column, q: float) -> Column:
    """What a stretch does to the mean, as a mean + b, once the variance before it is known."""

    def step(s, e):
        p = F.when(e["first"], s["p"]).otherwise(s["p"] + q)
        gain = p / (p + e["r"])
        b = F.when(e["first"], s["b"]).otherwise(s["b"] + e["b"])
        return F.struct(
            ((1 - gain) * s["a"]).alias("a"), ((1 - gain) * b + gain * e["z"]).alias("b"), ((1 - gain) * p).alias("p")
        )

    return F.aggregate(arr, F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), var.alias("p")), step)


def _before(parts: DataFrame, key: str, value: str, start: float, apply, new: str) -> DataFrame:
    """Value at the start of every segment, applying the maps of the segments before it in order."""
    ordered = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(SEGMENT, value))).alias("__maps"))

    def step(state, s):
        row = F.struct(s[SEGMENT].alias(SEGMENT), state["v"].alias(new))
        return F.struct(apply(s[value], state["v"]).alias("v"), F.concat(state["out"], F.array(row)).alias("out"))

    kind = f"array<struct<{SEGMENT}:int,{new}:double>>"
    start_state = F.struct(F.lit(float(start)).alias("v"), F.array().cast(kind).alias("out"))
    found = F.aggregate("__maps", start_state, step, lambda s: s["out"])
    return ordered.select(key, F.inline(found))


def kalman_filter(
    step_rows: DataFrame,
    key: str = "goalie_id",
    order: str = "season",
    z: str = "talent",
    q: float = PROCESS_NOISE,
    min_steps: int = 2,
) -> DataFrame:
    """Filtered mean and variance of every step: ``key, order, step, kalman_talent, variance``, one row per input row.

    A series is folded as one ordered array. Series of more than ``MAX_STEPS`` steps are cut into segments: each segment's
    effect on variance and mean is composed, which gives the state at its start, and the segments are folded apart.
    """
    numbered = number_steps(step_rows, key, order)
    heads = numbered.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    rows = numbered.join(heads.filter(F.col("__n") >= min_steps), key)
    rows = rows.withColumn("__first", F.col("step") == 1).drop("__n")
    limit = min(MAX_STEPS, max_group_rows(rows.sparkSession))
    groups = measure_groups(rows.select(key, "step"), [key], "step", limit)
    if not groups.hot:
        packed = rows.groupBy(key).agg(_pack(order, z).alias("__s"))
        out = packed.select(key, F.inline(_fold(F.col("__s"), F.lit(FIRST_MEAN), F.lit(FIRST_VARIANCE), q)))
    else:
        packed = settle(groups.segmented(rows).drop(HOT).groupBy(key, SEGMENT).agg(_pack(order, z).alias("__s"))).df
        ratio = lambda m, p: (m["a"] * p + m["b"]) / (m["c"] * p + m["d"])
        line = lambda m, v: m["a"] * v + m["b"]
        maps = packed.select(key, SEGMENT, _variance_map(F.col("__s"), q).alias("__m"))
        x = packed.join(_before(maps, key, "__m", FIRST_VARIANCE, ratio, "__p"), [key, SEGMENT])
        lines = x.select(key, SEGMENT, _mean_map(F.col("__s"), F.col("__p"), q).alias("__m"))
        x = x.join(_before(lines, key, "__m", FIRST_MEAN, line, "__v"), [key, SEGMENT])
        out = x.select(key, F.inline(_fold(F.col("__s"), F.col("__v"), F.col("__p"), q)))
    return out.select(
        key, F.col("at").alias(order), "step", F.col("mean").alias("kalman_talent"), F.col("var").alias("variance")
    )


def trajectory(
    series: DataFrame, filtered: DataFrame, key: str = "goalie_id", order: str = "season", z: str = "talent", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Observed and filtered talent of every step, one row for each row of a filtered series."""
    return number_steps(series, key, order).join(filtered.drop(order), [key, "step"]).select(
        key,
        order,
        *keep,
        "age",
        "shots_faced",
        F.col(z).alias("observed_talent"),
        "kalman_talent",
        F.sqrt("variance").alias("kalman_uncertainty"),
    )


def projections(
    series: DataFrame,
    filtered: DataFrame,
    drift: DataFrame | Settled,
    names: DataFrame | None = None,
    key: str = "goalie_id",
    order: str = "season",
    q: float = PROCESS_NOISE,
    drift_x: str = "age",
    drift_y: str = "yearly_drift",
) -> DataFrame:
    """One row per series: state after the last step, next year with its 80 % interval, and three years ahead."""
    last = (
        number_steps(series, key, order)
        .join(filtered.drop(order), [key, "step"])
        .groupBy(key)
        .agg(F.max_by(F.struct(order, "age", "shots_faced", "kalman_talent", "variance"), "step").alias("l"))
        .select(key, "l.*")
    )
    lookup = drift if isinstance(drift, Settled) else settle(drift)
    x = last
    for year in range(3):
        x = interpolate_linear(x, F.col("age") + year, lookup, drift_x, drift_y, f"__d{year}")
    one = F.col("kalman_talent") + F.col("__d0")
    low, high = interval(one, F.sqrt(F.col("variance") + q), Z_80)
    out = x.select(
        key,
        F.col(order).alias("latest_season"),
        F.round("age", 1).alias("current_age"),
        F.col("shots_faced").cast("bigint").alias("latest_shots_faced"),
        F.bround("kalman_talent", 6).alias("current_filtered_talent_per_shot"),
        F.bround(F.sqrt("variance"), 6).alias("current_uncertainty"),
        F.bround(one, 6).alias("proj_1yr_talent_per_shot"),
        F.bround(low, 6).alias("proj_1yr_ci_lower"),
        F.bround(high, 6).alias("proj_1yr_ci_upper"),
        F.bround(F.col("kalman_talent") + F.col("__d0") + F.col("__d1") + F.col("__d2"), 6).alias("proj_3yr_talent_per_shot"),
    )
    text = F.col(key).cast("string")
    if names is None:
        return out.withColumn("Goalie", text)
    named = join_dim(out, names.select(F.col("goalie_id").alias(key), "goalie_name"), [key])
    return named.withColumn("Goalie", F.coalesce("goalie_name", text)).drop("goalie_name")


def projection_ranking(proj: DataFrame, season: int, n: int = 15, shots: int = 30) -> DataFrame:
    """Best projections of goalies whose latest season is ``season``, per game of ``shots`` shots."""
    from rinkflow.operators.topk import top_n

    active = proj.filter(F.col("latest_season") == season)
    top = top_n(active, "proj_1yr_talent_per_shot", "goalie_id", n)
    scaled = {
        "current_per_game": "current_filtered_talent_per_shot",
        "proj_per_game": "proj_1yr_talent_per_shot",
        "ci_lower_per_game": "proj_1yr_ci_lower",
        "ci_upper_per_game": "proj_1yr_ci_upper",
    }
    return top.select(
        "rank", "goalie_id", "Goalie", "current_age", "latest_shots_faced", *[(F.col(c) * shots).alias(n2) for n2, c in scaled.items()]
    )


def projection_backtest(step_rows: DataFrame, key: str = "goalie_id", order: str = "season", z: str = "talent") -> DataFrame:
    """Error of the filter, the last value and a 3-year weighted mean as forecasts of the next step.

    The filter's mean after a step uses no later step, so one pass gives the forecasts of every cut-off. The weighted
    mean weighs the last three values by shots.
    """
    numbered = number_steps(step_rows, key, order)
    rows = numbered.join(kalman_filter(numbered, key, order, z).drop(order), [key, "step"])
    around = {
        "actual": (z, -1),
        "next_offset": ("offset", -1),
        "z1": (z, 1),
        "z2": (z, 2),
        "w1": ("shots_faced", 1),
        "w2": ("shots_faced", 2),
    }
    x = neighbours(rows, [key], "step", around).filter(F.col("actual").isNotNull())
    zero = F.lit(0)
    sums = F.col(z) * F.col("shots_faced")
    weights = F.col("shots_faced")
    for i in (1, 2):
        w = F.coalesce(F.col(f"w{i}"), zero)
        sums = sums + F.coalesce(F.col(f"z{i}"), zero) * w
        weights = weights + w
    forecasts = {
        "kalman": F.col("kalman_talent") + F.col("next_offset"),
        "last_season": F.col(z),
        "weighted_3yr": sums / weights,
    }
    return x.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(n).alias("method"), (F.col("actual") - f).alias("error")) for n, f in forecasts.items()]
            )
        )
    ).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"))
