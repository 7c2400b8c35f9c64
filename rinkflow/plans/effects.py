"""Goalie, team-season and season effects by weighted shrinkage.

The model is ``y = a + b1 * traffic + b2 * speed + goalie + team_season + season + noise / sqrt(shots)``. All sums it
needs are taken once per (goalie, team, season) cell; the sweeps read only cells, whose number does not grow with the
shots. Deviations of effects are marginal: they include that the other effects and the coefficients are not known, given
the variances. ``sd_alone`` is the deviation as if all others were known.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkflow.functions.numeric import Z_95, interval
from rinkflow.operators.sizing import Settled, join_dim, null_safe_join, one_row, settle
from rinkflow.plans.metrics import goalie_game_obs, semi_min_rows, zscore
from rinkflow.session import cut_lineage, drop_version, fresh_path, scratch

# Team-seasons and seasons beyond which a caller wants no marginal deviations. None, which every query has: there is no such number.
MOST_LEVELS: int | None = None
# Team-seasons and seasons up to which their system is one matrix; a larger one lies in blocks of so many rows and columns.
BLOCK = 1000
# Goalies eliminated at a time: a matrix of so many rows and a column for every level.
GOALIES = 500
# Keys of the three effects.
FACTORS = {"g": ("goalie_id",), "t": ("team_id", "season"), "s": ("season",)}
# Sums of a cell that the precision of the effects needs.
SUMS = ("w", "wt", "ws", "wtt", "wts", "wss")


def shrinkage_one_way(df: DataFrame, key: Sequence[str], value: Column, weight: Column, ridge: float) -> DataFrame:
    """Effect per key: weighted sum of values over (sum of weights + ridge)."""
    sums = df.groupBy(*key).agg(F.sum(weight * value).alias("wy"), F.sum(weight).alias("w"))
    return sums.select(*key, "w", (F.col("wy") / (F.col("w") + ridge)).alias("effect"))


def shrinkage_sweep2(
    cells: DataFrame, first: Sequence[str], second: Sequence[str], y: str, w: str, ridge: tuple[float, float]
) -> tuple[DataFrame, DataFrame]:
    """Effects of the first factor, then of the second one on what the first leaves."""
    a = settle(shrinkage_one_way(cells, first, F.col(y), F.col(w), ridge[0]).select(*first, F.col("effect").alias("a")))
    left = join_dim(cells, a, first)
    b = shrinkage_one_way(left, second, F.col(y) - F.col("a"), F.col(w), ridge[1])
    return a.df, b.select(*second, F.col("effect").alias("b"))


def observations(scored: DataFrame, min_shots: int = 5, min_games: int = 20) -> DataFrame:
    """Goalie-game rows of goalies with enough games, with standardised covariates."""
    games = settle(goalie_game_obs(scored, min_shots)).df
    obs = semi_min_rows(games, "goalie_id", min_games)
    return zscore(obs, {"traffic_std": "avg_traffic", "speed_std": "avg_speed"})


def cell_table(obs: DataFrame) -> DataFrame:
    """Weighted sums per goalie, team and season; a missing covariate (no spread) counts as 0."""
    w, y = F.col("shots_faced").cast("double"), F.col("gsax_per_shot")
    t, s = F.coalesce("traffic_std", F.lit(0.0)), F.coalesce("speed_std", F.lit(0.0))
    products = {"w": w, "wt": w * t, "ws": w * s, "wy": w * y, "wtt": w * t * t, "wss": w * s * s}
    products |= {"wts": w * t * s, "wty": w * t * y, "wsy": w * s * y, "wyy": w * y * y}
    return obs.groupBy("goalie_id", "team_id", "season").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in products.items()]
    )


@dataclass(frozen=True)
class Effects:
    """One table per factor (keys, effect, deviation), the global parameters, and whether the sweeps settled."""

    tables: dict[str, DataFrame]
    parameters: dict[str, float]
    converged: bool = True
    sweeps: int = 0

    def goalies(self) -> DataFrame:
        """Talent per goalie with its 95 % interval, best first."""
        low, high = interval(F.col("effect"), F.col("sd"), Z_95)
        return (
            self.tables["g"]
            .select(
                "goalie_id",
                F.col("effect").alias("dsis_true_talent_gsax_per_shot"),
                F.col("sd").alias("dsis_std_dev"),
                low.alias("dsis_hdi_lower"),
                high.alias("dsis_hdi_upper"),
            )
            .orderBy(F.desc_nulls_last("dsis_true_talent_gsax_per_shot"))
        )

    def teams(self) -> DataFrame:
        """Effect per team and season. It is the number subtracted from a goalie's talent."""
        return self.tables["t"].select(
            "team_id", "season", F.col("effect").alias("dsis_team_defense_impact_per_shot"), F.col("sd").alias("dsis_team_std")
        )


def _with_effects(cells: DataFrame, tables: dict[str, Settled], factors: Sequence[str]) -> DataFrame:
    """Cells with the effects of some factors as columns, 0 where not fitted yet."""
    x = cells
    for f in factors:
        if f in tables:
            side = Settled(tables[f].df.select(*FACTORS[f], F.col("effect").alias(f), F.col("sd").alias(f"{f}_sd")), tables[f].small)
            x = join_dim(x, side, FACTORS[f])
        else:
            x = x.withColumns({f: F.lit(0.0), f"{f}_sd": F.lit(0.0)})
    return x


def _leap(history: list[dict[str, float]], names: Sequence[str], most: float = 6.0) -> dict[str, float]:
    """Variances where their last three values lead: sweeps shrink the error of their logarithms by a steady factor.

    The step ahead is bounded, since the factor is only roughly known while other parameters still move.
    """
    a, b, c = history[-3:]
    out = dict(c)
    for k in names:
        first, second = math.log(b[k] / a[k]), math.log(c[k] / b[k])
        if first and 0.05 < (rate := second / first) < 1:
            out[k] = max(c[k] * math.exp(max(-most, min(most, second * min(rate / (1 - rate), 50.0)))), 1e-12)
    return out


def fit_effects(cells: DataFrame, sweeps: int = 200, tolerance: float = 1e-4) -> Effects:
    """Alternate between the effects, the three fixed coefficients and the variances until nothing moves.

    The cells are computed once. Every step sums what the other effects leave and computes one effect table (checked
    small result or checkpoint), so plans do not grow. The coefficients come from a 3 by 3 system, the variances from
    expected squares. Every third sweep the variances leap ahead to where they tend. The fit has converged when a plain
    sweep moves no parameter by more than ``tolerance`` of its size or of the noise of a mean cell; ``converged``
    says whether it did within ``sweeps``.
    """
    kept = settle(cells).df
    first = kept.agg(*[F.sum(c).alias(c) for c in ("n", "w", "wy", "wyy")]).first()
    p = {"alpha": 0.0, "beta_traffic": 0.0, "beta_speed": 0.0}
    if not first["n"]:
        empty = {f: kept.select(*k, F.lit(0.0).alias("effect"), F.lit(0.0).alias("sd"), F.lit(0.0).alias("sd_alone")) for f, k in FACTORS.items()}
        return Effects(empty, p)
    p["sigma2"] = max((first["wyy"] - first["wy"] ** 2 / first["w"]) / first["n"], 1e-12)
    for f in FACTORS:
        p[f] = max(p["sigma2"] * first["n"] / first["w"], 1e-12)
    tables: dict[str, Settled] = {}
    floor = p["sigma2"] * first["n"] / first["w"]
    history: list[dict[str, float]] = []
    for sweep in range(sweeps):
        fixed = p["alpha"] * F.col("w") + p["beta_traffic"] * F.col("wt") + p["beta_speed"] * F.col("ws")
        for f, keys in FACTORS.items():
            others = [o for o in FACTORS if o != f]
            left = F.col("wy") - fixed - F.col("w") * (F.col(others[0]) + F.col(others[1]))
            ridge = F.col("__w") + p["sigma2"] / p[f]
            sums = _with_effects(kept, tables, others).groupBy(*keys).agg(F.sum(left).alias("__r"), F.sum("w").alias("__w"))
            tables[f] = settle(
                sums.select(*keys, "__w", (F.col("__r") / ridge).alias("effect"), F.sqrt(p["sigma2"] / ridge).alias("sd"))
            )
        old, p = p, _parameters(kept, tables, p)
        # Variances count against the noise of a mean cell, coefficients against its deviation.
        scale = {k: math.sqrt(floor) if k in ("alpha", "beta_traffic", "beta_speed") else floor for k in p}
        if sweep > 2 and max(abs(p[k] - old[k]) / (abs(old[k]) + scale[k]) for k in p) < tolerance:
            return Effects(marginal_deviations(kept, tables, p), p, True, sweep + 1)
        history.append(p)
        if len(history) == 3:
            p, history = _leap(history, list(FACTORS)), []
    return Effects(marginal_deviations(kept, tables, p), p, False, sweeps)


def marginal_deviations(cells: DataFrame, tables: dict[str, Settled], p: dict[str, float]) -> dict[str, DataFrame]:
    """The effect tables with ``sd`` from the inverse of the precision of all effects and coefficients together.

    Goalies meet each other only through team-seasons, seasons and the three coefficients. So their rows of the system are
    eliminated where they lie, some goalies at a time, and what is left has one row and column for each level of the other two
    factors. With the inverse of that, a goalie's variance follows from its own cells. Up to ``BLOCK`` levels, which a league has,
    it is one matrix; more lie in blocks that are multiplied and inverted by tasks (the work grows with the cube of the levels).
    The driver holds the keys of the levels, never their matrix beyond one block.
    """
    alone = {f: t.df.drop("__w").withColumn("sd_alone", F.col("sd")) for f, t in tables.items()}
    places: dict[tuple, int] = {}
    for f in ("t", "s"):
        keys = tables[f].df.select(*FACTORS[f]).collect()
        places |= {(f, *r): len(places) + i for i, r in enumerate(keys)}
    if MOST_LEVELS is not None and len(places) > MOST_LEVELS:
        return alone
    own = cells.select("goalie_id", "team_id", "season", *SUMS)
    goalies, variances = (_deviations_of_few if len(places) <= BLOCK else _deviations_of_many)(own, places, p)
    out = {"g": join_dim(alone["g"], settle(goalies), ["goalie_id"])}
    for f in ("t", "s"):
        rows = [(*key, float(math.sqrt(variances[i]))) for (g, *key), i in places.items() if g == f]
        kinds = ", ".join(f"{k} {dict(cells.dtypes)[k]}" for k in FACTORS[f])
        out[f] = join_dim(alone[f], settle(cells.sparkSession.createDataFrame(rows, f"{kinds}, __sd double")), FACTORS[f])
    return {f: t.withColumn("sd", F.col("__sd")).drop("__sd") for f, t in out.items()}


def _deviations_of_few(cells: DataFrame, places: dict[tuple, int], p: dict[str, float]) -> tuple[DataFrame, np.ndarray]:
    """``goalie_id, __sd``, and the variances of the levels, by one matrix."""
    size, noise, prior = len(places) + 3, p["sigma2"], 1 / p["g"]
    # Rows of cells, a goalie's together: a task holds one Arrow batch and the cells of its last goalie, no more than team-seasons.
    own = cells.repartition("goalie_id").sortWithinPartitions("goalie_id")

    def systems(batches):
        """For some goalies at a time: their keys, the places and sums of their cells, what ties them to every other row of the system
        (a matrix), and their own precisions."""
        for table, goalie in _by_goalie(batches):
            x = {c: table[c].to_numpy() for c in SUMS}
            teams, seasons = table["team_id"].to_pylist(), table["season"].to_pylist()
            t = np.array([places["t", k, s] for k, s in zip(teams, seasons, strict=True)])
            u = np.array([places["s", s] for s in seasons])
            tie, precision = np.zeros((goalie[-1] + 1, size)), np.bincount(goalie, x["w"]) / noise + prior
            for at, c in ((t, "w"), (u, "w"), (size - 3, "w"), (size - 2, "wt"), (size - 1, "ws")):
                np.add.at(tie, (goalie, at), x[c] / noise)
            first = np.flatnonzero(np.diff(goalie, prepend=-1))
            yield table["goalie_id"].combine_chunks().take(pa.array(first)), t, u, x, tie, precision

    def eliminate(batches):
        total = np.zeros((size, size))
        for _, t, u, x, tie, precision in systems(batches):
            at = [t, u, *(np.full(len(t), size - 3 + k) for k in range(3))]
            for i, j in ((i, j) for i in range(5) for j in range(5)):
                low, high = min(i, j), max(i, j)
                # The first three rows are indicators, the last two the covariates.
                c = "w" if high < 3 else ("wt", "ws")[high - 3] if low < 3 else {(3, 3): "wtt", (3, 4): "wts", (4, 4): "wss"}[low, high]
                np.add.at(total, (at[i], at[j]), x[c] / noise)
            total -= (tie / precision[:, None]).T @ tie
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "v"])

    sums = own.mapInArrow(eliminate, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    system = np.zeros((size, size))
    system[sums["i"].to_numpy(), sums["j"].to_numpy()] = sums["v"].to_numpy()
    system[np.diag_indices(size)] += [1 / p[f] for f, *_ in places] + [1.0] * 3
    inverse = np.linalg.inv(system)

    def spread(batches):
        for keys, _, _, _, tie, precision in systems(batches):
            found = np.sqrt(1 / precision + ((tie @ inverse) * tie).sum(axis=1) / precision**2)
            yield pa.RecordBatch.from_arrays([keys, pa.array(found)], ["goalie_id", "__sd"])

    return own.mapInArrow(spread, f"goalie_id {dict(cells.dtypes)['goalie_id']}, __sd double"), np.diag(inverse)


def _deviations_of_many(cells: DataFrame, places: dict[tuple, int], p: dict[str, float]) -> tuple[DataFrame, np.ndarray]:
    """``goalie_id, __sd``, and the variances of the levels, by blocks of ``BLOCK`` rows and columns.

    A goalie's row ties it to the levels it met; divided by the root of its precision it is z, and goalies take the sum of their
    outer products z z' from the system. The tasks of two blocks of levels hold ``GOALIES`` rows and one block.
    """
    spark, noise, width = cells.sparkSession, p["sigma2"], BLOCK
    size = len(places) + 3
    count = math.ceil(size / width)
    numbered = cells
    for f in ("t", "s"):
        kinds = ", ".join(f"{k} {dict(cells.dtypes)[k]}" for k in FACTORS[f])
        side = spark.createDataFrame([(*key, i) for (g, *key), i in places.items() if g == f], f"{kinds}, __{f} long")
        numbered = join_dim(numbered, side, FACTORS[f], nulls=True)
    at = [F.col("__t"), F.col("__s"), *(F.lit(size - 3 + k).cast("long") for k in range(3))]

    # The system of the levels alone: what every cell adds to two of its five places, and the priors.
    pairs = []
    for i, j in ((i, j) for i in range(5) for j in range(5)):
        low, high = min(i, j), max(i, j)
        c = "w" if high < 3 else ("wt", "ws")[high - 3] if low < 3 else {(3, 3): "wtt", (3, 4): "wts", (4, 4): "wss"}[low, high]
        pairs.append(F.struct(at[i].alias("i"), at[j].alias("j"), (F.col(c) / noise).alias("v")))
    summed = numbered.select(F.explode(F.array(*pairs)).alias("e")).groupBy("e.i", "e.j").agg(F.sum("e.v").alias("v")).where("i <= j")
    priors = spark.createDataFrame([(i, i, 1 / p[f]) for (f, *_), i in places.items()] + [(i, i, 1.0) for i in range(size - 3, size)], "i long, j long, v double")

    ties = F.explode(F.array(*[F.struct(a.alias("at"), F.col(c).alias("v")) for a, c in zip(at, ("w", "w", "w", "wt", "ws"), strict=True)]))
    precision = numbered.groupBy("goalie_id").agg((F.sum("w") / noise + 1 / p["g"]).alias("precision"))
    # A goalie's number, and its z by block of levels: no more than ``BLOCK`` values in a row.
    goalies = cut_lineage(precision.withColumn("n", F.monotonically_increasing_id()))
    z = numbered.select("goalie_id", ties.alias("e")).groupBy("goalie_id", F.col("e.at").alias("at")).agg(F.sum("e.v").alias("v"))
    z = null_safe_join(z, goalies, ["goalie_id"], "inner").select("n", "at", (F.col("v") / noise / F.sqrt("precision")).alias("v"))
    z = z.groupBy("n", F.floor(F.col("at") / width).cast("int").alias("block")).agg(F.collect_list(F.struct("at", "v")).alias("ties"))
    z = cut_lineage(z.select("n", "block", F.col("ties.at").alias("at"), F.col("ties.v").alias("v")))

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salts = max(1, math.ceil(2 * tasks / (count * (count + 1))))
    tasks = max(tasks, count)

    def dealt(row):
        """A goalie's part of one block goes to every two blocks with that one."""
        x = (row["n"], row["block"], np.array(row["at"]) % width, np.array(row["v"]))
        for other in range(count):
            yield (min(x[1], other), max(x[1], other), x[0] % salts, 1, x[0]), x

    def sorted_groups(records):
        return records.repartitionAndSortWithinPartitions(tasks, lambda key: (key[0] * count + key[1]) * salts + key[2])

    def shape(i, j):
        return min(width, size - i * width), min(width, size - j * width)

    def products(records):
        for (i, j, _), heads, pieces in _groups(records, shape):
            total = np.zeros(shape(i, j))
            for row, column, v in heads:
                total[row % width, column % width] += v
            for _, x, y in pieces:
                total -= x.T @ y
            yield (i, j), total

    entries = summed.unionByName(priors).rdd.map(lambda r: ((r["i"] // width, r["j"] // width, 0, 0, 0), (r["i"], r["j"], r["v"])))
    # The block of two equal numbers is whole; of the entries only the upper half came.
    entries = entries.flatMap(lambda e: [e, (e[0], (e[1][1], e[1][0], e[1][2]))] if e[0][0] == e[0][1] and e[1][0] != e[1][1] else [e])
    blocks = sorted_groups(entries.union(z.rdd.flatMap(dealt))).mapPartitions(products).reduceByKey(np.add, tasks)
    with scratch(spark):
        inverse = _inverted(spark, blocks, count, tasks)

        def spread(records):
            for (i, j, _), heads, pieces in _groups(records, shape):
                (block,) = heads
                for numbers, x, y in pieces:
                    # Both triangles of the inverse count.
                    found = ((x @ block) * y).sum(axis=1) * (1 if i == j else 2)
                    yield from zip(numbers, map(float, found), strict=True)

        copies = inverse.flatMap(lambda b: [((*b[0], salt, 0, 0), b[1]) for salt in range(salts)])
        shares = sorted_groups(copies.union(z.rdd.flatMap(dealt))).mapPartitions(spread)
        shares = spark.createDataFrame(shares, "n long, share double").groupBy("n").agg(F.sum("share").alias("share"))
        found = cut_lineage(goalies.join(shares, "n").select("goalie_id", F.sqrt((1 + F.col("share")) / F.col("precision")).alias("__sd")))
        diagonal = dict(inverse.filter(lambda b: b[0][0] == b[0][1]).map(lambda b: (b[0][0], np.diag(b[1]).copy())).collect())
    return found, np.concatenate([diagonal[i] for i in range(count)])


def _groups(records: Iterator, shape: Callable[[int, int], tuple[int, int]]) -> Iterator[tuple[tuple, list, Iterator]]:
    """Sorted records by two blocks and share of the goalies: what comes first (entries, or a block), then dense rows of at most
    ``GOALIES`` goalies at a time, in the first and in the second block. The rows must be read before the next group."""
    for key, group in groupby(records, lambda r: r[0][:3]):
        parts = groupby(group, lambda r: r[0][3])
        first = next(parts)
        heads = [value for _, value in first[1]] if first[0] == 0 else []
        rest = (value for _, value in (chain.from_iterable(g for _, g in parts) if first[0] == 0 else first[1]))
        yield key, heads, _dense_rows(rest, key[0], key[1], shape(key[0], key[1]))


def _dense_rows(ties: Iterator, i: int, j: int, sizes: tuple[int, int]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    numbers: list = []
    x, y = np.zeros((GOALIES, sizes[0])), np.zeros((GOALIES, sizes[1]))
    for number, parts in groupby(ties, lambda t: t[0]):
        if len(numbers) == GOALIES:
            yield numbers, x, y
            numbers = []
            x[:], y[:] = 0, 0
        for _, block, at, v in parts:
            if block == i:
                x[len(numbers), at] = v
            if block == j:
                y[len(numbers), at] = v
        numbers.append(number)
    if numbers:
        yield numbers, x[: len(numbers)], y[: len(numbers)]


def _inverted(spark: SparkSession, blocks: RDD, count: int, tasks: int) -> RDD:
    """The inverse of a positive definite matrix from blocks ((i, j), values), i <= j, by sweeping one block of the diagonal after the
    other. A task holds three blocks, the driver one; a sweep is written, and the one before it deleted."""

    def kept(blocks, before):
        path = fresh_path(spark, "blocks")
        blocks.saveAsPickleFile(path, 1)
        if before:
            drop_version(spark, before)
        return spark.sparkContext.pickleFile(path, tasks), path

    def sent(k):
        def run(item):
            """A block of the pivot's row, as it lies there, for all blocks that need it."""
            (i, j), v = item
            yield (i, j), (-1, v)
            if k in (i, j):
                m, panel = (j, v) if i == k else (i, v.T)
                for other in range(count):
                    yield (min(m, other), max(m, other)), (m, panel)

        return run

    def swept(k, pivot):
        def run(item):
            (i, j), values = item
            of = dict(values)
            if i == j == k:
                new = -pivot
            elif i == k:
                new = pivot @ of[j]
            elif j == k:
                new = (pivot @ of[i]).T
            else:
                new = of[-1] - of[i].T @ pivot @ of[j]
            return (i, j), new

        return run

    blocks, path = kept(blocks, None)
    for k in range(count):
        pivot = np.linalg.inv(blocks.filter(lambda b, k=k: b[0] == (k, k)).first()[1])
        blocks, path = kept(blocks.flatMap(sent(k)).groupByKey(tasks).map(swept(k, pivot)), path)
    return blocks.mapValues(np.negative)


def _by_goalie(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole goalies of sorted cells, at most ``GOALIES`` and about a batch at a time, with the number of each cell's goalie from 0 on."""
    kept: pa.Table | None = None
    for batch in chain(batches, [None]):
        rows = [t for t in (kept, None if batch is None else pa.Table.from_batches([batch])) if t is not None]
        if not rows:
            return
        table = pa.concat_tables(rows).combine_chunks()
        if not table.num_rows:
            kept = table
            continue
        code = table["goalie_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        number = np.cumsum(np.diff(code, prepend=code[0]) != 0)
        # The last goalie may go on in the next batch.
        end = len(number) if batch is None else int(np.searchsorted(number, number[-1]))
        for lowest in range(0, int(number[end - 1]) + 1 if end else 0, GOALIES):
            at, to = np.searchsorted(number[:end], [lowest, lowest + GOALIES])
            yield table.slice(at, to - at).combine_chunks(), number[at:to] - lowest
        kept = table.slice(end)


def _parameters(cells: DataFrame, tables: dict[str, Settled], p: dict[str, float]) -> dict[str, float]:
    """Coefficients and variances from sums over the cells and over each effect table."""
    e = F.col("g") + F.col("t") + F.col("s")
    aggs = {c: F.sum(c) for c in ("n", "w", "wt", "ws", "wtt", "wss", "wts")}
    aggs |= {
        "y0": F.sum(F.col("wy") - F.col("w") * e),
        "y1": F.sum(F.col("wty") - F.col("wt") * e),
        "y2": F.sum(F.col("wsy") - F.col("ws") * e),
        "yy": F.sum(F.col("wyy") - 2 * e * F.col("wy") + e * e * F.col("w")),
    }
    sums = _with_effects(cells, tables, list(FACTORS)).agg(F.struct(*[c.alias(k) for k, c in aggs.items()]).alias("cells"))
    for f in FACTORS:
        variance = F.col("sd") * F.col("sd")
        spread = one_row(tables[f].df, spread=F.sum(F.col("__w") * variance), square=F.avg(F.col("effect") * F.col("effect") + variance))
        sums = sums.withColumn(f, spread)
    row = sums.first()
    c = row["cells"]
    system = np.array([[c["w"], c["wt"], c["ws"]], [c["wt"], c["wtt"], c["wts"]], [c["ws"], c["wts"], c["wss"]]])
    right = np.array([c["y0"], c["y1"], c["y2"]])
    beta = np.linalg.solve(system + p["sigma2"] * np.eye(3), right)
    rss = c["yy"] - 2 * beta @ right + beta @ system @ beta
    new = dict(zip(("alpha", "beta_traffic", "beta_speed"), map(float, beta), strict=True))
    new["sigma2"] = max(float(rss + sum(row[f]["spread"] for f in FACTORS)) / c["n"], 1e-12)
    new |= {f: max(row[f]["square"], 1e-12) for f in FACTORS}
    return new
