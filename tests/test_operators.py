import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rinkflow.operators import interpolation as I
from rinkflow.operators import ranks, topk
from rinkflow.operators.interpolation import interpolate_linear
from rinkflow.operators.intervals import _nodes, cover_counts, interval_join
from rinkflow.operators.sequences import group_values, neighbours, range_counts, running
from rinkflow.operators.sizing import join_dim, settle
from rinkflow.operators.skew import measure_groups


@pytest.fixture(scope="module")
def events(spark):
    """One group holds most rows."""
    rng = np.random.default_rng(1)
    rows = [(int(g), i, int(rng.integers(0, 400)), float(rng.normal()), bool(rng.random() < 0.4))
            for i, g in enumerate(rng.choice([1, 1, 1, 1, 2, 3], size=300))]
    return spark.createDataFrame(rows, "g bigint, id bigint, t bigint, v double, f boolean").repartition(5, "v").persist()


def frame(df, *order):
    return df.orderBy(*order).toPandas()


SHIFTS = {"p1": ("v", 1), "p2": ("v", 2), "n1": ("t", -1)}


def test_neighbours_split_hot_groups(events, hot_only):
    groups = measure_groups(events, ["g"], "id")
    assert groups.hot
    got = frame(neighbours(events, ["g"], "id", SHIFTS, groups), "id")
    want = frame(events, "id")
    by = want.groupby("g")
    want["p1"], want["p2"], want["n1"] = by["v"].shift(1), by["v"].shift(2), by["t"].shift(-1)
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)


def test_neighbours_without_small_sides(events, tight):
    got = frame(neighbours(events, ["g"], "id", SHIFTS), "id")
    assert got["p2"].isna().sum() == 6 and got["p1"].isna().sum() == 3


def test_running_split_hot_groups(events, hot_only):
    cols = {"s": (F.when(F.col("f"), 1).otherwise(0), "sum", False), "m": (F.when(F.col("f"), F.col("t")), "max", True)}
    got = frame(running(events, ["g"], "id", cols), "id")
    want = frame(events, "id")
    flag = want["f"].astype(int)
    want["s"] = flag.groupby(want["g"]).cumsum() - flag
    want["m"] = want["t"].where(want["f"]).groupby(want["g"]).cummax().groupby(want["g"]).ffill().fillna(0)
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)


def brute_counts(want, lo, hi):
    out = []
    for r in want.itertuples():
        near = want[(want.g == r.g) & (want.t >= r.t + lo) & (want.t <= r.t + hi)]
        out.append(int(near.f.sum()))
    return out


@pytest.mark.parametrize("limit", ["7", "100000"])
def test_range_counts(events, spark, limit):
    groups = measure_groups(events, ["g"], max_rows=int(limit))
    got = frame(range_counts(events, ["g"], "t", {"c": (F.col("f"), -10, -1)}, groups), "id")
    assert list(got["c"]) == brute_counts(frame(events, "id"), -10, -1)


def test_range_counts_fixture(spark):
    rows = [(1, 10, "shot"), (1, 12, "shot"), (1, 12, "hit"), (1, 14, "shot"), (1, 15, "shot")]
    df = spark.createDataFrame(rows, "g int, t bigint, e string")
    got = range_counts(df, ["g"], "t", {"c": (F.col("e") == "shot", -4, -1)}).orderBy("t").collect()
    assert [r["c"] for r in got] == [0, 1, 1, 2, 2]


def test_range_counts_long_axis(spark, hot_only):
    rng = np.random.default_rng(5)
    t = np.sort(rng.integers(0, 2_000_000, 400)).tolist() + [86_399, 86_400, 86_401, 172_800]
    df = spark.createDataFrame([(1, i, int(x), True) for i, x in enumerate(t)], "g int, id int, t bigint, f boolean")
    got = frame(range_counts(df, ["g"], "t", {"c": (F.col("f"), -20_000, -1)}), "id")
    assert list(got["c"]) == brute_counts(frame(df, "id"), -20_000, -1)


def test_group_values_agree(events):
    a = frame(group_values(events, ["g"], {"m": F.avg("v")}, True), "id")["m"]
    b = frame(group_values(events, ["g"], {"m": F.avg("v")}, False), "id")["m"]
    np.testing.assert_allclose(a, b)


@pytest.fixture(scope="module")
def ice(spark):
    rng = np.random.default_rng(2)
    points = [(int(rng.integers(1, 3)), i, int(rng.integers(0, 1000)), 1, 2) for i in range(80)]
    starts = rng.integers(0, 1000, 120)
    spans = [(int(rng.integers(1, 3)), int(s), int(s + rng.integers(0, 200)), int(rng.integers(1, 4))) for s in starts]
    return (
        spark.createDataFrame(points, "g bigint, id bigint, t bigint, home bigint, away bigint"),
        spark.createDataFrame(spans, "g bigint, a bigint, b bigint, team bigint"),
        points,
        spans,
    )


def test_interval_join_equals_brute_force(ice):
    p, s, points, spans = ice
    got = sorted((r["id"], r["a"], r["b"], r["team"]) for r in interval_join(p, s, ["g"], "t", "a", "b", "inner").collect())
    want = sorted((i, a, b, k) for g, i, t, _, _ in points for g2, a, b, k in spans if g == g2 and a <= t < b)
    assert got == want
    assert interval_join(p, s, ["g"], "t", "a", "b").select("id").distinct().count() == len(points)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_intervals_of_all_lengths(spark, how):
    """Lengths from 1 to ten million: the same pairs as brute force, and no interval in more than three nodes."""
    rng = np.random.default_rng(7)
    spans = []
    for i in range(300):
        start = int(rng.integers(-2_000_000, 2_000_000))
        spans.append((i, int(rng.integers(0, 3)) or None, start, start + int(10 ** rng.uniform(0, 7)) - (i % 50 == 0) * 10**8))
    points = [(i, int(rng.integers(0, 4)) or None, int(rng.integers(-4_000_000, 12_000_000)) if i % 20 else None) for i in range(300)]
    points += [(1000 + i, g, t) for i, (_, g, a, b) in enumerate(spans) for t in (a, b)]
    left = spark.createDataFrame(points, "p long, g long, t long")
    right = spark.createDataFrame(spans, "s long, g long, a long, b long")
    got = sorted(((r["p"], r["s"]) for r in interval_join(left, right, ["g"], "t", "a", "b", how).collect()), key=repr)
    want = []
    for p, g, t in points:
        met = [s for s, g2, a, b in spans if g is not None and g == g2 and t is not None and a <= t < b]
        want += [(p, s) for s in met] or ([(p, None)] if how == "left" else [])
    assert got == sorted(want, key=repr) and len(want) > 500
    assert _nodes(right, "a", "b").groupBy("s").count().agg(F.max("count")).first()[0] <= 3
    halves = right.select("s", "g", (F.col("a") / 8).alias("a"), (F.col("b") / 8).alias("b"))
    part = interval_join(left.withColumn("t", F.col("t") / 8), halves, ["g"], "t", "a", "b", how)
    assert sorted(((r["p"], r["s"]) for r in part.collect()), key=repr) == got


def test_interval_join_of_few_rows(spark):
    points = spark.createDataFrame([(1, 5), (1, 9)], "g long, t long")
    one = spark.createDataFrame([(1, 4, 8)], "g long, a long, b long")
    assert sorted(tuple(r) for r in interval_join(points, one, ["g"], "t", "a", "b").select("t", "a").collect()) == [(5, 4), (9, None)]
    assert interval_join(points, one.limit(0), ["g"], "t", "a", "b").count() == 2
    assert interval_join(points, one.limit(0), ["g"], "t", "a", "b", "inner").count() == 0
    assert interval_join(points.limit(0), one, ["g"], "t", "a", "b").count() == 0
    with pytest.raises(ValueError):
        interval_join(points, one, ["g"], "t", "a", "b", "right")


@pytest.mark.parametrize("limits", [{}, {"rinkflow.maxSmallRows": "10"}, {"rinkflow.maxSmallRows": "10", "rinkflow.maxGroupRows": "60"}])
def test_lookup_on_large_and_skewed_curves(spark, limits):
    """A curve whose points crowd at one end, found by number or by merging ranges, with a hot value and missing ones."""
    rng = np.random.default_rng(11)
    xs = np.unique(np.concatenate([rng.uniform(0, 1e-3, 1500), rng.uniform(0, 1000, 20)]))
    ys = rng.normal(size=len(xs))
    curve = spark.createDataFrame([(float(x), float(y)) for x, y in zip(xs, ys)], "x double, y double")
    at = [*rng.uniform(-10, 1100, 200), *rng.uniform(0, 1e-3, 300), *xs[::50], xs[0], xs[-1], *[float(xs[7])] * 300, None, float("nan")]
    points = spark.createDataFrame([(i, None if a is None else float(a)) for i, a in enumerate(at)], "i long, a double").repartition(3)
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        got = {r["i"]: r["v"] for r in interpolate_linear(points, F.col("a"), curve, "x", "y", "v").collect()}
    finally:
        for k in limits:
            spark.conf.unset(k)
    assert len(got) == len(at)
    for i, a in enumerate(at):
        if a is None or a != a:
            assert got[i] is None
            continue
        k = min(max(int(np.searchsorted(xs, a, "right")) - 1, 0), len(xs) - 2)
        assert got[i] == pytest.approx(ys[k] + (ys[k + 1] - ys[k]) / (xs[k + 1] - xs[k]) * (a - xs[k]), rel=1e-9, abs=1e-9)


def test_lookup_on_long_curve(spark):
    """A hundred thousand points are beyond the small tables: merged by ranges."""
    curve = spark.range(100_000).select((F.col("id") * F.col("id") * 1.0).alias("x"), (F.col("id") % 1000 * 1.0).alias("y"))
    points = spark.range(3000).select(F.col("id").alias("i"), (F.pow(F.col("id") * 31.7, F.lit(2.0)) + 0.25).alias("a"))
    got = interpolate_linear(points, F.col("a"), curve, "x", "y", "v").toPandas().set_index("i")
    x = np.arange(100_000.0) ** 2
    a = got["a"].to_numpy()
    k = np.clip(np.searchsorted(x, a, "right") - 1, 0, len(x) - 2)
    y = np.arange(100_000) % 1000
    np.testing.assert_allclose(got["v"], y[k] + (y[k + 1] - y[k]) / (x[k + 1] - x[k]) * (a - x[k]), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("sketch", [10_000, 20])
def test_ranges_follow_the_rows(spark, monkeypatch, sketch):
    """Ranges hold few rows whatever the number of shuffle partitions, also where the sketch alone is too coarse."""
    monkeypatch.setattr(ranks, "RANGE_ROWS", 50)
    monkeypatch.setattr(ranks, "SKETCH", sketch)
    rng = np.random.default_rng(5)
    values = [float(v) for v in rng.exponential(size=3000)] + [1.5] * 400 + [None] * 30
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").repartition(4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        cuts = ranks.range_cuts(df, "v")
        sizes = ranks.place(df, "v", cuts).where("v <> 1.5").groupBy(ranks.SLICE).count().toPandas()["count"]
        assert sizes.max() <= 55 and 1.5 in ranks.heavy_values(cuts)
        got = ranks.row_numbers(df, "v", "i").orderBy("row_number").select("i", "row_number").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = sorted(range(len(values)), key=lambda i: (values[i] is None, values[i] or 0.0, i))
    assert [r["i"] for r in got] == want and [r["row_number"] for r in got] == list(range(1, len(values) + 1))


def test_falling(spark, monkeypatch):
    monkeypatch.setattr(ranks, "RANGE_ROWS", 10)
    rows = [(float(i), float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "x double, v double")
    assert ranks.falling(df, "x", "v", "v").count() == 0
    assert sorted(r["x"] for r in ranks.falling(df.withColumn("v", F.when(F.col("x").isin(0.0, 60.0), 90.5).otherwise(F.col("v"))), "x", "v", "v").collect()) == [float(i) for i in range(1, 91) if i != 60]


@pytest.mark.parametrize("limit", [7, 100_000])
def test_cover_counts_equal_brute_force(ice, spark, limit):
    p, s, points, spans = ice
    spark.conf.set("rinkflow.maxGroupRows", str(limit))
    got = cover_counts(p, s, ["g", "id"], ["g"], "t", "a", "b", {"h": "home", "w": "away"}, "team")
    rows = {r["id"]: (r["h"], r["w"]) for r in got.collect()}
    spark.conf.unset("rinkflow.maxGroupRows")
    for g, i, t, home, away in points:
        live = [k for g2, a, b, k in spans if g == g2 and a <= t < b]
        assert rows[i] == (live.count(home), live.count(away))


def test_settle_checks_size(spark):
    assert settle(spark.range(5), 5).small
    big = settle(spark.range(6), 5)
    assert not big.small and big.df.count() == 6
    plan = join_dim(spark.range(10), settle(spark.range(3), 5), ["id"])._jdf.queryExecution().toString()
    assert "Broadcast" in plan


def test_pct_rank_fixture(spark, tight):
    values = [3.0, 1.0, 3.0, None, 7.0, 1.0, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    want = [75, 33.3333, 75, None, 100, 33.3333, 33.3333]
    for limit in ("3", "1000"):
        tight.conf.set("rinkflow.maxSmallRows", limit)
        got = [r["p"] for r in ranks.pct_rank(df, {"p": "v"}).orderBy("id").collect()]
        assert got == [w if w is None else pytest.approx(w, abs=1e-3) for w in want]


def test_value_counts_in_slices(spark, tight):
    rng = np.random.default_rng(3)
    v = np.where(rng.random(500) < 0.33, 5.0, np.round(rng.normal(size=500), 2))
    df = spark.createDataFrame([(float(x), 1.0) for x in v], "v double, w double")
    got = frame(ranks.value_counts(df, "v", {"sw": "w"}), "v")
    want = pd.Series(v).value_counts().sort_index()
    assert list(got["n"]) == list(want) and list(got["n_before"]) == list(want.cumsum() - want)
    np.testing.assert_allclose(got["sw_before"], want.cumsum() - want)


def test_row_numbers_with_a_heavy_value(spark, tight):
    rng = np.random.default_rng(4)
    v = np.where(rng.random(400) < 0.5, 1.0, rng.normal(size=400))
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id bigint, v double")
    got = frame(ranks.row_numbers(df, "v", "id", "rn"), "id")
    want = pd.DataFrame({"v": v, "id": range(400)}).sort_values(["v", "id"]).index
    assert list(got.sort_values("rn")["id"]) == list(want) and sorted(got["rn"]) == list(range(1, 401))


def test_row_numbers_with_nulls_and_groups(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 5.0, "a"), (3, 1.0, "b"), (4, 0.5, "b")], "id bigint, v double, k string")
    got = {r["id"]: r["rn"] for r in ranks.row_numbers(df, "v", "id", "rn", ["k"]).collect()}
    assert got == {2: 1, 1: 2, 4: 1, 3: 2}


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(1000)
    a = {r["id"] for r in ranks.sample_n(df, "id", 100, 1).collect()}
    assert len(a) == 100 and a == {r["id"] for r in ranks.sample_n(df.repartition(7), "id", 100, 1).collect()}
    assert a != {r["id"] for r in ranks.sample_n(df, "id", 100, 2).collect()}
    assert ranks.sample_n(df, "id", 5000).count() == 1000


def test_dense_codes(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 0)], "k string, o bigint")
    assert {r["k"]: r["code"] for r in ranks.dense_codes(df, "k", "o").collect()} == {"c": 0, "b": 1, "a": 2}


@pytest.mark.parametrize("limit", ["3", "1000"])
def test_interpolation(spark, limit):
    spark.conf.set("rinkflow.maxSmallRows", limit)
    x = np.array([0.0, 1.0, 2.5, 7.0, 7.5])
    y = np.array([1.0, 3.0, -1.0, 4.0, 4.5])
    curve = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double")
    at = [-2.0, 0.0, 0.5, 1.0, 3.3, 7.0, 7.5, 9.0]
    got = I.interpolate_linear(spark.createDataFrame([(a,) for a in at], "p double"), F.col("p"), curve, "x", "y", "v")
    rows = {r["p"]: r["v"] for r in got.collect()}
    spark.conf.unset("rinkflow.maxSmallRows")
    want = np.interp(at, x, y)
    want[0], want[-1] = 1 + 2 * -2.0, 4.5 + 1.0 * 1.5
    np.testing.assert_allclose([rows[a] for a in at], want)


def plain_loess(x, y, frac, iters):
    n = len(x)
    k = max(1, int(frac * n + 1e-10))
    delta = np.ones(n)
    for it in range(iters + 1):
        fit = np.empty(n)
        for i in range(n):
            d = x - x[i]
            h = np.sort(np.abs(d))[k - 1]
            w = delta * (1 - np.minimum(1, np.abs(d) / h) ** 3) ** 3
            a, b, c = w.sum(), (w * d).sum(), (w * d * d).sum()
            fit[i] = (c * (w * y).sum() - b * (w * d * y).sum()) / (a * c - b * b)
        r = y - fit
        s = np.median(np.abs(r))
        u = r / (6 * s)
        delta = np.where(np.abs(u) < 1, (1 - u * u) ** 2, 0)
    return fit


@pytest.mark.parametrize("iters,limit", [(0, "1000"), (3, "1000"), (3, "20")])
def test_loess_equals_a_direct_fit(spark, iters, limit):
    spark.conf.set("rinkflow.maxSmallRows", limit)
    rng = np.random.default_rng(6)
    x = np.round(rng.uniform(20, 40, 120), 1)
    y = np.sin(x / 4) + rng.normal(scale=0.2, size=120)
    y[7] += 5
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y double")
    got = {r["x"]: r["fitted"] for r in I.loess(df, "x", "y", 0.3, iters).collect()}
    spark.conf.unset("rinkflow.maxSmallRows")
    np.testing.assert_allclose([got[v] for v in x], plain_loess(x, y, 0.3, iters), rtol=1e-6, atol=1e-8)


def test_median(spark):
    for values in ([3.0, 1.0, 2.0], [4.0, 1.0, 1.0, 3.0]):
        assert I.exact_median(spark.createDataFrame([(v,) for v in values], "v double"), "v") == np.median(values)


def test_heads(spark):
    df = spark.createDataFrame([(1, 5.0, "x"), (2, None, "y"), (3, 9.0, "x"), (4, 5.0, "y")], "id bigint, v double, k string")
    assert [(r["rank"], r["id"]) for r in topk.top_n(df, "v", "id", 3).collect()] == [(1, 3), (2, 1), (3, 4)]
    assert [r["id"] for r in topk.sort_by(df, "v", "asc").collect()][0] == 2
    assert [r["id"] for r in topk.order_nulls_last(df, "-v", "id").collect()] == [3, 1, 4, 2]
    assert {r["k"]: r["id"] for r in topk.dedup_first(df, "k", "id").collect()} == {"x": 1, "y": 2}
    assert {r["k"]: r["v"] for r in topk.latest_per_key(df, "k", "id", ["v"]).collect()} == {"x": 9.0, "y": 5.0}
    assert topk.recent_rows(df, ["k"], ["id"], 1).count() == 2
    many = spark.range(5000).withColumn("k", F.lit(1))
    assert topk.recent_rows(many, ["k"], ["id"], 1500).agg(F.min("id"), F.count("*")).first() == (3500, 1500)
