"""What the findings of the third round were about."""

import math

import pytest
from pyspark.sql import functions as F

from rinkflow.functions import numeric
from rinkflow.operators.topk import top_n
from rinkflow.plans import metrics

TESTDATA = "/root/testdata"


def test_held_out_scores_are_near_the_base(spark):
    from rinkflow.llm import queries

    rows = queries.op8_language_model(spark, f"{TESTDATA}/sf0.01").where("held_out").collect()
    assert rows and all(math.isfinite(r["score"]) for r in rows)
    base, score, alone = (sum(r[c] for r in rows) for c in ("base_score", "score", "lattice_score"))
    assert alone < 1.5 * base and score > 1.2 * base


def test_equal_groups_tie_whatever_the_order_of_their_rows(spark):
    values = [0.1 + 0.02 * (i % 11) for i in range(400)]
    rows = [(g, 0, v) for g in range(40) for v in sorted(values, key=lambda v, g=g: hash((g, v)))]
    df = spark.createDataFrame(rows, "goalie_id long, is_goal int, xg_prob double").repartition(7)
    board = metrics.gsax(df, ["goalie_id"])
    assert board.select("gsax").distinct().count() == 1
    assert [r["goalie_id"] for r in top_n(board, "gsax", "goalie_id", 10).orderBy("rank").collect()] == list(range(10))
    odd = spark.createDataFrame([(1, 0, float("nan")), (2, 0, 1e12), (2, 0, 0.5), (3, 1, None)], "goalie_id long, is_goal int, xg_prob double")
    got = {r["goalie_id"]: r["gsax"] for r in metrics.gsax(odd, ["goalie_id"]).collect()}
    assert math.isnan(got[1]) and got[2] == 1e12 + 0.5 and got[3] is None


@pytest.mark.parametrize("n", [0, 2, 4])
def test_signed_texts_round_by_the_exact_value(spark, n):
    values = [k / 10 ** (n + 1) * s for k in range(5, 400, 10) for s in (1, -1)] + [0.0, 1234567.125, -0.00001, 1e-320]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    got = {r["p"]: r["t"] for r in df.select("p", numeric.fmt_signed(F.col("p"), n).alias("t")).collect()}
    assert got == {v: f"{v:+.{n}f}" for v in values}


def test_goalies_are_eliminated_in_bounded_pieces(monkeypatch):
    import pyarrow as pa

    from rinkflow.plans import effects

    monkeypatch.setattr(effects, "GOALIES", 4)
    ids = [None, None, *[g for g in range(30) for _ in range(1 + g * 7 % 13)]]
    batches = [pa.RecordBatch.from_pydict({"goalie_id": pa.array(ids[i : i + 5], pa.int64()), "w": list(range(i, min(i + 5, len(ids))))}) for i in range(0, len(ids), 5)]
    pieces = list(effects._by_goalie(iter(batches)))
    assert [v for t, _ in pieces for v in t["w"].to_pylist()] == list(range(len(ids)))
    whole = [set(t["goalie_id"].to_pylist()) for t, _ in pieces]
    assert sum(map(len, whole)) == 31 and max(map(len, whole)) <= 4 and max(t.num_rows for t, _ in pieces) < 20
    assert all(n[0] == 0 and len(set(n)) == len(w) == n[-1] + 1 for (_, n), w in zip(pieces, whole, strict=True))
    assert list(effects._by_goalie(iter([]))) == []


def test_a_carried_text_is_sent_to_python_once(spark):
    from rinkflow.llm.toxicity import toxic_scores

    rows = [(i, "stone river " + ("grunkle" if i % 5 == 0 else "light") if i % 7 else None, "en") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(120)], "doc_id long, toxic int")
    wide = toxic_scores(docs, labels, F.lit(True), carry=("doc_id", "text", "lang"))
    scorer = wide._jdf.queryExecution().analyzed().children().head()
    assert scorer.nodeName() == "MapInArrow" and scorer.children().head().output().size() == 3
    plain = {r["doc_id"]: r["score"] for r in toxic_scores(docs, labels, F.lit(True)).collect()}
    got = {r["doc_id"]: r for r in wide.collect()}
    assert {i: r["score"] for i, r in got.items()} == plain
    assert all(got[i]["text"] == t and got[i]["lang"] == lang for i, t, lang in rows)


def test_importance_scores_all_columns_in_one_pass(spark, monkeypatch):
    from rinkflow.plans import models

    rows = [(i, float(i % 17) - 8, float(i % 5), int(i % 17 + i % 3 > 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, shot_distance double, shot_angle double, is_goal int")
    fill = {c: F.lit("x" if c in models.CATEGORY_FEATURES else 0.0) for c in models.MODEL_FEATURES if c not in df.columns}
    passes = []

    def score(model, df, new="xg_prob"):
        passes.append(df)
        return df.withColumn(new, 1 / (1 + F.exp(-F.col("shot_distance"))))

    monkeypatch.setattr(models, "score", score)
    found = models.permutation_importance(df.withColumns(fill), None, ["shot_angle", "shot_distance", "shot_type"], seed=3).collect()
    assert len(passes) == 1
    order = [r[0] for r in df.orderBy(F.xxhash64(F.lit(4), "event_id").cast("double"), "event_id").select("event_id").collect()]

    def loss(values):
        return sum(-math.log(1 / (1 + math.exp(-x if r[3] else x))) for x, r in zip(values, rows, strict=True)) / len(rows)

    rise = loss([rows[i][1] for i in order]) - loss([r[1] for r in rows])
    assert [(r[0], r[1]) for r in found] == [("shot_distance", pytest.approx(rise, abs=1e-9)), ("shot_angle", 0.0), ("shot_type", 0.0)]


@pytest.mark.parametrize("query", ["calibrate_isotonic", "isotonic_totals"])
def test_out_of_fold_scores_are_computed_once(spark, monkeypatch, query):
    from rinkflow.registry import models

    scored = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            scored.add(len(frame))
            yield frame

    schema = "event_id long, season long, is_goal int, oof_prob double"
    rows = spark.createDataFrame([(i, 1, int(i % 3 == 0), (i % 40) / 50 + 0.01) for i in range(400)], schema)
    monkeypatch.setattr(models, "_stored_features", lambda spark, path: rows)
    monkeypatch.setattr(models.L, "oof_predictions", lambda df: df.mapInPandas(count, schema))
    out = getattr(models, query)(spark, "/no/such/folder").collect()
    assert scored.value == 400
    assert len(out) == 400 if query == "calibrate_isotonic" else (out[0]["n"], out[0]["agrees"], out[0]["inversions"]) == (400, True, 0)


def test_near_copies_of_which_the_smallest_lost_most_form_one_family(spark, monkeypatch):
    """The smallest sets of a group lead little of it: led by them, most pairs of the group were compared one by one."""
    import random

    from rinkflow.llm import prefixtree

    rng = random.Random(5)
    words, rows = [f"w{i}" for i in range(400)], []
    for i in range(90):
        lost = set(rng.sample(range(400), 4 + i % 23))
        rows.append((i, " ".join(w for k, w in enumerate(words) if k not in lost)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    reach = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in range(90):
        for a, b in links:
            reach[a] = reach[b] = min(reach[a], reach[b])
    sizes = {}
    keep = prefixtree.stored
    monkeypatch.setattr(prefixtree, "stored", lambda d, name: sizes.update({name: (out := keep(d, name)).count()}) or out)
    got = {r["doc_id"]: r["component_id"] for r in prefixtree.similar_texts(df).collect()}
    assert got == reach and len(set(reach.values())) > 3
    assert sizes["families"] == 90 and sizes["more"] == 0


def test_large_groups_are_led_by_a_set_that_meets_many(spark):
    from rinkflow.llm import prefixtree

    rows = [(h, s, (100 + s) << 32, 9, 9, 4) for h in range(6) for s in ([h, 7, 8, 9] if h < 5 else [1, 2, 3, 9])] + [(9, s, s << 32, 5, 5, 2) for s in (4, 5)]
    meets = spark.createDataFrame(rows, "h long, s long, at long, lead long, lead_at long, k long")
    got = {(r["h"], r["s"]): (r["lead"], r["lead_at"]) for r in prefixtree.led_by_central(meets, 4).collect()}
    assert got == {(h, s): (9, 109 << 32) if k == 4 else (5, 5) for h, s, _, _, _, k in rows}


@pytest.mark.parametrize("rows", [0, 1, 2500])
def test_rows_of_a_key_lie_in_few_elements_of_its_state(rows):
    import pandas as pd

    from rinkflow.streaming import online

    class State:
        def __init__(self):
            self.elements, self.puts = [], 0

        def get(self):
            return iter(self.elements)

        def appendList(self, more):  # noqa: N802
            self.elements += more

        def put(self, new):
            self.elements, self.puts = list(new), self.puts + 1

        def clear(self):
            self.elements = []

    class Handle:
        def __init__(self):
            self.states, self.timers = {}, []

        def getListState(self, name, schema):  # noqa: N802
            return self.states.setdefault(name, State())

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

    class Watermark:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.at

    context, handle = online._Context([1], [(-10, -1)], 1000), Handle()
    context.init(handle)
    frame = pd.DataFrame({"ms": range(rows), "place": range(rows), "tie": "t", "axis": [None if i % 7 == 3 else i for i in range(rows)], "flags": 1, "text": [f'"{i}"' for i in range(rows)]})
    assert list(context.handleInputRows((1,), iter([frame.add_prefix("row_")]), None)) == []
    waiting, kept = handle.states["waiting"], handle.states["kept"]
    assert len(waiting.elements) == -(-rows // 1000)
    if rows:
        some = list(context.handleExpiredTimer((1,), Watermark(rows // 2), None))[0]
        rest = list(context.handleExpiredTimer((1,), Watermark(rows + 5000), None))
        found = pd.concat([some, *rest])
        assert found["__text"].tolist() == frame["text"].tolist() and found["__lag1"].tolist() == [None, *frame["text"]][:-1]
        known = frame["axis"].tolist()
        assert found["__n0"].tolist() == [0 if v != v or v is None else sum(w == w and w is not None for w in known[max(0, i - 10) : i]) for i, v in enumerate(known)]
        assert not waiting.elements and not kept.elements and kept.puts == 1


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_rows_are_chosen_by_bits(spark, small):
    from rinkflow.llm.batches import chosen_rows

    numbered = spark.range(0, 600, 1, 3).select(F.monotonically_increasing_id().alias("k"), F.concat(F.lit("t"), "id").alias("text")).persist()
    numbers = [r["k"] for r in numbered.orderBy("k").collect()]
    times = {k: i % 3 for i, k in enumerate(numbers) if i % 5 and i not in range(128, 200)}
    chosen = spark.createDataFrame([(k, n) for k, n in times.items() if n], "k long, times int").repartition(5)
    got = sorted(r["k"] for r in chosen_rows(numbered, chosen, "k", small).collect())
    assert got == sorted(k for k, n in times.items() for _ in range(n))
    assert chosen_rows(numbered, chosen.limit(0), "k", small).count() == 0


@pytest.mark.parametrize("stage", ["ngram_jaccard_join", "mixing"])
def test_stages_do_not_shuffle_texts(spark, tmp_path, stage):
    import corpus_pipeline as P

    text = F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") * 7 + k).cast("string")) for k in range(9)])
    docs = spark.range(0, 200, 1, 4).select((F.col("id") % 190).alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = dict(P.STAGES)[stage](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
        assert out.count() >= 200
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange hashpartitioning" not in plan


def test_counts_of_a_partition():
    import numpy as np

    from rinkflow.llm.prefixtree import Counts

    rng = np.random.default_rng(5)
    counts, every = Counts(most=300), Counts()
    values = [rng.integers(0, 200, n).astype(np.uint64) for n in (0, 1, 500, 90)]
    for v in values:
        counts.add(v)
        every.add(v)
    found, n = np.unique(np.concatenate(values), return_counts=True)
    assert (counts.values == found).all() and (counts.n == n).all() and (every.n == n).all()
    counts.add(np.arange(1000, 1400, dtype=np.uint64))
    assert len(counts.values) <= 300 and (counts.values == found[n >= 2]).all()
