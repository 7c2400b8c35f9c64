"""Operators on vectors against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rinkflow.llm import batches, metric, neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, v string, cell int, part int"


def vectors(rng, n, d=16):
    base = rng.standard_normal((n // 4, d))
    near = base[rng.integers(0, len(base), n)] + 0.15 * rng.standard_normal((n, d))
    return near.astype(np.float32)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    x = vectors(rng, 400)
    x[40:70] = x[3]
    x[100:110] = 3 * x[5]
    out = [(i, v.tolist(), int(i % 3), "v", 7, 8) for i, v in enumerate(x)]
    broken = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [], [1.0, 2.0]]
    out += [(500 + 50 * i, v, 1, None, None, None) for i, v in enumerate(broken)]
    return [*out, (900, x[3].tolist(), None, "v", 1, 1)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


def good(v):
    return v is not None and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_search(spark, frame, rows):
    for options in ({}, {"block": 50}, {"parts": 4}, {"sample": 40}):
        got = neighbours.nearest(frame, F.col("vec_id") % 50 == 0, **options).toPandas()
        kept = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if good(v)]
        hits = total = 0
        for q, v in kept:
            if q % 50:
                continue
            scores = sorted((-float(v @ w) / math.sqrt(float(v @ v) * float(w @ w)), i) for i, w in kept if i != q)
            own = got[got["query_id"] == q].sort_values("rank")
            assert list(own["rank"]) == [1, 2, 3, 4, 5]
            exact = {i: -s for s, i in scores}
            assert np.allclose(own["score"], [exact[i] for i in own["vec_id"]], atol=1e-12)
            assert sorted(zip(-own["score"], own["vec_id"], strict=True)) == list(zip(-own["score"], own["vec_id"], strict=True))
            hits += len({i for _, i in scores[:5]} & set(own["vec_id"]))
            total += 5
        assert hits / total >= 0.9 and set(got["query_id"]) == {i for i, v in kept if i % 50 == 0}
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
    few = spark.createDataFrame(rows[:3], SCHEMA)
    assert [r["vec_id"] for r in neighbours.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()] in ([1, 2], [2, 1])


def test_graph_parts_are_balanced():
    x = vectors(np.random.default_rng(4), 256)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argsort(-(u @ u.T), axis=1)[:, 1:9]
    part = neighbours.cut_graph(near, 8, np.random.default_rng(0))
    assert set(np.bincount(part)) == {32}
    inside = (part[near] == part[:, None]).mean()
    assert inside > 0.4  # by chance an eighth


def test_metric_join(spark, frame, rows):
    n = len(rows)
    links = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            (_, v, l1, *_), (_, w, l2, *_) = rows[a], rows[b]
            if a != b and l1 is not None and l1 == l2 and v and w and len(v) == len(w) and all(x is not None and math.isfinite(x) for x in v + w) and any(v) and any(w):
                v, w = np.array(v, np.float32).astype(float), np.array(w, np.float32).astype(float)
                links[a, b] = float(v @ w) / (math.sqrt(float(v @ v)) * math.sqrt(float(w @ w))) >= 0.93
    reach = np.arange(n)
    for _ in range(n):
        new = np.array([min(reach[i], *(reach[links[i]] if links[i].any() else [reach[i]])) for i in range(n)])
        if (new == reach).all():
            break
        reach = new
    for options in ({}, {"per_pivot": 20, "block": 16}, {"most_pivots": 3, "most_cells": 0}):
        got = {r["vec_id"]: r for r in metric.near_vectors(frame, **options).collect()}
        for i, r in enumerate(rows):
            own = got[r[0]]
            assert (own["n_links"], own["component_id"]) == (links[i].sum(), rows[reach[i]][0]), (options, r[0])
            assert own["kept"] == (own["component_id"] == r[0])
    assert links.sum() > 500 and metric.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(i, i + 1) for i in range(0, 300) if i % 50] + [tuple(map(int, rng.integers(400, 600, 2))) for _ in range(150)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    got = {r["node"]: r["component"] for r in batches.components(df).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert {k: v for k, v in got.items()} == {k: v for k, v in parent.items() if k in got}
    assert set(parent) - set(got) <= {x for a, b in edges if a == b for x in (a,)}
    assert batches.components(df.limit(0)).count() == 0
