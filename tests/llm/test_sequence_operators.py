"""Exact product search, periodic runs and the prefix tree against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rinkflow.llm import conversations, pivots, queries, squares
from rinkflow.session import GROUP_ROWS_CONF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- exact top-k -------------------------------------------------------------------------------------------------------


def answers(rows, step, k):
    good = [
        (i, [math.floor(1024 * a) if abs(a) < 2**60 else 1024 * int(a) for a in v], v)
        for i, v, _ in rows
        if i is not None and v is not None and all(a is not None and math.isfinite(a) for a in v)
    ]
    asks = {}
    for i, q, v in good:
        if i % step == 0 and (i not in asks or v < asks[i][1]):
            asks[i] = (q, v)
    out = []
    for i, (q, _) in asks.items():
        scores = ((max(min(sum(a * b for a, b in zip(q, w, strict=True)), 2**63 - 1), -(2**63)), j) for j, w, _ in good if j != i and len(w) == len(q))
        out += [(i, r + 1, j, s) for r, (s, j) in enumerate(sorted(scores, key=lambda t: (-t[0], t[1]))[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 8))[rng.integers(0, 40, 500)] + 0.05 * rng.standard_normal((500, 8))
    x[30:230] = x[3]  # one vector holds more than a third of all rows
    x[240], x[241], x[260] = 1e18, -1e30, 1e200
    rows = [(i, [float(a) for a in v], "k") for i, v in enumerate(x)]
    broken = [None, [1.0, None], [float("nan")] * 8, [float("inf")] * 8]
    rows += [(700 + i, v, "a") for i, v in enumerate(broken)]
    return rows + [(None, [1.0] * 8, "b"), (720, [1.0, 2.0], "c"), (740, [3.0, 1.0], "c"), (800, [], ""), (820, [], ""), (840, [0.0] * 8, None), (20, [9.0] * 8, ""), (33, [9.0] * 8, "")]


@pytest.mark.parametrize("options", [{}, {"block": 32, "group": 8}, {"pivots": 3, "sample": 10, "block": 50, "group": 16, "k": 3}])
def test_top_products(spark, vectors, options):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, cell string").repartition(3)
    got = sorted(tuple(r) for r in pivots.top_products(df, F.col("vec_id") % 20 == 0, **options).collect())
    assert got == answers(vectors, 20, options.get("k", 10))


def test_bounds_leave_candidates_out(spark):
    """On clustered vectors most candidates are never scored, and the answer is the whole one."""
    rng = np.random.default_rng(5)
    centres = 30 * rng.standard_normal((10, 16))
    x = np.floor(1024 * (centres[rng.integers(0, 10, 4000)] + 0.1 * rng.standard_normal((4000, 16)))) / 1024
    p = pivots.farthest_first(np.floor(1024 * x[:500]), 16)
    import pandas as pd

    frame = pd.DataFrame({"id": np.arange(len(x)), "v": list(x), "d": list(pivots.distances(np.floor(1024 * x), p).astype(np.float32))})
    scored = []
    plain = pivots.products
    try:
        pivots.products = lambda rows, query, small: scored.append(len(rows)) or plain(rows, query, small)
        got = pivots.search_block(frame[:50].assign(beat=-(2**63)), frame, 10, 1024)
    finally:
        pivots.products = plain
    assert sum(scored) < 0.5 * 50 * len(x)
    whole = np.floor(1024 * x).astype(np.int64)
    for q, part in got.groupby("query_id"):
        s = whole @ whole[q]
        s[q] = -(2**62)
        assert sorted(part["score"], reverse=True) == sorted(s, reverse=True)[:10]


def test_top_products_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert pivots.top_products(spark.createDataFrame([], schema), F.col("vec_id") % 2 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0])], schema)
    assert pivots.top_products(one, F.col("vec_id") % 2 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema)
    assert [tuple(r) for r in pivots.top_products(two, F.col("vec_id") % 2 == 0).collect()] == [(0, 1, 1, 2 * 1024 * 1024)]


# --- periodic runs -----------------------------------------------------------------------------------------------------


def plain_runs(w, times=4, least=6):
    out = []
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            if w[i] == w[i + p]:
                j = i
                while j + p < len(w) and w[j] == w[j + p]:
                    j += 1
                if j + p - i >= max(least, times * p) and not any(q < p and a <= i and b >= j + p for a, b, q in out):
                    out.append((i, j + p, p))
                i = j
            i += 1
    return sorted((a, b - a, p) for a, b, p in out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9)), max_size=8), st.lists(st.integers(1, 40), min_size=1, max_size=5))
def test_runs_of_any_stream_in_any_pieces(parts, pieces):
    words = [c for unit, times in parts for c in unit * times]
    catchers, at = squares.Catchers(), 0
    while at < len(words):
        piece = pieces[at % len(pieces)]
        catchers.append(np.array(words[at : at + piece], np.uint64))
        at += piece
    assert catchers.runs() == plain_runs(words)


def test_long_streams():
    rng = random.Random(3)
    assert squares.stream_runs([[b"a"] * 200_000], 4, 6) == [[(0, 200_000, 1)]]
    assert squares.stream_runs([[b"a", b"b"] * 100_000], 4, 6) == [[(0, 200_000, 2)]]
    blocks = ([b"a"] * 999 + [b"b"]) * 200
    assert squares.stream_runs([blocks], 4, 6)[0][:2] == [(0, 999, 1), (0, 200_000, 1000)]
    odd = [bytes([i.bit_count() & 1]) for i in range(1 << 16)]  # has no cube, and defeats polynomial hashes
    assert squares.stream_runs([odd], 4, 6) == [[]]
    assert squares.stream_runs([[str(rng.random()).encode() for _ in range(50_000)]], 4, 6) == [[]]
    with pytest.raises(ValueError):
        squares.Catchers(times=3)


def test_clashing_names_are_verified(monkeypatch):
    """Names that are equal for many different windows give wrong catches, never wrong runs."""
    words = [1, 2, 3, 4] * 6 + [5, 1, 2, 3, 9] + [7] * 8
    monkeypatch.setattr(squares, "mix", lambda x: x % np.uint64(3))
    catchers = squares.Catchers()
    catchers.append(np.array(words, np.uint64))
    for start, length, period in catchers.runs():
        assert words[start : start + length - period] == words[start + period : start + length]


DOCS = [
    (10 + i, t)
    for i, t in enumerate(
        [None, "", " \t\n", "a a a a a a", "a " * 5, "x y z " * 4 + "x", "Ä ö Ä ö " * 5, "one two three", "q\x0bq\x0cq\rq\nq\tq q", "  \x1c " * 9]
    )
]


def plain_row(key, text, rebuilt=True):
    w = WORD.findall(text or "")
    n = len(w)
    if rebuilt and key is not None and n:
        h = zlib.crc32(str(key).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    top = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in drop)
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (key, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_registered_runs(spark, tmp_path):
    rng = random.Random(8)
    docs = DOCS + [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))) for i in range(100, 400)]
    docs += [(None, "b b b b b b b"), (3, "c d " * 9), (3, "c d " * 9), (-7, "w " * 50), (999, "long " * 30_000)]
    spark.createDataFrame([(*d, "n", 5) for d in docs], "doc_id long, text string, runs string, n_words int").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    expected = sorted([plain_row(*d) for d in docs if d[0] != 999], key=repr)
    assert [r for r in got if r[0] != 999] == expected
    assert [r[1] for r in got if r[0] == 999] == [1]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert squares.periodic_runs(empty).count() == 0
    assert [r["runs"] for r in squares.periodic_runs(spark.createDataFrame([(10, "a " * 7)], "doc_id long, text string")).collect()] == [[(0, 7, 1)]]


# --- prefix tree -------------------------------------------------------------------------------------------------------

TREE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_tree(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((-(2**63) if t is None else t, r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v, key=lambda t: (t[0], hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest()[:16]))] for c, v in own.items()}
    members = {}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:])
        for d in range(len(paths[c]) + 1):
            members.setdefault(paths[c][:d], []).append(c)
    below = {}
    for k in members:
        if k:
            below.setdefault(k[:-1], []).append(k)
    out = {}
    for k in sorted(members, key=len, reverse=True):
        kids = below.get(k, [])
        words = len(WORD.findall(k[-1][1])) if k else 0
        ends = ",".join(map(str, sorted(c for c in members[k] if len(paths[c]) == len(k))))
        out[k] = (
            min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids), sum(out[x][5] for x in kids) if kids else 1,
            sum(out[x][6] for x in kids) + (len(members[k]) - 1) * words, hashlib.sha256(ends.encode()).hexdigest(),
        )
    return sorted(out.values())


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(1)
    rows = []
    for c in [*range(70), -5, -20, -21, 105, 10**15, None]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 9, 20])):
            rows.append((c, None if rng.random() < 0.05 else t, rng.choice(["u", "a", None]), rng.choice(["x", "y z", "", None, "hello big world"]), "z", 1))
    rows += [(200, t, "u", "same", "z", 1) for t in range(60)] + [(201, t, "u", "same", "z", 1) for t in range(61)]
    rows += [(300 + i, t, "u", "hot", "z", 1) for i in range(60) for t in range(3)]  # a third begins alike
    return rows + [(5, 0, "u", "x", "z", 1)] * 2  # rows that repeat


@pytest.mark.parametrize(("width", "heavy", "limit"), [(8, 50_000, None), (2, 50_000, "7"), (3, 1, None), (1, 5, None)])
def test_prefix_tree(spark, turns, width, heavy, limit):
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, c string, len int").repartition(3)
    if limit:
        spark.conf.set(GROUP_ROWS_CONF, limit)
    try:
        tree = conversations.prefix_tree(df, width=width, heavy=heavy)
        assert sorted((tuple(r) for r in tree.select(*TREE).collect()), key=lambda r: r[:2]) == plain_tree([r[:4] for r in turns])
        names = tree.select("node", "parent").collect()
        assert len({r[0] for r in names}) == len(names) and {r[1] for r in names} - {None} <= {r[0] for r in names}
    finally:
        spark.conf.unset(GROUP_ROWS_CONF)


def test_prefix_tree_without_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert conversations.prefix_tree(spark.createDataFrame([], schema)).count() == 0
    assert conversations.prefix_tree(spark.createDataFrame([(None, 1, "u", "x")], schema)).count() == 0
    alone = conversations.prefix_tree(spark.createDataFrame([(21, None, None, None)], schema)).select(*TREE).collect()
    assert sorted(tuple(r) for r in alone) == plain_tree([(21, None, None, None)])
