"""Approximate nearest neighbours by learned partitions.

Fit (on a sample of at most ``sample`` vectors, the smallest by hash, so the driver holds a bounded matrix): the neighbour graph
of the sample is cut into equal parts by repeated bisection at the median of its second eigenvector; a softmax classifier learns
the part of a vector. Index: every row goes to its most probable part. Search: a query goes to as many of its most probable
parts as gave ``recall`` on the sample, and all rows of those parts are reranked by their exact cosine.

Parts are cut into blocks of about ``block`` rows and queries into blocks too, so that a part with a third of all rows is
spread over many tasks; a task holds one block of each. Each returns its best rows only, which are merged per query.

Vectors that are null, zero, of another length than the most frequent one, or with null or non-finite components take no part.
Rows with the query's own id are not its candidates. Ties go to the smaller id. Empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinkflow.llm.batches import stored
from rinkflow.llm.vectors import common_length, cosines, matrix, unit, usable


@dataclass(frozen=True)
class Router:
    """Weights of the classifier, and how many parts a query visits."""

    weights: np.ndarray
    visits: int

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return unit(rows) @ self.weights[:-1] + self.weights[-1]

    def parts(self, rows: np.ndarray) -> np.ndarray:
        return np.argmax(self.scores(rows), axis=1)

    def routes(self, rows: np.ndarray) -> np.ndarray:
        return np.argsort(-self.scores(rows), axis=1, kind="stable")[:, : self.visits]


def cut_graph(near: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Balanced parts of a neighbour graph (``near``: neighbours of each row); ``parts`` is a power of two."""
    n = len(near)
    links = np.zeros((n, n), np.float32)
    links[np.arange(n)[:, None], near] = 1
    links = np.maximum(links, links.T)
    part = np.zeros(n, np.int64)
    for _ in range(parts.bit_length() - 1):
        following = part * 2
        for p in np.unique(part):
            rows = np.flatnonzero(part == p)
            own = links[np.ix_(rows, rows)]
            degree = np.sqrt(own.sum(axis=1) + 1e-6)
            side, first = rng.standard_normal(len(rows)).astype(np.float32), degree / np.linalg.norm(degree)
            for _ in range(60):
                side -= first * (first @ side)
                side = (own @ (side / degree)) / degree + side
                side /= np.linalg.norm(side) + 1e-30
            following[rows[np.argsort(side / degree, kind="stable")[len(rows) // 2 :]]] += 1
        part = following
    return part


def train(rows: np.ndarray, part: np.ndarray, parts: int, rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Softmax regression by gradient steps with momentum."""
    x = np.hstack([unit(rows), np.ones((len(rows), 1))])
    y = np.eye(parts)[part]
    w, v = np.zeros((x.shape[1], parts)), np.zeros((x.shape[1], parts))
    for _ in range(rounds):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        v = 0.9 * v - rate * (x.T @ (p - y) / len(x) * parts + decay * w)
        w += v
    return w


def fit(rows: np.ndarray, parts: int = 16, near: int = 10, k: int = 5, recall: float = 0.97, tested: int = 512) -> Router:
    """Partition the sample's graph, learn it, and choose the visits that find ``recall`` of the sample's own neighbours."""
    while parts > 1 and len(rows) < 16 * parts:
        parts //= 2
    if parts == 1:
        return Router(np.zeros((rows.shape[1] + 1, 1)), 1)
    u = unit(rows)
    close = u @ u.T
    np.fill_diagonal(close, -2)
    order = np.argsort(-close, axis=1, kind="stable")[:, : max(near, k)]
    weights = train(rows, cut_graph(order[:, :near], parts, np.random.default_rng(7)), parts)
    router = Router(weights, parts)
    at, routes = router.parts(rows), router.routes(rows[:tested])
    # The visit at which each true neighbour is met.
    met = np.argmax(routes[:, None, :] == at[order[:tested, :k]][:, :, None], axis=2)
    share = np.cumsum(np.bincount(met.ravel(), minlength=parts)) / met.size
    return Router(weights, int(np.searchsorted(share, recall) + 1))


def nearest(
    base: DataFrame, queries: Column, k: int = 5, parts: int = 16, sample: int = 2048, block: int = 4096,
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, key, score): the ``k`` nearest found of every row for which ``queries`` holds."""
    rows = base.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), queries.alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    length = common_length(rows, "v")
    rows = rows.where(F.size("v") == length)
    picked = rows.select("v").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    router = fit(np.array([r["v"] for r in picked]).reshape(len(picked), -1), parts, k=k) if picked else Router(np.zeros((1, 1)), 1)

    def assign(frames):
        for f in frames:
            if len(f):
                x = matrix(f["v"])
                f["part"] = router.parts(x)
                routes = router.routes(x)
                f["routes"] = [r.tolist() if q else None for r, q in zip(routes, f["q"].fillna(False), strict=True)]
                yield f[["id", "v", "part", "routes"]]

    index = stored(rows.mapInPandas(assign, "id long, v array<double>, part int, routes array<int>"), "index")
    # One row per part: a handful, whatever the input.
    sizes = {r["part"]: r for r in index.groupBy("part").agg(F.count("*").alias("n"), F.count("routes").alias("q")).collect()}
    asked = sum(r["q"] for r in sizes.values())
    lots = max(1, -(-asked // block))
    cuts = F.element_at(F.array(*[F.lit(-(-sizes[p]["n"] // block) if p in sizes else 0) for p in range(parts)]), F.col("part") + 1)
    cut = F.pmod(F.xxhash64("id"), cuts).cast("int").alias("cut")
    left = index.select("id", "v", "part", cut, F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"))
    right = (
        index.where(F.col("routes").isNotNull())
        .select("id", "v", F.explode("routes").alias("part"), F.pmod(F.xxhash64("id"), F.lit(lots)).cast("int").alias("lot"))
        .where(cuts > 0)
        .select("id", "v", "part", F.explode(F.sequence(F.lit(0), cuts - 1)).alias("cut"), "lot")
    )
    keys = ("part", "cut", "lot")

    def rerank(have: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(have) or not len(ask):
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64"})
        ids, asks, out = have["id"].to_numpy(), ask["id"].to_numpy(), []
        x, y = matrix(have["v"]), matrix(ask["v"])
        for at in range(0, len(y), 512):
            score = cosines(y[at : at + 512], x)
            score[asks[at : at + 512, None] == ids[None, :]] = -np.inf
            best = np.partition(score, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
            q, i = np.nonzero((score >= best[:, None]) & np.isfinite(score))
            order = np.lexsort((ids[i], -score[q, i], q))
            q, i = q[order], i[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            q, i = q[place < k], i[place < k]
            out.append(pd.DataFrame({"query_id": asks[at + q], "id": ids[i], "score": score[q, i]}))
        return pd.concat(out)

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(rerank, "query_id long, id long, score double")
    # A row can meet a query in one block only; repeated rows of one id count once.
    best = found.groupBy("query_id", "id").agg(F.max("score").alias("score")).groupBy("query_id")
    top = best.agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "score"))), 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("pos", "t")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("t.id").alias(key), F.col("t.score").alias("score")
    )
