"""Exact top-k search by elimination with a pivot table.

Components become whole numbers, floor(scale * x), and rows are scored by their inner product with the query, as integers. Since
2 <q, x> = |q|^2 + |x|^2 - |q - x|^2, a lower bound of the distance bounds the score from above. The bounds come from a table of every
row's distances to ``pivots`` pivots (taken farthest first from the ``sample`` rows that are smallest by hash; they decide the work,
never the result): |q - x| is at least the largest |d(q, p) - d(x, p)|.

Rows lie in blocks of about ``block`` rows by their nearest pivot, queries in blocks of about ``group``. A first round searches one
block for each block of queries, the one whose distances are most alike, which gives every query a score to beat. The second round
searches the other blocks, but for those that the ranges of distances of both blocks exclude. In a block, a query evaluates the
candidates in the order of their bounds and stops at the first one whose bound is below its k-th best score. A task holds one block
of each kind and returns at most k rows a query, and of these only the best k of a partition are shuffled.

Vectors that are null or hold null or non-finite components, and rows with a null id, take no part; zero vectors do. Only vectors of
one length are compared. Rows with the query's own id are not its candidates; rows that repeat an id are candidates each, and a
repeated query id asks once, with the smallest of its vectors. Scores beyond 64 bits are cut to their range. Equal scores go to the
smaller id. Empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rinkflow.llm.batches import stored
from rinkflow.operators.sizing import join_dim, settle

#: Values of vectors that a block may hold.
VALUES = 1 << 23
FIRST_CHUNK = 64
LONG = (1 << 63) - 1


def whole(column: pd.Series, scale: int) -> np.ndarray:
    """Rows as whole numbers in doubles; exact, since a double times a power of two is."""
    rows = np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))
    with np.errstate(over="ignore"):
        return np.floor(rows * scale)


def lengths(column: pd.Series) -> pd.Series:
    return column.map(len)


def distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances; not a number or infinite where squares leave the range of doubles."""
    with np.errstate(over="ignore", invalid="ignore"):
        squares = (rows * rows).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * (rows @ pivots.T)
        return np.sqrt(np.maximum(squares, 0))


def farthest_first(rows: np.ndarray, wanted: int) -> np.ndarray:
    """Rows that are far from each other: each next one has the largest distance to those before."""
    picked, least = [0], distances(rows, rows[:1])[:, 0]
    while len(picked) < min(wanted, len(rows)):
        following = int(np.argmax(np.nan_to_num(least, nan=0.0, posinf=0.0)))
        if not least[following] > 0:
            break
        picked.append(following)
        least = np.minimum(least, distances(rows, rows[following : following + 1])[:, 0])
    return rows[picked]


def products(rows: np.ndarray, query: np.ndarray, small: bool) -> np.ndarray:
    """Inner products as integers: by doubles where these hold every sum, else by whole numbers of any size."""
    if small:
        return (rows @ query).astype(np.int64)
    exact = [int(v) for v in query]
    sums = [sum(int(a) * b for a, b in zip(r, exact, strict=True)) for r in rows]
    return np.array([min(max(s, -LONG - 1), LONG) for s in sums], np.int64)


def search_block(q: pd.DataFrame, x: pd.DataFrame, k: int, scale: int) -> pd.DataFrame:
    """The best k of a block for each query, better than what it has: candidates in bound order until the bound stops it."""
    queries, rows = whole(q["v"], scale), whole(x["v"], scale)
    size = queries.shape[1]
    with np.errstate(over="ignore", invalid="ignore"):
        small = bool(np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * size < 2**53)
        nq, nx = (queries * queries).sum(axis=1), (rows * rows).sum(axis=1)
    dq, dx = np.stack(q["d"].to_numpy()), np.stack(x["d"].to_numpy()).T.copy()
    ids, out = x["id"].to_numpy(), []
    for i, (own, beat) in enumerate(zip(q["id"].tolist(), q["beat"].tolist(), strict=True)):
        with np.errstate(over="ignore", invalid="ignore"):
            apart = np.abs(dx - dq[i][:, None]).max(axis=0).astype(np.float64)
            # Distances are kept as floats of 24 bits: less what rounding can add.
            apart = np.maximum(apart - 4e-7 * (dx.max(axis=0) + dq[i].max()), 0)
            bound = (nq[i] + nx - apart * apart) / 2 * (1 + 1e-12) + 1
        bound = np.where(np.isfinite(bound), bound, np.inf)
        best, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        open_ = np.flatnonzero(bound >= beat)
        open_ = open_[np.argsort(-bound[open_], kind="stable")]
        at, chunk = 0, FIRST_CHUNK
        while at < len(open_) and bound[open_[at]] >= beat:
            part = open_[at : at + chunk]
            part, at, chunk = part[ids[part] != own], at + chunk, chunk * 4
            score = products(rows[part], queries[i], small)
            kept = score >= beat
            best, found = np.concatenate([best, score[kept]]), np.concatenate([found, ids[part[kept]]])
            # Not by negated scores: the least one has no negation.
            top = np.lexsort((found, ~best))[:k]
            best, found = best[top], found[top]
            if len(best) == k:
                beat = max(beat, int(best[-1]))
        out.append(pd.DataFrame({"query_id": own, "vec_id": found, "score": best}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")


def blocked(rows: DataFrame, per: int) -> DataFrame:
    """Add ``lot`` and ``cut``: small cells side by side share a lot of about ``per`` rows, large ones are cut by hash."""
    before = W.partitionBy("size").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    # A row per cell and length.
    cells = rows.groupBy("size", "cell").agg(F.count("*").alias("n"))
    cells = cells.select("size", "cell", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / per).alias("lot"), F.ceil(F.col("n") / per).alias("cuts"))
    return join_dim(rows, settle(cells), ["size", "cell"]).withColumn("cut", F.pmod(F.xxhash64("id"), F.col("cuts"))).drop("cuts")


def boxes(rows: DataFrame, pivots: int, prefix: str) -> DataFrame:
    """A row per block: its ranges of distances to the pivots, and its largest square."""
    d = F.col("d")
    named = [F.col(c).alias(f"{prefix}{c}") for c in ("lot", "cut")]
    return rows.groupBy("size", *named).agg(
        F.array(*[F.min(d[i]) for i in range(pivots)]).alias(f"{prefix}lo"),
        F.array(*[F.max(d[i]) for i in range(pivots)]).alias(f"{prefix}hi"),
        F.max("square").alias(f"{prefix}square"),
        F.count("*").alias(f"{prefix}n"),
    )


def paired(queries: DataFrame, rows: DataFrame, pivots: int) -> DataFrame:
    """Every block of queries with every block of rows of its length: the bound of their scores, and how far their ranges are apart."""
    q, x = boxes(queries, pivots, "q"), boxes(rows, pivots, "x")

    def largest(f) -> Column:
        both = F.arrays_zip("qlo", "qhi", "xlo", "xhi")
        return F.array_max(F.transform(both, f))

    gap = largest(lambda t: F.greatest(t["xlo"] - t["qhi"], t["qlo"] - t["xhi"], F.lit(0.0))).cast("double")
    apart = largest(lambda t: F.abs(t["xlo"] + t["xhi"] - t["qlo"] - t["qhi"])).cast("double")
    wide = (F.array_max("qhi") + F.array_max("xhi")).cast("double")
    pairs = q.join(x, "size").withColumns({"gap": F.greatest(gap - 4e-7 * wide, F.lit(0.0)), "apart": apart})
    bound = (F.col("qsquare") + F.col("xsquare") - F.col("gap") * F.col("gap")) / 2 * (1 + 1e-9) + 1
    return pairs.select("size", "qlot", "qcut", "xlot", "xcut", "xn", "apart", F.when(F.isnan(bound), float("inf")).otherwise(bound).alias("bound"))


def searched(pairs: DataFrame, queries: DataFrame, rows: DataFrame, k: int, scale: int) -> DataFrame:
    """(query_id, vec_id, score): what the paired blocks give."""
    tasks = settle(pairs.select("size", "qlot", "qcut", "xlot", "xcut"))
    block = ["size", "qlot", "qcut", "xlot", "xcut"]
    q = join_dim(queries.withColumnsRenamed({"lot": "qlot", "cut": "qcut"}), tasks, ["size", "qlot", "qcut"], "inner")
    x = join_dim(rows.withColumnsRenamed({"lot": "xlot", "cut": "xcut"}), tasks, ["size", "xlot", "xcut"], "inner")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return search_block(left, right, k, scale)

    q, x = q.select(*block, "id", "v", "d", "beat"), x.select(*block, "id", "v", "d")
    return q.groupBy(*block).cogroup(x.groupBy(*block)).applyInPandas(search, "query_id long, vec_id long, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_products(
    base: DataFrame, asks: Column, k: int = 10, scale: int = 1024, pivots: int = 32, sample: int = 2048, block: int = 4096, group: int = 1024,
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``asks`` selects, the k highest inner products among all other rows."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = base.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))
    # At most ``sample`` rows on the driver.
    picked = rows.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).toPandas()["v"]
    chosen = {n: farthest_first(whole(part, scale), pivots) for n, part in picked.groupby(lengths(picked))}

    def measure(frames):
        for frame in frames:
            for n, part in frame.groupby(lengths(frame["v"])):
                own = whole(part["v"], scale)
                d = np.zeros((len(part), pivots), np.float32)
                p = chosen.get(n)
                if p is not None:
                    with np.errstate(over="ignore"):
                        d[:, : len(p)] = distances(own, p)
                    # Where squares left the range of doubles nothing is known.
                    d[~np.isfinite(d).all(axis=1)] = np.inf
                with np.errstate(over="ignore"):
                    square = (own * own).sum(axis=1)
                cell = d[:, : len(p)].argmin(axis=1) if p is not None else np.zeros(len(part), np.int64)
                yield part.assign(size=n, cell=cell, square=square, d=list(d))

    kind = base.schema[vector].dataType.simpleString()
    schema = f"id long, v {kind}, asks boolean, size int, cell int, square double, d array<float>"
    measured = stored(rows.mapInPandas(measure, schema), "pivot-table")
    widest = measured.agg(F.max("size")).first()[0] or 1
    block, group = (max(16, min(n, VALUES // widest)) for n in (block, group))
    candidates = stored(blocked(measured.drop("asks"), block), "candidates")
    once = measured.where("asks").groupBy("id").agg(F.min(F.struct("v", "size", "cell", "square", "d")).alias("q")).select("id", "q.*")
    queries = stored(blocked(once, group).withColumn("beat", F.lit(-LONG - 1)), "queries")

    pairs = stored(paired(queries, candidates, pivots), "pairs")
    nearest = W.partitionBy("size", "qlot", "qcut").orderBy("apart", F.desc("xn"), "xlot", "xcut")
    pairs = pairs.withColumn("turn", F.row_number().over(nearest))
    first = stored(searched(pairs.where("turn = 1"), queries, candidates, k, scale), "first")
    known = first.groupBy(F.col("query_id").alias("id")).agg(F.min("score").alias("least"), F.count("*").alias("found"))
    queries = stored(
        queries.join(known, "id", "left").withColumn("beat", F.when(F.col("found") == k, F.col("least")).otherwise(F.col("beat"))).drop("least", "found"), "queries"
    )
    lowest = queries.groupBy("size", F.col("lot").alias("qlot"), F.col("cut").alias("qcut")).agg(F.min("beat").alias("lowest"))
    rest = pairs.where("turn > 1").join(lowest, ["size", "qlot", "qcut"]).where("bound >= lowest")
    return best(first.unionAll(searched(rest, queries, candidates, k, scale)), k)
