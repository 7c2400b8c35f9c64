"""Near-duplicate vectors by an exact metric range join.

On vectors of length 1 a cosine of at least c is a distance of at most r = sqrt(2 - 2c). Pivots, a bounded number of rows taken by
hash, part the vectors of their label: each vector's home is the cell of its nearest pivot. Where a vector x and a vector y of
another cell are within r, the triangle inequality bounds x's distances: to the pivot of y's cell by its distance to its own
pivot plus 2r, and to every pivot of the label by the range of distances that y's cell has, widened by r. A vector is copied to
the cells that none of these bounds excludes, only to cells after its own, so that a pair meets in one cell. Cells join
independently; a large cell is cut into blocks, and every pair of blocks is a task of its own.

Equal vectors of a label are first collapsed to one row with their count; tasks return counts and a spanning set of links, never
pairs, so a label or a group of copies with a third of all rows is neither gathered nor expanded.

Null, zero and non-finite vectors, and rows with a null label, link with nothing and are components of their own. Vectors of
different length never link. Empty tables give no rows; rows that repeat an id are counted each.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkflow.llm.batches import components, stored, union_find
from rinkflow.llm.vectors import matrix, unit, usable

SLACK = 1e-9


def pick_pivots(reps: DataFrame, rows: int, most: int, per: int) -> pd.DataFrame:
    """At most ``most`` vectors, the smallest by hash: about one of every ``per`` rows."""
    wanted = min(most, max(1, rows // per))
    return reps.select("label", "v").orderBy(F.xxhash64("v"), "label").limit(wanted).toPandas()


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ pivots.T)))


def near_vectors(
    base: DataFrame, cosine: float = 0.93, most_pivots: int = 512, per_pivot: int = 1000, block: int = 2048, most_cells: int = 100_000,
    key: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    reach = math.sqrt(2 - 2 * cosine) + SLACK
    rows = stored(
        base.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v")).withColumn(
            "ok", F.col("label").isNotNull() & F.col("id").isNotNull() & usable(F.col("v"))
        ),
        "vectors",
    )
    good = rows.where("ok")
    reps = stored(good.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("w")), "distinct")
    n = reps.count()
    picked = pick_pivots(reps, n, most_pivots, per_pivot)
    pivots = {}
    for (value, size), part in picked.groupby(["label", picked["v"].map(len)]):
        pivots[value, size] = unit(matrix(part["v"]))

    def own(frame: pd.DataFrame):
        """Groups of a batch with the same label and length: rows, vectors, pivots."""
        for (value, size), part in frame.groupby(["label", frame["v"].map(len)]):
            x = unit(matrix(part["v"]))
            yield value, size, part, x, pivots.get((value, size), x[:0])

    def ranges(frames):
        """For each cell and pivot, the least and largest distance of the cell's own vectors in this partition."""
        seen: dict = {}
        for frame in frames:
            for value, size, _, x, p in own(frame):
                if len(p):
                    d = distances(x, p)
                    home = d.argmin(axis=1)
                    for c in np.unique(home):
                        lo, hi = d[home == c].min(axis=0), d[home == c].max(axis=0)
                        old = seen.get((value, size, int(c)), (lo, hi))
                        seen[value, size, int(c)] = np.minimum(lo, old[0]), np.maximum(hi, old[1])
        table = [(v, s, c, k, a, b) for (v, s, c), (lo, hi) in seen.items() for k, (a, b) in enumerate(zip(lo, hi, strict=True))]
        yield pd.DataFrame(table, columns=["label", "size", "cell", "pivot", "lo", "hi"])

    kind = base.schema[label].dataType.simpleString()
    schema = f"label {kind}, size int, cell int, pivot int, lo double, hi double"
    grouped = reps.mapInPandas(ranges, schema).groupBy("label", "size", "cell", "pivot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    # At most the square of the number of pivots of a label, which is bounded.
    bounds: dict = {}
    for (value, size), part in grouped.toPandas().groupby(["label", "size"]):
        m = len(pivots[value, size])
        lo, hi = np.full((m, m), np.inf), np.full((m, m), -np.inf)
        lo[part["cell"], part["pivot"]], hi[part["cell"], part["pivot"]] = part["lo"], part["hi"]
        bounds[value, size] = lo, hi

    def place(frames):
        for frame in frames:
            for value, size, part, x, p in own(frame):
                rows = part[["label", "rep", "w", "v"]].assign(size=size)
                if not len(p):
                    yield rows.assign(cell=0, home=True)
                    continue
                d = distances(x, p)
                home = d.argmin(axis=1)
                yield rows.assign(cell=home, home=True)
                lo, hi = bounds[value, size]
                least = d[np.arange(len(d)), home]
                for c in range(1, len(p)):
                    near = (home < c) & (d[:, c] <= least + 2 * reach)
                    near &= ((d >= lo[c] - reach) & (d <= hi[c] + reach)).all(axis=1)
                    if near.any():
                        yield rows[near].assign(cell=c, home=False)

    placed = stored(
        reps.mapInPandas(place, f"label {kind}, rep long, w long, v array<double>, size int, cell int, home boolean"), "cells"
    )
    cell = ["label", "size", "cell"]
    sizes = placed.groupBy(*cell).agg(
        F.greatest(F.lit(1), F.ceil(F.count(F.when(F.col("home"), 1)) / block)).cast("int").alias("nh"),
        F.ceil(F.count(F.when(~F.col("home"), 1)) / block).cast("int").alias("nf"),
    )
    sizes = stored(sizes, "cell-sizes")
    # A row per cell: few where labels are few, else joined by shuffle.
    cut = placed.join(F.broadcast(sizes) if sizes.count() <= most_cells else sizes, cell)
    cut = cut.withColumn("b", F.pmod(F.xxhash64("rep"), F.when(F.col("home"), F.col("nh")).otherwise(F.col("nf"))).cast("int"))
    # A task (x, y) pairs home block x with block y: home blocks from x on, then the blocks of copies.
    first = F.transform(F.sequence(F.lit(0), F.col("nh") + F.col("nf") - 1), lambda y: F.struct(F.col("b").alias("x"), y.alias("y"), F.lit(True).alias("left")))
    first = F.filter(first, lambda t: t["y"] >= t["x"])
    second = F.transform(F.sequence(F.lit(0), F.col("b")), lambda x: F.struct(x.alias("x"), F.col("b").alias("y"), F.lit(False).alias("left")))
    second = F.filter(second, lambda t: t["x"] < t["y"])
    copied = F.transform(
        F.sequence(F.lit(0), F.col("nh") - 1), lambda x: F.struct(x.alias("x"), (F.col("nh") + F.col("b")).alias("y"), F.lit(False).alias("left"))
    )
    tasks = cut.select(*cell, "rep", "w", "v", F.explode(F.when(F.col("home"), F.concat(first, second)).otherwise(copied)).alias("t"))
    tasks = tasks.select(*cell, "rep", "w", "v", "t.x", "t.y", "t.left")

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        side = frame["left"].to_numpy()
        same = frame["x"].iloc[0] == frame["y"].iloc[0]
        a = frame[side]
        b = a if same else frame[~side]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "n": []}).astype("int64")
        ra, rb, wa, wb = (f[c].to_numpy() for c, f in (("rep", a), ("rep", b), ("w", a), ("w", b)))
        x, y = matrix(a["v"]), matrix(b["v"])
        # The product of matrices gives every pair that may link; those near the threshold are summed anew in a fixed order.
        score = unit(x) @ unit(y).T
        link = score >= cosine
        edge = np.abs(score - cosine) < 1e-9
        for i, j in zip(*np.nonzero(edge), strict=True):
            link[i, j] = float(x[i] @ y[j]) / (math.sqrt(float(x[i] @ x[i])) * math.sqrt(float(y[j] @ y[j]))) >= cosine
        if same:
            np.fill_diagonal(link, False)
        i, j = np.nonzero(link)
        na = link @ wb
        nodes, tops = union_find(ra[i].tolist(), rb[j].tolist())
        counts = [(r, r, c) for r, c in zip(ra, na, strict=True) if c]
        if not same:
            counts += [(r, r, c) for r, c in zip(rb, wa @ link, strict=True) if c]
        return pd.DataFrame(counts + [(p, q, 0) for p, q in zip(nodes, tops, strict=True)], columns=["a", "b", "n"])

    found = stored(tasks.groupBy(*cell, "x", "y").applyInPandas(join, "a long, b long, n long"), "links")
    links = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("linked"))
    parts = components(found.where("a <> b").select("a", "b"))
    named = (
        reps.join(links, "rep", "left")
        .join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "label", "v",
            (F.coalesce("linked", F.lit(0)) + F.col("w") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    out = good.select("id", "label", "v").join(named, ["label", "v"]).select("id", "n_links", "component_id")
    out = out.unionByName(rows.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
