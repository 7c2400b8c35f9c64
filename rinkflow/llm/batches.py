"""Helpers that every operator of this package shares: reading, Arrow batches of bounded size, word hashes, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkflow.session import cut_lineage, fresh_path

#: Words are runs of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read by Spark from whatever store the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: computed once, and no executor's loss undoes it."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chosen_rows(numbered: DataFrame, chosen: DataFrame, number: str, small: int = 1_000_000) -> DataFrame:
    """The rows of ``numbered`` as often as ``chosen`` (number, times) says; numbers that it does not hold are left out.

    The numbers travel as bits, 64 to a row, and texts stay where they are. Beyond ``small`` rows of bits both sides are shuffled.
    """
    copies = chosen.select(F.col(number).alias("__number"), F.explode(F.sequence(F.lit(1), F.col("times"))).alias("__copy"))
    place = F.col("__number").bitwiseAND(F.lit(63)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place)
    words = copies.groupBy(F.shiftright("__number", 6).alias("__word"), "__copy").agg(F.bit_or(bit).alias("__bits"))
    words = stored(words, "chosen")
    rows = numbered.withColumns({"__number": F.col(number), "__word": F.shiftright(number, 6)})
    found = rows.join(F.broadcast(words) if words.count() <= small else words, "__word").where(F.getbit("__bits", place) == 1)
    return found.select(*numbered.columns)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the strings of ``column`` hold about ``limit`` bytes each; a single longer row stays whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(string_bytes(batch.column(batch.schema.get_field_index(column))))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def string_bytes(values: pa.Array) -> np.ndarray:
    """UTF-8 bytes per row; null counts 0."""
    sizes = pc.binary_length(values.cast(pa.large_string()))
    return pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def strings(values: pa.Array) -> list:
    """Python strings of a column; much quicker than to_pylist."""
    return values.to_numpy(zero_copy_only=False).tolist()


def flat_bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column without nulls, end to end, and the offsets of its rows."""
    wide = values.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (the finisher of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (node, component) per node, component its smallest node.

    Every round first contracts the edges of each partition to stars of that partition (a partition is any set of
    edges, so none is larger than its input), then moves every edge to the smallest neighbours of its ends and
    to the smallest label known. Rounds end when no label changes. Each round is written to the shared folder.
    """
    cast = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    stars = cut_lineage(_contract(cast))
    for _ in range(rounds):
        # stars: (a, b) with b the smaller end. Point every neighbour of a node at the node's smallest neighbour.
        both = stars.select("a", "b").unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        following = moved.unionAll(least.where("a <> m").select("a", F.col("m").alias("b")))
        following = cut_lineage(_contract(following))
        # Done when the stars are flat: no parent is itself a child, and no child has two parents.
        parents = following.select(F.col("b").alias("a")).distinct()
        flat = following.join(parents, "a", "left_semi").isEmpty() and following.groupBy("a").count().where("count > 1").isEmpty()
        stars = following
        if flat:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _contract(edges: DataFrame) -> DataFrame:
    """Distinct edges (a, b), b < a, after union-find inside each partition."""
    return (
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
        .mapInArrow(_local_stars, "a long, b long")
        .distinct()
    )


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = 1 << 17
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            nodes, parents = union_find(part.column(0).to_pylist(), part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(parents, pa.int64())], ["a", "b"])


def union_find(left: list, right: list) -> tuple[list, list]:
    """Nodes other than their group's smallest one, and that smallest one."""
    parent: dict = {}

    def root(x):
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    for a, b in zip(left, right, strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    tops = [root(x) for x in nodes]
    kept = [(n, t) for n, t in zip(nodes, tops, strict=True) if n != t]
    return [n for n, _ in kept], [t for _, t in kept]
