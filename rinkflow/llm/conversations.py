"""Prefix tree of conversations by Spark SQL's ROLLUP over positional columns.

A turn is its digest (128 bits of SHA-256 over role and text). A conversation lies in rows of ``width`` positional columns, one row
a block of turns; ROLLUP over the columns of a row aggregates all prefixes that end in it at once, and grouping_id tells which. A
long conversation goes on in further blocks. These are keyed by the node that the blocks before lead to (two sums over the hashes
of those blocks, 64 bits each), so all blocks of all conversations are rolled up together and no level waits for another.

What a node needs from the nodes below it is summed over its members instead. Every node is represented by its smallest member, and
a conversation represents the last nodes of its own path, from some depth on. So a first rollup finds the representatives, and a
second one sums, by the level of the node, what its members represent below it: children, childless nodes, saved tokens.

Keys that many conversations share (the root, a common opening) are combined before the shuffle; the parents with most children,
at most ``heavy`` of them, are broadcast to the nodes that look for their parent. A conversation of very many turns is numbered in
segments. Ids of members that end at a node are joined in blocks of 65,536 ids and hashed in a stream.

Rows with a null conversation belong to none and are left out; null roles and texts are empty; null turns come first, rows of the
same turn by their digest, and repeated rows are turns of their own. A table without rows has no nodes. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rinkflow.llm.batches import WORD, stored
from rinkflow.operators.sequences import running
from rinkflow.operators.skew import HOT, SEGMENT, measure_groups
from rinkflow.operators.sizing import join_dim, settle

FIRST = -(1 << 63)
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered(turns: DataFrame) -> DataFrame:
    """Add ``pos``, from 1, in the order of (at, tid) within c. Conversations above the session's limit of rows are cut in segments."""
    groups = measure_groups(turns, ["c"], "at")
    if not groups.hot:
        return turns.withColumn("pos", F.row_number().over(W.partitionBy("c").orderBy("at", "tid")).cast("long"))
    parts = groups.segmented(turns)
    parts = parts.withColumn("pos", F.row_number().over(W.partitionBy("c", SEGMENT).orderBy("at", "tid")).cast("long"))
    before = W.partitionBy("c").orderBy(SEGMENT).rowsBetween(W.unboundedPreceding, -1)
    sizes = parts.where(HOT).groupBy("c", SEGMENT).agg(F.count("*").alias("__n"))
    moved = join_dim(parts, settle(sizes.select("c", SEGMENT, F.sum("__n").over(before).alias("__before"))), ["c", SEGMENT])
    return moved.withColumn("pos", F.col("pos") + F.coalesce("__before", F.lit(0))).select(*turns.columns, "pos")


def turn_rows(base: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, at, tid, words) of every turn."""
    r, x = (F.coalesce(F.col(n).cast("string"), F.lit("")) for n in (role, text))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, x), 256)), 1, 16)
    return base.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("c"),
        F.coalesce(F.col(turn).cast("long"), F.lit(FIRST)).alias("at"),
        digest.alias("tid"),
        F.regexp_count(x, F.lit(WORD)).cast("long").alias("words"),
    )


def branched(turns: DataFrame, family: int = 20, shared: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the first of their family, and the length of each: (c, pos, tid, words) and (c, len).

    Conversation c takes the first h turns of c - c % ``family``, h = crc32(c) % ``shared``, then its own turns after its first h.
    """
    convs = turns.groupBy("c").agg(F.max("pos").alias("n"))
    convs = convs.withColumns({"first": F.col("c") - F.col("c") % family, "h": F.crc32(F.col("c").cast("string")) % shared})
    # At most shared - 1 turns of each first conversation, which has at most 2 * family - 1 followers.
    heads = turns.where(F.col("pos") < shared).groupBy(F.col("c").alias("first")).agg(F.sort_array(F.collect_list(F.struct("pos", "tid", "words"))).alias("head"))
    convs = convs.join(heads, "first", "left").withColumn("head", F.filter("head", lambda t: t["pos"] <= F.col("h")))
    convs = stored(convs.withColumn("k", F.coalesce(F.size("head"), F.lit(0)).cast("long")).drop("first"), "families")
    taken = convs.select("c", F.explode("head").alias("t")).select("c", "t.pos", "t.tid", "t.words")
    own = turns.join(convs.select("c", "h", "k"), "c").where("pos > h").select("c", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "tid", "words")
    return taken.unionByName(own), convs.select("c", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))


def _ids(depth: Column, a: Column, b: Column, level: Column, width: int) -> list[Column]:
    """The 128 bits that name the node of this level in a row of positional columns."""
    ends = _after(a, b, width)
    out = []
    for salt in (0, 1):
        inner = F.xxhash64(F.lit(salt), depth, a, b, *[F.when(level >= i, F.col(f"t{i}")) for i in range(1, width)])
        out.append(F.when(level == width, F.xxhash64(F.lit(salt), depth, *ends)).otherwise(inner))
    return out


def _after(a: Column, b: Column, width: int) -> tuple[Column, Column]:
    """The key of the blocks after a full row: the sums with this row's hashes."""
    own = _hashes(width)
    return (a + own[0]).cast("decimal(38,0)"), (b + own[1]).cast("decimal(38,0)")


def _hashes(width: int) -> list[Column]:
    return [F.xxhash64(F.lit(salt), F.col("block"), *[F.col(f"t{i}") for i in range(1, width + 1)]).cast("decimal(20,0)") for salt in (2, 3)]


def blocks_of(turns: DataFrame, lengths: DataFrame, width: int) -> DataFrame:
    """(c, block, t1.., w1.., a, b, len): a row for every ``width`` turns, with the key of the node before it; one row without turns."""
    at = {"block": F.floor((F.col("pos") - 1) / width).cast("long"), "slot": F.col("pos") - 1}
    placed = turns.withColumns(at).withColumn("slot", F.pmod("slot", F.lit(width)) + 1)
    named = [F.max(F.when(F.col("slot") == i, F.col(c))).alias(f"{n}{i}") for n, c in (("t", "tid"), ("w", "words")) for i in range(1, width + 1)]
    rows = placed.groupBy("c", "block").agg(*named)
    rows = stored(rows.join(lengths, "c", "right").withColumn("block", F.coalesce("block", F.lit(0).cast("long"))), "blocks")
    one, two = _hashes(width)
    keyed = running(rows, ["c"], "block", {"a": (one, "sum", False), "b": (two, "sum", False)})
    return keyed.withColumns({k: F.col(k).cast("decimal(38,0)") for k in ("a", "b")})


def rolled(rows: DataFrame, width: int, measures: dict[str, str], by_level: dict[str, str]) -> DataFrame:
    """One row per node: ``measures`` aggregate its members; ``by_level`` names columns <name>0.. of which each level sums its own."""
    columns = ", ".join(f"t{i}" for i in range(1, width + 1))
    level = f"{width} - bit_count(grouping_id())"
    own = [f"{sql} AS {name}" for name, sql in measures.items()]
    own += [f"array({', '.join(f'sum({c}{i})' for i in range(width + 1))})[{level}] AS {name}" for name, c in by_level.items()]
    out = rows.sparkSession.sql(
        f"SELECT block, a, b, {columns}, {level} AS level, {', '.join(own)} FROM {{rows}} GROUP BY block, a, b, ROLLUP({columns})", rows=rows
    )
    # A prefix counts where its last turn is there; the root stands in the first block alone, the others have it as their last level.
    last = F.coalesce(*[F.when(F.col("level") == i, F.col(f"t{i}").isNotNull()) for i in range(1, width + 1)], F.col("block") == 0)
    return out.where(last).withColumn("depth", F.col("block") * width + F.col("level"))


def end_hashes(ends: DataFrame) -> DataFrame:
    """(id1, id2, ends_sha256): the hash of all ids of a node in ascending order, joined by commas."""
    lots = ends.groupBy("id1", "id2", F.shiftright("c", 16).alias("lot")).agg(F.array_sort(F.collect_list("c")).alias("ids"))
    lots = lots.select("id1", "id2", "lot", F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for one, two, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if (one, two) != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (one, two), hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield _hash_rows(done)
        if node is not None:
            yield _hash_rows([(*node, state.hexdigest())])

    return lots.repartition("id1", "id2").sortWithinPartitions("id1", "id2", "lot").mapInArrow(run, "id1 long, id2 long, ends_sha256 string")


def _hash_rows(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id1", "id2", "ends_sha256"])


def parents(nodes: DataFrame, heavy: int) -> DataFrame:
    """(id1, id2, parent_conv_id) of the nodes whose parent has another representative.

    Nodes with many children are at most ``heavy``, since every node is the child of one; they are broadcast, the others shuffled.
    """
    limit = max(1000, nodes.count() // heavy)
    known = nodes.select(F.col("id1").alias("up1"), F.col("id2").alias("up2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    large = F.broadcast(known.where(F.col("n_children") > limit).drop("n_children"))
    small = known.where(F.col("n_children").between(1, limit)).drop("n_children")
    asking = nodes.where((F.col("branches") > 0) & (F.col("depth") > 0)).select("id1", "id2", "up1", "up2")
    tried = asking.join(large, ["up1", "up2"], "left")
    rest = tried.where("parent_conv_id IS NULL").drop("parent_conv_id").join(small, ["up1", "up2"])
    columns = ["id1", "id2", "parent_conv_id"]
    return tried.where("parent_conv_id IS NOT NULL").select(*columns).unionAll(rest.select(*columns))


def prefix_tree(
    base: DataFrame, width: int = 8, heavy: int = 50_000, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    rebuild=branched,
) -> DataFrame:
    """One row per node of the tree of all conversations.

    node and parent (hexadecimal names), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    ``rebuild`` turns (c, pos, tid, words) into the conversations that the tree is of, and the length of each.
    """
    turns, lengths = rebuild(stored(numbered(turn_rows(base, conv, turn, role, text)), "turns"))
    rows = stored(blocks_of(turns, lengths, width), "rows")
    levels = range(1, width + 1)
    block, depth = F.col("block"), F.col("depth")

    # First rollup: the members and the smallest of them. A node's row then belongs to the block row of that conversation.
    found = rolled(rows, width, {"conv_id": "min(c)", "n_convs": "count(*)", "longest": "max(len)"}, {})
    found = stored(found.select("block", "level", "depth", "conv_id", "n_convs", "longest"), "members")
    first = found.groupBy(F.col("conv_id").alias("c")).agg(
        F.min("depth").alias("since"), F.max((F.col("longest") == depth).cast("long")).alias("leaf")
    )
    sizes = found.where("depth > 0").groupBy(F.col("conv_id").alias("c"), "block").agg(*[F.max(F.when(F.col("level") == i, F.col("n_convs"))).alias(f"n{i}") for i in levels])
    own = rows.join(first, "c", "left").join(sizes, ["c", "block"], "left")
    saved = [F.coalesce((F.col(f"n{i}") - 1) * F.col(f"w{i}"), F.lit(0).cast("long")) for i in levels]
    own = own.withColumns({f"v{i}": v for i, v in zip(levels, saved, strict=True)}).withColumn("back", -block)
    later = running(own, ["c"], "back", {"later": (sum((F.col(f"v{i}") for i in levels), F.lit(0).cast("long")), "sum", False)})

    def below(i: int) -> Column:
        return sum((F.col(f"v{j}") for j in levels if j >= i), F.col("later"))

    def represents(d: Column) -> Column:
        return F.coalesce(((F.col("since") <= d) & (d <= F.col("len"))).cast("long"), F.lit(0).cast("long"))

    at = {i: block * width + i for i in range(width + 1)}
    by_level = {f"s{i}": below(i) for i in at} | {f"k{i}": represents(d + 1) for i, d in at.items()}
    by_level |= {f"f{i}": F.coalesce((F.col("since") == d).cast("long"), F.lit(0).cast("long")) for i, d in at.items()}
    measured = later.withColumns(by_level | {"leaf": F.coalesce("leaf", F.lit(0).cast("long"))})

    # Second rollup: the same nodes, with the sums over what their members represent.
    wanted = {"conv_id": "min(c)", "n_convs": "count(*)", "n_leaves": "sum(leaf)"}
    nodes = rolled(measured, width, wanted, {"saved_tokens": "s", "n_children": "k", "branches": "f"})
    a, b, level = F.col("a"), F.col("b"), F.col("level")
    one, two = _ids(depth, a, b, level, width)
    up1, up2 = _ids(depth - 1, a, b, level - 1, width)
    named = nodes.select(
        one.alias("id1"), two.alias("id2"), F.when(depth > 0, up1).alias("up1"), F.when(depth > 0, up2).alias("up2"),
        "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "branches",
    )
    named = stored(named, "nodes")

    size = F.col("len") - block * width
    last = rows.where((size.between(1, width)) | ((F.col("len") == 0) & (block == 0)))
    one, two = _ids(F.col("len"), a, b, size, width)
    ends = end_hashes(last.select(one.alias("id1"), two.alias("id2"), "c"))
    out = named.join(parents(named, heavy), ["id1", "id2"], "left").join(ends, ["id1", "id2"], "left")
    up = F.when(depth == 0, F.lit(None)).otherwise(F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id")

    def name(x: str, y: str) -> Column:
        return F.lower(F.concat(F.lpad(F.hex(x), 16, "0"), F.lpad(F.hex(y), 16, "0")))

    return out.select(
        name("id1", "id2").alias("node"), name("up1", "up2").alias("parent"), "conv_id", "depth", up, "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
