"""N-gram Jaccard join over prefix trees.

A text is the set of its distinct word shingles in one global order: shingles that are frequent come last, most frequent at the
very end, all others by hash. Sets with Jaccard similarity of at least t share a shingle among the first n - ceil(t * n) + 1
of each, so only sets that meet in such a shingle are compared. For the comparison the ordered sets of a block form a prefix tree
(sorted, common beginnings stored once). It is traversed with all sets that are compared with the block at once: a node holds the
overlaps of its prefix with each of them, which all sets below it share, and a subtree is left as soon as what remains of its
longest set cannot reach the overlap that its smallest one needs.

Equal sets are one from the start, and components need few of the links. Every shingle's group has a leader, in large groups the
set that meets most others. Sets that share a good part of their beginnings with a leader are connected, not compared: these are
families. A family is cut into blocks by bytes, and every pair of blocks is a task that gets its sets once, and the set that
leads most of the family. The task compares all sets with this one first; only sets that are not joined with it by then are
compared with the others. It returns a spanning forest of what it joins, never pairs. Last, sets of different families that meet
in enough shingles and pass the bounds on sizes and positions (a longer prefix filter) are compared, a set with a block of its
partners. So every pair of sets of different components that meets often enough is compared in one of the two ways, and no link
between components is left out.

``frequent`` (at most so many entries, from counts over all documents) only changes the order, never the result. Null texts and
texts without words have the empty set and are components of their own; rows with a null id link with nothing and have no
component; rows that repeat an id or a text, and further columns, change nothing, and texts of one id are documents each. Empty
tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinkflow.llm.batches import by_bytes, components, stored, text_or_empty
from rinkflow.llm.shingles import distinct_pairs, ordered, shingle_hashes

#: A shingle counts as possibly frequent where so many texts of one partition have it.
OFTEN = 2
#: Hashes (of 63 bits) below this are counted.
EARLY = np.uint64(1 << 62)
#: Most tasks of a set that lie in one row.
PARCEL = 1000
#: Groups of a shingle with so many rows are led by a set that meets many others.
BUSY = 8


class Order:
    """The global order: hashes of the frequent shingles and their ranks."""

    def __init__(self, hashes: np.ndarray):
        at = np.argsort(hashes)
        self.hashes, self.ranks = hashes[at], at.astype(np.uint64)

    def sets(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        value, owner = shingle_hashes(texts)
        return distinct_pairs(ordered(value, self.hashes, self.ranks), owner, len(texts))


class Counts:
    """Counts of the values of a partition in bounded memory: the rarest are forgotten when there are too many."""

    def __init__(self, most: int = 1 << 21):
        self.values, self.n, self.most = np.zeros(0, np.uint64), np.zeros(0, np.int64), most

    def add(self, values: np.ndarray) -> None:
        fresh, times = np.unique(values, return_counts=True)
        at = np.searchsorted(self.values, fresh)
        known = np.zeros(len(fresh), bool)
        inside = at < len(self.values)
        known[inside] = self.values[at[inside]] == fresh[inside]
        self.n[at[known]] += times[known]
        self.values, self.n = np.insert(self.values, at[~known], fresh[~known]), np.insert(self.n, at[~known], times[~known])
        floor = 2
        while len(self.values) > self.most:
            kept = self.n >= floor
            self.values, self.n, floor = self.values[kept], self.n[kept], floor + 1


def frequent_shingles(docs: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` shingles by the number of different sets that have them, from counts of every partition, the rarer first.

    Only the lower half of the hashes is counted: sets begin with their lowest hashes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in by_bytes(batches, "text"):
            codes, offsets = distinct_pairs(*shingle_hashes(batch.column(0)), batch.num_rows)
            # Equal sets count once, and only the codes that may begin a set.
            digests = [digest(codes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            once = np.zeros(batch.num_rows, bool)
            once[np.unique(np.array(digests, np.int64), return_index=True)[1]] = True
            counts.add(codes[np.repeat(once, np.diff(offsets)) & (codes < EARLY)])
        often = counts.n >= OFTEN
        yield pa.RecordBatch.from_arrays([pa.array(counts.values[often].view(np.int64)), pa.array(counts.n[often])], ["h", "n"])

    counts = docs.select(text_or_empty().alias("text")).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counts.where("n > 3").orderBy(F.desc("n"), "h").limit(most).toArrow()
    return np.asarray(top["h"].to_numpy(), np.int64)[::-1].view(np.uint64).copy()


def text_sets(docs: DataFrame, order: Order) -> DataFrame:
    """(id, s, n) of every row: the digest of its set, which stands for the set, and the set's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            codes, offsets = order.sets(batch.column(1))
            digests = [digest(codes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.int64()), pa.array(np.diff(offsets))], ["id", "s", "n"])

    return docs.mapInArrow(run, "id long, s long, n long")


def prefixes(docs: DataFrame, order: Order, share: tuple[int, int]) -> DataFrame:
    """(h, s, at): the shingles by which a set is found; ``at`` holds the set's size and, in its lower half, the position.

    Sets that come again in a batch are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            codes, offsets = order.sets(batch.column(1))
            n = np.diff(offsets)
            digests = np.array([digest(codes[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)
            once = np.zeros(len(n), bool)
            once[np.unique(digests, return_index=True)[1]] = True
            length = np.where((n > 0) & once, n - -(-n * share[0] // share[1]) + 1, 0)
            place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            h = codes[np.repeat(offsets[:-1], length) + place].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(np.repeat(digests, length)), pa.array(np.repeat(n << 32, length) | place)], ["h", "s", "at"]
            )

    return docs.where("id is not null").mapInArrow(run, "h long, s long, at long")


def digest(codes: np.ndarray) -> int:
    """64 bits: among n sets, two different ones share it with a chance of n * n / 2 ** 65."""
    return int.from_bytes(hashlib.blake2b(codes.tobytes(), digest_size=8).digest(), "little", signed=True)


class Overlaps:
    """The sets that a prefix tree is compared with, as lists of the sets that have each code."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        codes = np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(codes, kind="stable")
        self.owner, codes = owner[order], codes[order]
        self.codes, self.starts = np.unique(codes, return_index=True)
        self.ends = np.concatenate([self.starts[1:], [len(codes)]]) if len(codes) else self.starts

    def known(self, codes: np.ndarray, least: int) -> np.ndarray:
        """Places of those codes that at least ``least`` of the sets have."""
        if not len(self.codes):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        at = at[self.codes[at] == codes]
        return at[self.ends[at] - self.starts[at] >= least]

    def of(self, places: np.ndarray) -> np.ndarray:
        """How many of the places each set has."""
        if not len(places):
            return np.zeros(len(self.sizes), np.int64)
        return np.bincount(np.concatenate([self.owner[self.starts[p] : self.ends[p]] for p in places.tolist()]), minlength=len(self.sizes))


def tree_links(probes: list[np.ndarray], sets: list[np.ndarray], share: tuple[int, int], least: int = 1) -> Iterator[tuple[int, np.ndarray]]:
    """For each of the ordered ``sets`` that any of the ``probes`` is similar to: its number and theirs, by one traversal of their prefix tree.

    Codes that fewer than ``least`` of the probes have are left out of the tree (2 where the sets are among the probes: a code that
    no other set has adds to no overlap but a set's with itself).
    """
    up, down = share
    against = Overlaps(probes)
    paths = [against.known(s, least) for s in sets]
    order = sorted(range(len(sets)), key=lambda i: paths[i].astype(">i8").tobytes())
    paths = [paths[i] for i in order]
    long = np.array([len(p) for p in paths], np.int64)
    need = np.array([-(-len(sets[i]) * up // down) for i in order], np.int64)

    def leaf(k: int, overlap: np.ndarray):
        size = len(sets[order[k]])
        return order[k], np.flatnonzero(overlap * (up + down) >= up * (against.sizes + size))

    stack = [(0, len(paths), 0, np.zeros(len(probes), np.int64))] if probes and sets else []
    while stack:
        lo, hi, depth, overlap = stack.pop()
        if overlap.max() + long[lo:hi].max() - depth < need[lo:hi].min():
            continue
        if hi - lo == 1:
            yield leaf(lo, overlap + against.of(paths[lo][depth:]))
            continue
        # What all paths of the subtree have in common is that of the first and the last one.
        common = min(long[lo], long[hi - 1])
        differ = np.flatnonzero(paths[lo][depth:common] != paths[hi - 1][depth:common])
        deep = depth + int(differ[0]) if len(differ) else int(common)
        if deep > depth:
            stack.append((lo, hi, deep, overlap + against.of(paths[lo][depth:deep])))
            continue
        at = lo
        while at < hi and long[at] == depth:
            yield leaf(at, overlap)
            at += 1
        heads = np.array([p[depth] for p in paths[at:hi]])
        cuts = [at, *(at + 1 + np.flatnonzero(heads[1:] != heads[:-1])).tolist(), hi] if at < hi else []
        for left, right in zip(cuts, cuts[1:], strict=False):
            stack.append((left, right, depth, overlap))


def linked(probe: np.ndarray, sets: list[np.ndarray], share: tuple[int, int]) -> np.ndarray:
    """Which of the ordered ``sets`` have the similarity with ``probe``."""
    out = np.zeros(len(sets), bool)
    for k, hits in tree_links([probe], sets, share):
        out[k] = len(hits) > 0
    return out


def forest(left: list[np.ndarray], left_labels: np.ndarray, right: list[np.ndarray], right_labels: np.ndarray, share: tuple[int, int]) -> list[tuple[int, int]]:
    """Links between sets of ``left`` and ``right`` that join different labels, as a spanning forest of the labels."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    found = []

    def compare(probes, probe_labels, sets, set_labels, least):
        for k, hits in tree_links(probes, sets, share, least):
            own = int(set_labels[k])
            for other in np.unique(probe_labels[hits]).tolist():
                a, b = root(own), root(other)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    found.append((own, other))

    def part(sets, flags):
        return [s for s, f in zip(sets, flags.tolist(), strict=True) if f]

    # Sets of the most frequent label need no comparison among themselves.
    labels, counts = np.unique(np.concatenate([left_labels, right_labels]), return_counts=True)
    most = labels[np.argmax(counts)]
    same = left is right
    rare = right_labels != most
    compare(left, left_labels, part(right, rare), right_labels[rare], 2 if same else 1)
    if not same:
        usual = right_labels == most
        rare = left_labels != most
        compare(part(right, usual), right_labels[usual], part(left, rare), left_labels[rare], 1)
    return found


def _needed(share: tuple[int, int], n1: Column, n2: Column) -> tuple[Column, Column]:
    """The overlap that sets of these sizes need, and in how many shingles of their beginnings they must meet then.

    Sets with an overlap of o share at least k shingles among the first n - o + k of each, for every k up to what their beginnings
    hold. A larger k leaves out more pairs, a smaller one looks at less of the beginnings: k is one and a fiftieth of the smaller set.
    """
    up, down = share
    overlap = F.ceil((n1 + n2) * up / (up + down))
    most = overlap - F.ceil(F.greatest(n1, n2) * up / down) + 1
    return overlap, F.least(most, F.floor(F.least(n1, n2) / 50) + 1)


def _close(share: tuple[int, int], n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
    """Whether a shingle at these positions of sets of these sizes counts towards the needed number."""
    up, down = share
    overlap, times = _needed(share, n1, n2)
    return (F.least(n1, n2) * down >= F.greatest(n1, n2) * up) & (p1 < n1 - overlap + times) & (p2 < n2 - overlap + times)


def _likely(pairs: DataFrame, share: tuple[int, int], at1: str, at2: str) -> DataFrame:
    """Pairs (a, b, met, n1, n2) that meet in as many shingles as they need; ``pairs`` has a row for each that counts."""
    n1, n2 = F.shiftright(F.first(at1), 32), F.shiftright(F.first(at2), 32)
    met = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"), n1.alias("n1"), n2.alias("n2"))
    return met.where(F.col("met") >= _needed(share, F.col("n1"), F.col("n2"))[1])


def led_by_central(meets: DataFrame, busy: int = BUSY) -> DataFrame:
    """(h, s, at, lead, lead_at) of ``meets``: groups of at least ``busy`` rows are led by their set that meets most rows in such groups.

    Among near copies this is one that most of their groups have, so that it leads them together. The smallest set, say, has lost more
    of what they share than the others, so that each of its groups would have a leader of its own.
    """
    large = meets.where(F.col("k") >= busy)
    weights = large.groupBy("s").agg(F.sum("k").alias("w"))
    central = large.join(weights, "s").groupBy("h").agg(F.max(F.struct("w", "s", "at")).alias("c")).select("h", F.col("c.s").alias("lead"), F.col("c.at").alias("lead_at"))
    columns = ["h", "s", "at", "lead", "lead_at"]
    return meets.where(F.col("k") < busy).select(*columns).unionByName(large.drop("lead", "lead_at").join(central, "h").select(*columns))


def sent_sets(docs: DataFrame, reps: DataFrame, tasks: DataFrame, order: Order, small: int) -> DataFrame:
    """(x, y, side, s, set): the set of every task (s, x, y, side), from the document that stands for it.

    Documents are read once; a set's tasks travel to its document in lists of at most ``PARCEL``.
    """
    sizes = tasks.groupBy("s").agg(F.ceil(F.count("*") / PARCEL).alias("parcels"))
    dealt = tasks.join(sizes.where("parcels > 1"), "s", "left").withColumn("parcel", F.pmod(F.xxhash64("x", "y"), F.coalesce("parcels", F.lit(1))))
    lists = dealt.groupBy("s", "parcel").agg(F.collect_list(F.struct("x", "y", "side")).alias("tasks"))
    wanted = stored(lists.join(reps, "s").select("s", "id", "tasks"), "wanted")
    # Within a checked number of tasks (of 32 bytes or so) they travel to the texts; beyond it both are shuffled.
    few = wanted.agg(F.coalesce(F.sum(F.size("tasks") + 1), F.lit(0))).first()[0] <= small
    texts = docs.join(F.broadcast(wanted) if few else wanted, "id").select("s", "tasks", "text")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 1 << 20):
            codes, offsets = order.sets(batch.column(2))
            for k, (s, tasks) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                own = codes[offsets[k] : offsets[k + 1]]
                if digest(own) != s:
                    continue  # another text of the same id
                data = own.tobytes()
                step = max(1, (1 << 24) // max(len(data), 1))
                for at in range(0, len(tasks), step):
                    some = tasks[at : at + step]
                    columns = [pa.array([t[c] for t in some], k) for c, k in (("x", pa.int64()), ("y", pa.int64()), ("side", pa.int32()))]
                    columns += [pa.array([s] * len(some), pa.int64()), pa.array([data] * len(some), pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["x", "y", "side", "s", "set"])

    return texts.mapInArrow(send, "x long, y long, side int, s long, set binary")


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in table["set"].to_pylist()]


def verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, order: Order, share: tuple[int, int], block: int, small: int) -> DataFrame:
    """Those of ``pairs`` (a, b, n2) of sets that have the similarity; the partners of a set come in blocks of about ``block`` bytes."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.sum("n2") * 8 / block).alias("cuts"))
    partners = pairs.join(sizes, "a").select(F.col("b").alias("s"), F.col("a").alias("x"), F.pmod(F.xxhash64("b"), F.col("cuts")).alias("y"), F.lit(1).alias("side"))
    own = sizes.select(F.col("a").alias("s"), F.col("a").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias("y"), F.lit(0).alias("side"))
    tasks = partners.unionAll(own)

    def compare(table: pa.Table) -> pa.Table:
        own = table["side"].to_numpy() == 0
        sets, b = _sets(table), table["s"].to_numpy()[~own]
        if own.any():
            b = b[linked(sets[int(np.argmax(own))], [x for x, o in zip(sets, own.tolist(), strict=True) if not o], share)]
        return pa.table({"a": pa.array(np.full(len(b), table["x"][0].as_py()), pa.int64()), "b": pa.array(b, pa.int64())})

    return sent_sets(docs, reps, tasks, order, small).groupBy("x", "y").applyInArrow(compare, "a long, b long")


def family_links(docs: DataFrame, reps: DataFrame, members: DataFrame, order: Order, share: tuple[int, int], block: int, small: int) -> DataFrame:
    """(a, b): links between the sets of each family of ``members`` (f, s, n, lead), a spanning forest a task.

    A family is cut into blocks of about ``block`` bytes by hash, and each pair of blocks is a task: a set is sent once to each block,
    and the family's leader to every task.
    """
    sizes = members.groupBy("f").agg(F.ceil(F.sum("n") * 8 / block).alias("cuts"), F.max("lead").alias("lead"))
    cut = members.drop("lead").join(sizes, "f").withColumn("y", F.pmod(F.xxhash64("s"), F.col("cuts")))
    # A task is named by its family and both its blocks; side tells from which of them a set comes.
    first = F.transform(F.sequence(F.col("y"), F.col("cuts") - 1), lambda z: F.struct((F.col("y") * F.col("cuts") + z).alias("y"), F.lit(0).alias("side")))
    earlier = F.filter(F.sequence(F.lit(0).cast("long"), F.col("y")), lambda z: z < F.col("y"))
    second = F.transform(earlier, lambda z: F.struct((z * F.col("cuts") + F.col("y")).alias("y"), F.lit(1).alias("side")))
    tasks = cut.select("s", F.col("f").alias("x"), F.explode(F.concat(first, second)).alias("t")).select("s", "x", "t.y", "t.side")
    led = tasks.select("x", "y").distinct().join(sizes.select(F.col("f").alias("x"), F.col("lead").alias("s")), "x").select("s", "x", "y", F.lit(2).alias("side"))

    def compare(table: pa.Table) -> pa.Table:
        side, ids, sets = table["side"].to_numpy(), table["s"].to_numpy(), _sets(table)

        def part(k: int) -> tuple[list[np.ndarray], np.ndarray]:
            return [s for s, o in zip(sets, (side == k).tolist(), strict=True) if o], ids[side == k]

        (left, a), (right, b), (head, lead) = part(0), part(1), part(2)
        found = []
        if head:
            for own in (a, b):
                met = linked(head[0], left if own is a else right, share) if len(own) else np.zeros(0, bool)
                found += [(int(lead[0]), int(s)) for s in own[met] if s != lead[0]]
                own[met] = lead[0]
        if len(b):
            found += forest(left, a, right, b, share) if left else []
        else:
            found += forest(left, a, left, a, share)
        x, y = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

    return sent_sets(docs, reps, tasks.unionByName(led), order, small).groupBy("x", "y").applyInArrow(compare, "a long, b long")


def _named(sets: DataFrame, label: DataFrame, new: str) -> DataFrame:
    """Add the component of every set: its own digest where it is in none."""
    return sets.join(label.select(F.col("node").alias("s"), "component"), "s", "left").withColumn(new, F.coalesce("component", "s")).drop("component")


def similar_texts(
    docs: DataFrame, similarity: tuple[int, int] = (4, 5), frequent: int = 1 << 19, block: int = 4 << 20, small: int = 1_000_000,
    text: str = "text", key: str = "doc_id",
) -> DataFrame:
    """(key, n_shingles, component_id) of every row; ``similarity`` is a fraction, ``block`` a number of bytes."""
    share = similarity
    rows = docs.select(F.col(key).cast("long").alias("id"), text_or_empty(text).alias("text"))
    order = Order(frequent_shingles(rows, frequent))
    sets = stored(text_sets(rows, order), "texts")
    reps = sets.where("n > 0 and id is not null").groupBy("s").agg(F.min("id").alias("id"))
    spread = prefixes(rows, order, share).repartition("h")
    groups = spread.groupBy("h").agg(F.max(F.struct("s", "at")).alias("lead"), F.min("s").alias("lo"), F.count(F.lit(1)).alias("k")).where("lo <> lead.s")
    meets = spread.join(groups.drop("lo"), "h").select("h", "s", "at", F.col("lead.s").alias("lead"), F.col("lead.at").alias("lead_at"), "k")
    meets = stored(meets, "meets")

    # First, the families: sets and leaders that share a quarter of the shorter beginning.
    n1, n2 = _size_and_place("lead_at")[0], _size_and_place("at")[0]
    star = led_by_central(meets).where("lead <> s").groupBy("lead", "s").agg(F.count(F.lit(1)).alias("met"), F.min(n1).alias("n1"), F.min(n2).alias("n2"))
    beginning = F.least(*[F.col(n) - F.ceil(F.col(n) * share[0] / share[1]) + 1 for n in ("n1", "n2")])
    star = stored(star.where(F.col("met") * 4 >= beginning).select(F.col("lead").alias("a"), F.col("s").alias("b"), "n1", "n2"), "star")
    family = stored(components(star), "families").select(F.col("node").alias("s"), F.col("component").alias("f"))
    # The set that leads most of a family leads it.
    leads = star.groupBy(F.col("a").alias("s"), F.col("n1").alias("n")).agg(F.count(F.lit(1)).alias("led"))
    members = star.select(F.col("b").alias("s"), F.col("n2").alias("n")).distinct().withColumn("led", F.lit(0).cast("long")).unionByName(leads)
    members = stored(members.groupBy("s").agg(F.max("n").alias("n"), F.max("led").alias("led")).join(family, "s"), "members")
    leaders = members.groupBy("f").agg(F.max_by("s", F.struct("led", "s")).alias("lead"))
    links = stored(family_links(rows, reps, members.join(leaders, "f").select("f", "s", "n", "lead"), order, share, block, small), "links")
    label = stored(components(links), "joined")

    # Last, pairs of different families and components that a shingle joins and no bound excludes.
    named = meets.select("h", "s", "at").join(family, "s", "left").withColumn("f", F.coalesce("f", "s"))
    mixed = named.groupBy("h").agg(F.min("f").alias("lo"), F.max("f").alias("hi")).where("lo <> hi").select("h")
    open_ = stored(named.join(mixed, "h").distinct(), "open")
    other = open_.select(*[F.col(c).alias(f"{c}2") for c in open_.columns])
    apart = (F.col("h") == F.col("h2")) & (F.col("s") < F.col("s2")) & (F.col("f") != F.col("f2"))
    more = open_.join(other, apart & _close(share, *_size_and_place("at"), *_size_and_place("at2")))
    more = _likely(more.select(F.col("s").alias("a"), F.col("s2").alias("b"), "at", "at2"), share, "at", "at2")
    more = stored(more.select("a", "b", "n2"), "more")
    if not more.isEmpty():
        rest = stored(verified(rows, reps, more, order, share, block, small), "all-links")
        if not rest.isEmpty():
            label = stored(components(links.unionAll(rest)), "final")

    classes = _named(reps, label, "c")
    least = classes.groupBy("c").agg(F.min("id").alias("component_id"))
    classes = classes.join(least, "c").select("s", "component_id")
    out = sets.join(classes, "s", "left")
    found = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), found.alias("component_id"))


def _size_and_place(name: str) -> tuple[Column, Column]:
    return F.shiftright(name, 32), F.col(name).bitwiseAND(F.lit((1 << 32) - 1))
