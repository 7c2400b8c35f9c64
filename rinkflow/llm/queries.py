"""The registered queries: each applies its operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkflow.llm.batches import WORD, table
from rinkflow.llm.conversations import prefix_tree
from rinkflow.llm.lattice import score_texts
from rinkflow.llm.metric import near_vectors
from rinkflow.llm.mixing import mix_sources
from rinkflow.llm.neighbours import nearest
from rinkflow.llm.packing import pack
from rinkflow.llm.pivots import top_products
from rinkflow.llm.prefixtree import similar_texts
from rinkflow.llm.secrets import find_secrets, span_text
from rinkflow.llm.squares import periodic_runs, repeated_tail
from rinkflow.llm.suffixes import without_repeats
from rinkflow.llm.tokens import count_tokens
from rinkflow.llm.toxicity import toxic_scores

BPE = "byte_bpe_50k.json"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document without strings of 100 bytes that came before."""
    kept = without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def count(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    counts = {"n_assign": count(0), "n_access": count(1), "n_hex": count(2)}
    return found.select(
        "doc_id", *[c.alias(n) for n, c in counts.items()], F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans")
    )


def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth id."""
    found = nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE))


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors within their label."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def fold(key: str, folds: int):
    return F.crc32(F.col(key).cast("string")) % folds


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from two thirds of the labels."""
    scored = toxic_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document, learnt from nine tenths of them.

    ``score`` is that of the lattice with the training words as further arcs; ``lattice_score`` has the vocabulary's pieces alone.
    """
    scored = score_texts(table(spark, sf_dir, "documents"), fold("doc_id", 10) != 0, public_tokenizers.path("piece_bpe_32k.model"))
    return scored.withColumnsRenamed({"score": "lattice_score", "mixed_score": "score"})


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingles are similar."""
    return similar_texts(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document so that sources meet their targets."""
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "times", "source")


def op11_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of every hundredth id."""
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, and its text without their repeats."""
    found = periodic_runs(table(spark, sf_dir, "documents"), rebuild=repeated_tail)
    # Runs are ordered by start, then period: the first of equal exponents stays.
    longer = F.reduce(
        "runs",
        F.get("runs", F.lit(0)),
        lambda a, b: F.when(b["length"].cast("decimal(19,0)") * a["period"] > a["length"].cast("decimal(19,0)") * b["period"], b).otherwise(a),
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("top", longer).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.expr("top.length * 1000 div top.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix tree of all conversations."""
    nodes = prefix_tree(table(spark, sf_dir, "conversations"))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Links and components of vectors: all pairs of a label, and everything that links reach.
VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
r AS (SELECT vec_id AS n, vec_id AS m FROM embeddings UNION SELECT r.n, l.b FROM r JOIN l ON r.m = l.a),
c AS (SELECT n, min(m) AS component_id FROM r GROUP BY n),
k AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON n = vec_id LEFT JOIN k ON a = vec_id"""

#: Sets of shingles, their overlaps by a join on equal shingles, and everything that links reach.
NGRAMS_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS h FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT r.d, l.b FROM r JOIN l ON r.m = l.a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id
FROM (SELECT d AS doc_id, min(m) AS component_id FROM r GROUP BY d) LEFT JOIN n USING (doc_id)"""


#: All products of the queries with all other rows, in whole numbers that doubles hold.
PRODUCTS_SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""

#: Conversations as lists of turns, nodes as their prefixes, and every node summed into all its ancestors.
PREFIX_TREE_SQL = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT c, length(r)::VARCHAR || ':' || r || x AS k, len(regexp_extract_all(x, '[^ 	-
]+')) AS w,
    row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, substr(sha256(length(r)::VARCHAR || ':' || r || x), 1, 32)) AS i FROM t),
h AS (
  SELECT c, c - c % 20 AS f, xor(list_reduce(list_prepend(4294967295::BIGINT, [ord(y)::BIGINT FOR y IN string_split(c::VARCHAR, '')]),
    lambda s, b: list_reduce(list_prepend(xor(s, b), [z FOR z IN range(8)]), lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM o)),
p AS (
  SELECT h.c, o.i AS i, o.k, o.w FROM h JOIN o ON o.c = h.f AND o.i <= h.h
  UNION ALL SELECT h.c, h.h + o.i AS i, o.k, o.w FROM h JOIN o ON o.c = h.c AND o.i > h.h),
b AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS d, k, w FROM p),
l AS (SELECT h.c, count(b.d) AS len FROM h LEFT JOIN b ON b.c = h.c GROUP BY h.c),
q AS (
  SELECT c, d, w, string_agg(sha256(k), '') OVER (PARTITION BY c ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path FROM b
  UNION ALL SELECT c, 0 AS d, 0 AS w, '' AS path FROM h),
m AS (SELECT q.c, q.d, q.w, l.len, min(q.c) OVER (PARTITION BY q.path) AS node FROM q JOIN l ON l.c = q.c),
n AS (
  SELECT node, d, count(*) AS n_convs, max(w) AS w, max(len) = d AS leaf,
    coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len = d), '') AS ends FROM m GROUP BY node, d),
u AS (SELECT n.node, n.d, a.node AS parent FROM n LEFT JOIN m a ON a.c = n.node AND a.d = n.d - 1),
k AS (SELECT parent, d - 1 AS d, count(*) AS n_children FROM u WHERE d > 0 GROUP BY parent, d - 1),
s AS (
  SELECT m.node, m.d, sum((n.n_convs - 1) * n.w) AS saved, count(*) FILTER (WHERE n.leaf) AS leaves
  FROM n JOIN m ON m.c = n.node AND m.d <= n.d GROUP BY m.node, m.d)
SELECT n.node AS conv_id, CAST(n.d AS BIGINT) AS depth, u.parent AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
  s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN u ON u.node = n.node AND u.d = n.d JOIN s ON s.node = n.node AND s.d = n.d LEFT JOIN k ON k.parent = n.node AND k.d = n.d"""


def oracles() -> dict[str, str]:
    """SQL of those queries that SQL can express on whole tables."""
    return {
        "op6_vector_dedup": VECTORS_SQL, "op9_ngram_join": NGRAMS_SQL, "op11_top_products": PRODUCTS_SQL, "op13_prefix_tree": PREFIX_TREE_SQL,
    }
