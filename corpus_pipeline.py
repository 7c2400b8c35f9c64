"""From raw documents to packed training sequences, in five stages that each write what they keep.

Every stage works on all rows that the one before kept, and its decisions take effect: toxic documents go, one document of each
group of similar ones stays, secrets are masked in the text, documents are dropped or repeated as the mix asks, and what is left
is packed. All stages but the last return the columns of documents. Null texts are kept as empty documents are.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkflow.llm.batches import chosen_rows, stored, table
from rinkflow.llm.mixing import mix_sources
from rinkflow.llm.packing import pack
from rinkflow.llm.prefixtree import similar_texts
from rinkflow.llm.secrets import find_secrets, redact
from rinkflow.llm.toxicity import toxic_scores
from rinkflow.session import fresh_path, scratch

#: Documents with at least this score go.
TOXIC = 0.7
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _guarded(stage):
    """The stage on columns of which only those of documents keep their names, so that no further column's name can clash."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        plain = [c if c in COLUMNS else f"__extra{i}" for i, c in enumerate(names)]
        return stage(spark, docs.toDF(*plain), sf_dir).select(*plain).toDF(*names)

    return run_stage


@_guarded
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-channel scorer doesn't reject."""
    train = F.crc32(F.col("doc_id").cast("string")) % 3 != 1
    scored = toxic_scores(docs, table(spark, sf_dir, "labels"), train, carry=tuple(docs.columns))
    return scored.where(F.col("score") < TOXIC).select(*docs.columns)


@_guarded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the one with the smallest id.

    Rows are compared, not ids: rows that repeat an id with different texts are documents each. Of rows with one id and similar
    texts the first one stays, a row without an id only where its group has none with one. Rows without words are never similar.
    """
    numbered = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    classes = similar_texts(numbered, key="__row").select("__row", "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    chosen = numbered.select("__row", "doc_id").join(classes, "__row").groupBy("component_id").agg(F.min(order).alias("m")).select("m.__row", F.lit(1).alias("times"))
    return chosen_rows(numbered, chosen, "__row").select(*docs.columns)


@_guarded
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked."""
    found = find_secrets(docs, carry=tuple(docs.columns))
    masked = found.withColumn("text", redact(F.col("text"), F.col("spans")))
    return masked.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


@_guarded
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    # A number for each row, so that rows that repeat an id are decided one by one.
    numbered = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    taken = mix_sources(numbered, key="__row").where("times > 0").select("__row", "times")
    return chosen_rows(numbered, taken, "__row").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scans", secrets),
    ("mixing", mixing),
    ("packing", packing),
]

#: Trained models, components and encodings can't be expressed in SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again, and what it wrote on its way is deleted then."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name)
        with scratch(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
