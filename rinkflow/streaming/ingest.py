"""Resumable ingestion of landed documents."""

from __future__ import annotations

import json
import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkflow.sources.datasets import write_dataset
from rinkflow.sources.documents import flatten_pbp, parse_documents, split_bad


def pending(ids: DataFrame, status: DataFrame, key: str = "game_id", max_n: int | None = None) -> DataFrame:
    """Ids that are not complete yet, in order, at most ``max_n`` per run."""
    done = status.filter(F.col("completed")).select(key)
    left = ids.select(key).distinct().join(done, key, "left_anti").orderBy(key)
    return left if max_n is None else left.limit(max_n)


def status_latest(log: DataFrame, keys: tuple[str, ...] = ("data_type", "game_id"), order: str = "seq") -> DataFrame:
    """State of every id: completion is never revoked, and a failure counts until a later completion.

    The season is part of the key where the log has one.
    """
    if "season" in log.columns and "season" not in keys:
        keys = ("season", *keys)
    done = F.max(F.when(F.col("state") == "complete", F.col(order)))
    failed = F.max(F.when(F.col("state") == "failed", F.col(order)))
    message = F.max_by("message", F.when(F.col("state") == "failed", F.col(order)))
    sums = log.groupBy(*keys).agg(done.alias("__done"), failed.alias("__failed"), message.alias("message"))
    still = F.col("__failed").isNotNull() & (F.col("__done").isNull() | (F.col("__failed") > F.col("__done")))
    return sums.select(
        *keys,
        F.col("__done").isNotNull().alias("completed"),
        still.alias("failed"),
        F.when(still, F.col("message")).alias("message"),
    )


def status_counts(status: DataFrame, by: tuple[str, ...] = ("data_type",)) -> DataFrame:
    """Completed, failed and all ids."""
    return status.groupBy(*by).agg(
        F.count_if("completed").alias("n_completed"), F.count_if("failed").alias("n_failed"), F.count(F.lit(1)).alias("n_total")
    )


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """Landed documents as a stream; files already taken are skipped by the query's checkpoint."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path, wholetext=True)
    return parse_documents(raw.withColumn("source_file", F.col("_metadata.file_path")), "value", schema)


def sound_state(spark: SparkSession, checkpoint: str) -> bool:
    """Whether the logs of a query's checkpoint can be read; one that is not there yet is sound.

    Spark keeps the logs of about a hundred batches, each a small file: a version line, then a line of JSON for every entry.
    """
    logs = {"metadata": False, "offsets/*": True, "commits/*": True}
    for name, versioned in logs.items():
        try:
            lines = spark.read.text(f"{checkpoint}/{name}", wholetext=True).collect()
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            continue
        for row in lines:
            head, *rest = row["value"].splitlines() or [""]
            entries = rest if versioned else [head]
            if (versioned and not head.startswith("v")) or not entries or not all(_is_entry(e) for e in entries):
                return False
    return True


def _is_entry(line: str) -> bool:
    if line == "-":  # a source without an offset yet
        return True
    try:
        json.loads(line)
    except ValueError:
        return False
    return True


def generations(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the generations below a folder: each fresh start begins one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("generation="))


def ingested(spark: SparkSession, target: str, kind: str) -> DataFrame:
    """The plays or the status rows of the last generation."""
    last = generations(spark, f"{target}/{kind}")[-1]
    return spark.read.parquet(f"{target}/{kind}/generation={last}")


def ingest_available(spark: SparkSession, landed: str, target: str, schema: str, checkpoint: str, files_per_batch: int = 1000) -> int:
    """Take every landed file once: plays to Parquet by season, and one status row per document. Returns the generation.

    A batch that is run again writes the same folder of its number, so nothing appears twice. Where the query's state can't be
    read any more, a new generation takes all files anew, with a state and folders of its own; ``ingested`` reads the last one.
    """
    generation = (generations(spark, checkpoint) or [0])[-1]
    if not sound_state(spark, f"{checkpoint}/generation={generation}"):
        warnings.warn(f"unreadable state below {checkpoint}/generation={generation}: all files are taken anew", stacklevel=2)
        generation += 1

    def take(docs: DataFrame, batch: int) -> None:
        # Each file is read and parsed once for plays, good and bad states.
        docs = docs.persist()
        good, bad = split_bad(docs)
        plays = flatten_pbp(good)
        write_dataset(plays, f"{target}/plays/generation={generation}/batch={batch}")
        states = good.select("source_file", F.lit("complete").alias("state"), F.lit("").alias("message")).unionByName(
            bad.select("source_file", F.lit("failed").alias("state"), F.lit("malformed document").alias("message"))
        )
        states = states.withColumn("seq", F.lit(batch).cast("bigint"))
        states.write.mode("overwrite").parquet(f"{target}/status/generation={generation}/batch={batch}")
        docs.unpersist()

    query = (
        read_stream(spark, landed, schema, files_per_batch)
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", f"{checkpoint}/generation={generation}")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return generation
