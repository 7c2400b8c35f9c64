"""Reading and writing of table folders."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rinkflow.session import fresh_path

# Fixed order of numeric widening.
_WIDTH = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 3, T.LongType: 4, T.FloatType: 5, T.DoubleType: 6}


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name: missing columns become null, numeric types widen, other clashes become text."""
    types: dict[str, T.DataType] = {}
    for df in frames:
        for f in df.schema.fields:
            seen = types.get(f.name)
            if seen is None or seen == f.dataType:
                types[f.name] = f.dataType
            elif type(seen) in _WIDTH and type(f.dataType) in _WIDTH:
                types[f.name] = max(seen, f.dataType, key=lambda t: _WIDTH[type(t)])
            else:
                types[f.name] = T.StringType()
    cast = [df.select(*[F.col(c).cast(types[c]).alias(c) for c in df.columns]) for df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def read_union_by_name(spark: SparkSession, path: str) -> DataFrame | None:
    """All Parquet files below ``path`` although their schemas differ; hive keys come from the folders.

    Schemas are read from the footers by tasks. Files of one schema are read together, so the number of reads is the
    number of distinct schemas. A missing or empty path gives None.
    """
    try:
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.parquet")
            .load(path)
            .select("path")
        )
    except AnalysisException as error:
        if not _absent(error):
            raise
        return None

    def footers(batches: Iterable) -> Iterable:
        for pdf in batches:
            texts = []
            for p in pdf["path"]:
                texts.append(_footer_text(p))
            yield pdf.assign(footer=texts)

    tagged = files.mapInPandas(footers, "path string, footer string")
    shapes = tagged.groupBy("footer").agg(F.collect_list("path").alias("paths")).collect()
    if not shapes:
        return None
    frames = [spark.read.option("basePath", path).parquet(*row["paths"]) for row in shapes]
    return _hive_keys_as_long(union_by_name(frames))


def _footer_text(path: str) -> str:
    from pyarrow import fs

    filesystem, inner = fs.FileSystem.from_uri(path)
    with filesystem.open_input_file(inner) as handle:
        schema = pq.read_schema(handle)
    return "; ".join(f"{f.name} {f.type}" for f in schema)


def _hive_keys_as_long(df: DataFrame) -> DataFrame:
    if "season" in df.columns:
        return df.withColumn("season", F.col("season").cast("bigint"))
    return df


def write_dataset(df: DataFrame, path: str, by: Sequence[str] = ("season",)) -> bool:
    """Write hive-partitioned Parquet, replacing only the partitions present in ``df``; False when it is empty.

    Rows are rebalanced by key: small keys share a task and a large key is split over many by its measured size.
    """
    if df.limit(1).count() == 0:
        return False
    (
        df.hint("rebalance", *by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "snappy")
        .partitionBy(*by)
        .parquet(path)
    )
    return True


def read_optional(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """The table at ``path``, or an empty one with the given schema."""
    try:
        return spark.read.format(kind).load(path)
    except AnalysisException as error:
        if not _absent(error):
            raise
        return spark.createDataFrame([], schema)


def _absent(error: AnalysisException) -> bool:
    """Whether a read failed since nothing is there; any other failure is an error."""
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def replace_table(df: DataFrame, name: str) -> None:
    """Create a table from a query, or replace its rows and columns."""
    df.write.mode("overwrite").option("overwriteSchema", "true").saveAsTable(name)


def register_views(spark: SparkSession, tables: Mapping[str, DataFrame | None], shots: Sequence[str]) -> list[str]:
    """Register the tables that exist, and ``v_shots`` over ``raw_pbp``."""
    names = []
    for name, df in tables.items():
        if df is not None:
            df.createOrReplaceTempView(name)
            names.append(name)
    if tables.get("raw_pbp") is not None:
        spark.table("raw_pbp").filter(F.col("event_type").isin(*shots)).createOrReplaceTempView("v_shots")
        names.append("v_shots")
    return names


def require_tables(spark: SparkSession, names: Sequence[str]) -> list[str]:
    """The names that the catalog does not know."""
    return [n for n in names if not spark.catalog.tableExists(n)]


def table_counts(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """Row count of every named table or view."""
    parts = [spark.table(n).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("name"), "n_rows") for n in names]
    return reduce(DataFrame.unionByName, parts)


def rewrite_dataset(df: DataFrame, name: str, checks: Sequence[str] = ()) -> DataFrame:
    """Write a new version of a dataset, compare row count and column sums, and return the new version.

    The check reads only the summed columns of both versions. The old version stays readable until the caller points
    its view at the new one.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    new = spark.read.parquet(path)
    if checks:
        totals = [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in checks]]
        compare_sums(df.agg(*totals).first().asDict(), new.agg(*totals).first().asDict())
    return new


def compare_sums(before: Mapping[str, float], after: Mapping[str, float]) -> None:
    """Raise when counts or sums of two versions differ."""
    for c in before:
        old, new = before[c] or 0, after[c] or 0
        if abs(old - new) > 1e-6 * max(1.0, abs(old)):
            raise ValueError(f"rewritten dataset differs in {c}: {old} / {new}")


def to_json_records(df: DataFrame) -> DataFrame:
    """One JSON record per row; NaN is written as null and null keys are kept."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("record"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A one-row metric table as JSON."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def lookup_table(rows: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """A lookup with one value per key; of repeated keys the last one counts."""
    return rows.groupBy(key).agg(F.max_by(value, ordinal).alias(value))
