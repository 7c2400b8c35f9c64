"""Session settings shared by every module."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

GROUP_ROWS_CONF = "rinkflow.maxGroupRows"
SMALL_ROWS_CONF = "rinkflow.maxSmallRows"

# A group above this many rows is split before a window touches it.
DEFAULT_GROUP_ROWS = 4_000_000
# A side at or below this many rows may be broadcast or ranked in one partition.
DEFAULT_SMALL_ROWS = 50_000


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rinkflow")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def max_group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(GROUP_ROWS_CONF, str(DEFAULT_GROUP_ROWS)))


def max_small_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(SMALL_ROWS_CONF, str(DEFAULT_SMALL_ROWS)))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder. Only a session on one machine gets a folder of its own where none is configured."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
        root = tempfile.mkdtemp(prefix="rinkflow-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_scratch: ContextVar[str] = ContextVar("scratch", default="")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, or below the scratch folder of the block that asks."""
    return f"{shared_dir(spark)}/rinkflow/{_scratch.get()}{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A block whose written versions are deleted at its end, whether or not it fails.

    Operators return frames that read what they have written, so results must be written or collected inside the block, to a path
    that was named before it.
    """
    outer = _scratch.get()
    inner = f"{outer}scratch-{uuid.uuid4().hex}/"
    token = _scratch.set(inner)
    try:
        yield
    finally:
        _scratch.reset(token)
        drop_version(spark, f"{shared_dir(spark)}/rinkflow/{inner.rstrip('/')}")


def drop_version(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``fresh_path`` named, once no frame reads it any more."""
    root = f"{shared_dir(spark)}/rinkflow/"
    if not path.startswith(root):
        raise ValueError(f"{path} is not below {root}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the reliable checkpoint folder and continue from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
