"""What every plan needs from the session: a shared folder, staged tables, an even scan."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Tables of ids and short fields are broadcast up to this counted number of rows and bytes as Parquet.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; every executor can reach it.

    Only a local master may go without the setting: driver and executors are one process there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="litvec-")
    return _local_dirs[context.applicationId]


_runs: list[str] = []


def staging_path(spark: SparkSession, name: str) -> str:
    return "/".join([shared_dir(spark), "litvec", *_runs, f"{name}-{uuid.uuid4().hex}"])


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """What is staged inside goes into one folder of the shared one, which is dropped at the end.

    Results that are still lazy read staged tables: write or collect them inside.
    """
    _runs.append(f"run-{uuid.uuid4().hex}")
    path = "/".join([shared_dir(spark), "litvec", *_runs])
    try:
        yield path
    finally:
        _runs.pop()
        drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete what is staged there; no lazy result may read it any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage at a place that outlives lost executors, and fixes whatever the plan above
    it decided (partition numbers, model output), so later passes all see the same rows.
    """
    return staged(df, name)[0]


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """What ``stage`` gives, and its path."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def bytes_under(spark: SparkSession, path: str) -> int:
    """Bytes of all files in a folder, as its file system counts them."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(folder).getLength()


def small_side(df: DataFrame, name: str = "side", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Side of a join, staged, counted and weighed: broadcast up to ``max_rows``, joined by shuffle beyond.

    Without the count Spark may shuffle the large side by a hot key before it learns that the
    other one is tiny.
    """
    side, path = staged(df, name)
    small = bytes_under(df.sparkSession, path) <= BROADCAST_BYTES and side.count() <= max_rows
    return F.broadcast(side) if small else side


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a scan that has fewer splits than the session has task slots.

    A table of many splits is returned as it is, so large inputs are never shuffled here.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df
