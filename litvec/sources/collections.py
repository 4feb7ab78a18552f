"""Vector collections: versions in managed tables with a fixed dimension and metric, one of them current."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from litvec.operators.passages import fill_unknown
from litvec.operators.search import METRICS


def dimension_violations(df: DataFrame, dim: int, vector_col: str = "vector") -> DataFrame:
    """Rows whose vector is missing, has another length than ``dim``, or holds a null, a NaN or an infinity."""
    return df.where(F.col(vector_col).isNull() | (F.size(vector_col) != dim) | ~_finite(F.col(vector_col)))


def _finite(vector: Column) -> Column:
    return F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))


def _checked(vector: Column, dim: int) -> Column:
    found = F.coalesce(F.size(vector).cast("string"), F.lit("null"))
    return (
        F.when((F.size(vector) == dim) & _finite(vector), vector)
        .when(F.size(vector) == dim, F.raise_error(F.lit("vector with a null, a NaN or an infinity")))
        .otherwise(F.raise_error(F.concat(F.lit(f"vector of dimension {dim} expected, found "), found)))
    )


def ensure_namespace(spark: SparkSession, namespace: str, location: str | None = None) -> None:
    """Create the namespace if it is absent, in the warehouse or in a folder of its own."""
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{namespace}`{where}")


def exists(spark: SparkSession, namespace: str, name: str) -> bool:
    return spark.catalog.tableExists(f"`{namespace}`.`{name}`")


# A collection is a view of one of its versions, tables of their own that no write changes.
_VERSION = "__v"


def versions(spark: SparkSession, namespace: str, name: str) -> list[int]:
    """Numbers of the versions that are there, in ascending order."""
    prefix = f"{name}{_VERSION}"
    tables = spark.sql(f"SHOW TABLES IN `{namespace}`").collect()
    ends = [r["tableName"][len(prefix) :] for r in tables if r["tableName"].lower().startswith(prefix.lower())]
    return sorted(int(e) for e in ends if e.isdigit())


def manifest(spark: SparkSession, namespace: str, name: str) -> list[dict[str, str]]:
    """One entry per version: ``version``, ``dimension``, ``metric``, ``rows``, and whether it is the current one."""
    current = current_version(spark, namespace, name)
    entries = []
    for v in versions(spark, namespace, name):
        kept = _table_properties(spark, namespace, _table(name, v))
        entries.append({"version": v, "current": v == current} | {k: kept.get(k) for k in ("dimension", "metric", "rows")})
    return entries


def _table(name: str, version: int) -> str:
    return f"{name}{_VERSION}{version}"


def _table_properties(spark: SparkSession, namespace: str, table: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES `{namespace}`.`{table}`").collect()}


def current_version(spark: SparkSession, namespace: str, name: str) -> int | None:
    """The version that readers get, as the text of the view names it; None without a collection."""
    if not exists(spark, namespace, name):
        return None
    told = spark.sql(f"DESCRIBE TABLE EXTENDED `{namespace}`.`{name}`").where("col_name = 'View Text'").first()
    named = re.search(rf"{_VERSION}([0-9]+)`\Z", told["data_type"]) if told else None
    if named is None:
        raise LookupError(f"{namespace}.{name} is no collection")
    return int(named[1])


def switch(spark: SparkSession, namespace: str, name: str, version: int) -> None:
    """Make a version that is there the current one, an earlier one to roll back.

    One statement changes the view where it stands, so a reader finds the old or the new version and never
    none. (Replacing a view would drop it first.)
    """
    if version not in versions(spark, namespace, name):
        raise LookupError(f"no version {version} of {namespace}.{name}")
    view, chosen = f"`{namespace}`.`{name}`", f"SELECT * FROM `{namespace}`.`{_table(name, version)}`"
    spark.sql(f"CREATE VIEW IF NOT EXISTS {view} AS {chosen}")
    if current_version(spark, namespace, name) != version:
        spark.sql(f"ALTER VIEW {view} AS {chosen}")


def drop_versions(spark: SparkSession, namespace: str, name: str, keep: int = 2) -> list[int]:
    """Drop all but the newest ``keep`` versions and the current one; returns what was dropped.

    Readers that still read a dropped version fail, so keep those that may be read.
    """
    if keep < 1:
        raise ValueError(f"at least one version has to stay: {keep}")
    current, found = current_version(spark, namespace, name), versions(spark, namespace, name)
    dropped = [v for v in found[:-keep] if v != current]
    for v in dropped:
        spark.sql(f"DROP TABLE `{namespace}`.`{_table(name, v)}`")
    return dropped


def write_collection(
    df: DataFrame,
    namespace: str,
    name: str,
    dim: int,
    metric: str = "COSINE",
    vector_col: str = "vector",
    unknown: bool = True,
    partition_by: tuple[str, ...] = (),
    keep: int = 2,
) -> int:
    """Write ``df`` as a new version of the collection, make it the current one, and return the number of rows.

    A vector of another dimension, or with an element that is no finite number, fails the job and
    leaves no version. The version becomes current by one statement after it is complete, so readers
    never miss the collection; the newest ``keep`` versions stay, for readers that have begun and to
    roll back to. Writers that run at the same time write versions of their own, and the last to
    finish is current. Nulls become ``Unknown`` unless told not to.
    """
    if metric.upper() not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}: {metric!r}")
    if keep < 1:
        raise ValueError(f"at least one version has to stay: {keep}")
    spark = df.sparkSession
    ensure_namespace(spark, namespace)
    rows = fill_unknown(df, skip=("id", *partition_by)) if unknown else df
    rows = rows.withColumn(vector_col, _checked(F.col(vector_col), dim))
    written = Observation()
    fresh = f"`{namespace}`.`{name}__new_{uuid.uuid4().hex}`"
    writer = rows.observe(written, F.count(F.lit(1)).alias("n")).write.format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(fresh)
    n = written.get["n"]
    spark.sql(f"ALTER TABLE {fresh} SET TBLPROPERTIES ('dimension'='{dim}', 'metric'='{metric.upper()}', 'rows'='{n}')")
    version = _numbered(spark, namespace, name, fresh)
    if partition_by:
        spark.sql(f"MSCK REPAIR TABLE `{namespace}`.`{_table(name, version)}` SYNC PARTITIONS")
    switch(spark, namespace, name, version)
    drop_versions(spark, namespace, name, keep)
    return n


def _numbered(spark: SparkSession, namespace: str, name: str, fresh: str) -> int:
    """Give a finished table the next free version number; a number that another writer takes first is left to them."""
    for _ in range(100):
        version = max(versions(spark, namespace, name), default=0) + 1
        try:
            spark.sql(f"ALTER TABLE {fresh} RENAME TO `{namespace}`.`{_table(name, version)}`")
            return version
        except AnalysisException:
            if version not in versions(spark, namespace, name):
                raise
    raise RuntimeError(f"no free version of {namespace}.{name}")


def properties(spark: SparkSession, namespace: str, name: str) -> dict[str, str]:
    """Dimension and metric of a collection."""
    current = current_version(spark, namespace, name)
    if current is None:
        raise LookupError(f"no collection {namespace}.{name}")
    kept = _table_properties(spark, namespace, _table(name, current))
    return {k: kept[k] for k in ("dimension", "metric") if k in kept}


def open_collection(spark: SparkSession, namespace: str, name: str, version: int | None = None) -> DataFrame:
    """The current version of a collection, or the given one.

    A reader is pinned: the frame reads the version that was current when it was opened, whatever is written
    or switched afterwards, as long as that version is kept.
    """
    pinned = current_version(spark, namespace, name) if version is None else version
    if pinned is None or version is not None and version not in versions(spark, namespace, name):
        raise LookupError(f"no collection {namespace}.{name}" + (f", version {version}" if version is not None else ""))
    return spark.table(f"`{namespace}`.`{_table(name, pinned)}`")
