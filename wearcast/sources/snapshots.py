"""Observation snapshots as Parquet tables in the shared folder.

A snapshot is written once to a fresh directory (never read and overwritten
in the same job), partitioned by day so a day lookup prunes partitions.
Writing a snapshot also cuts the lineage: later jobs read the files, so a
lost executor costs a re-read, not a recomputation of the upstream plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from wearcast.session import shared_path


def write_snapshot(
    df: DataFrame,
    path: str | None = None,
    partition_by: Sequence[str] = ("obs_date",),
    cluster_by: Sequence[str] = ("location_key",),
) -> str:
    """Write ``df`` as a new snapshot; returns its path.

    Rows are range-partitioned by the day and then ``cluster_by`` before the
    write, so each task holds a contiguous run of days and writes about one
    file per day it covers (not one per task and day), while a day holding a
    large share of the rows is still split across tasks by the second key."""
    target = path or shared_path(df.sparkSession, "snapshots")
    if partition_by:
        keys = [*partition_by, *[c for c in cluster_by if c in df.columns]]
        df = df.repartitionByRange(*keys)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(target)
    return target


def read_snapshot(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame:
    """Read a snapshot; with ``like`` the schema and column order of that
    frame are used (partition columns keep their types)."""
    if like is None:
        return spark.read.parquet(path)
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)
