"""A store whose files lie where the lookup wants them.

The newest write per (kind, place, hour) is written once as a Parquet table
bucketed and sorted by that key.  Lookups then shuffle their requests only: the
store's rows are read bucket by bucket, with no exchange, however often they
are asked.  Later writes are added in buckets of the same kind, and the newest
per key is taken again when the store is read, in place.

A bucketed table is known by its name in the session's catalog; ``open_store``
makes the files of another session's store known again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearcast.operators.store import KEYS, freshness_cutoff, latest_per_key, lookup, route
from wearcast.session import shared_path

KIND = "kind"


def _bucketed(df: DataFrame, keys: Sequence[str], buckets: int):
    """``df`` dealt as the buckets are, so each bucket is one file."""
    rows = df.repartition(buckets, *keys)
    return rows.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys)


def write_store(
    forecasts: DataFrame, history: DataFrame, buckets: int, order: Sequence[str] = ("snapshot_ts",), keys: Sequence[str] = KEYS,
    name: str | None = None, path: str | None = None,
) -> str:
    """Write both stores as one bucketed table; returns its name.  Pick
    ``buckets`` for files of some hundred megabytes: it is fixed from here on.
    The columns are those that both have."""
    spark = forecasts.sparkSession
    cols = [c for c in forecasts.columns if c in history.columns]
    both = forecasts.select(*cols).withColumn(KIND, F.lit("forecast")).unionByName(history.select(*cols).withColumn(KIND, F.lit("history")))
    by = [KIND, *keys]
    table = name or f"observations_{uuid.uuid4().hex}"
    target = path or shared_path(spark, "observation_store")
    _bucketed(latest_per_key(both, by, order), by, buckets).option("path", target).saveAsTable(table)
    return table


def append_store(table: str, rows: DataFrame, kind: str, order: Sequence[str] = ("snapshot_ts",), keys: Sequence[str] = KEYS) -> None:
    """Add later writes of one kind, in the table's own buckets."""
    spark = rows.sparkSession
    by = [KIND, *keys]
    have = spark.table(table)
    buckets = int(spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").first()["data_type"])
    new = latest_per_key(rows.withColumn(KIND, F.lit(kind)), by, order).select(*have.columns)
    _bucketed(new, by, buckets).mode("append").saveAsTable(table)


def open_store(spark: SparkSession, name: str, path: str, schema: T.StructType, buckets: int, keys: Sequence[str] = KEYS) -> str:
    """Make a store that was written elsewhere known to this session."""
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    by = ", ".join(f"`{k}`" for k in [KIND, *keys])
    spark.sql(f"CREATE TABLE {name} ({cols}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return name


def store_lookup(
    requests: DataFrame, table: str, now, when_col: str = "obs_hour", keys: Sequence[str] = KEYS, order: Sequence[str] = ("snapshot_ts",), ttl_hours: int | None = None
) -> DataFrame:
    """J7 over a bucketed store: each request is routed by its time and looked
    up; with ``ttl_hours`` only forecasts that old at most count.  The store's
    rows are not shuffled."""
    by = [KIND, *keys]
    rows = requests.sparkSession.table(table)
    if ttl_hours is not None:
        rows = rows.where((F.col(KIND) == "history") | (F.col("snapshot_ts") >= freshness_cutoff(now, ttl_hours)))
    return lookup(requests.withColumn(KIND, route(when_col, now)), latest_per_key(rows, by, order), keys=by)
