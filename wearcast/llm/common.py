"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearcast.session import shared_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[\x20\x09-\x0D]+"


def materialise(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs start
    from files that every executor sees, so a lost executor costs no more than
    a reread.  With ``release`` the driver collects its garbage then, upon
    which Spark deletes the shuffle files that led to the table; worth it
    after large shuffles."""
    spark = df.sparkSession
    path = shared_path(spark, "llm", name)
    df.write.option("compression", "zstd").parquet(path)
    if release:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def words_of(c: Column) -> Column:
    """Words separated by ASCII white space; no empty words."""
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def text_or_empty(df: DataFrame, name: str) -> Column:
    return F.coalesce(df[name].cast("string"), F.lit(""))


def order_key(doc_id: Column, *more: Column) -> Column:
    """Ascending order with NULL ids last."""
    return F.struct(doc_id.isNull().alias("no_id"), doc_id.alias("doc_id"), *more)


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array, drop: str | None = None) -> pa.RecordBatch:
    """The batch with a column appended; columns called ``name`` or ``drop`` go."""
    keep = [i for i, n in enumerate(batch.schema.names) if n not in (name, drop)]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), values], names=[*(batch.schema.names[i] for i in keep), name])


def schema_with(fields: list[T.StructField], name: str, kind: str) -> str:
    """DDL of ``fields`` and one column more."""
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{name}` {kind}"])


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, with at most ``rows`` rows in an Arrow batch from here on: texts
    are large, and JVM and Python both hold a batch at a time."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    return df
