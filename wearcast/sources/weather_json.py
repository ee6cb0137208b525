"""Hourly weather JSON -> one row per (document, hour point).

Documents follow the hourly-forecast layout
``{"location": ..., "hourly": {"data": [{"time": epoch, "icon": ..., ...}]}}``.
The schema is given, never inferred; a document without ``hourly`` yields no
rows (``explode``, not ``explode_outer``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearcast import schema as S


def read_hourly_json(spark: SparkSession, path: str, multi_line: bool = False, strict: bool = False) -> DataFrame:
    """Raw documents (one per line, or one per file with ``multi_line``).
    Adds ``source_file`` (the file the document came from) and
    ``corrupt_document``: the text of a document that is not valid JSON, which
    has no hours.  With ``strict`` such a document fails the job."""
    reader = spark.read.option("multiLine", multi_line)
    if strict:
        df = reader.schema(S.WEATHER_JSON_SCHEMA).option("mode", "FAILFAST").json(path).withColumn("corrupt_document", F.lit(None).cast("string"))
    else:
        schema = T.StructType([*S.WEATHER_JSON_SCHEMA.fields, T.StructField("corrupt_document", T.StringType())])
        df = reader.schema(schema).option("columnNameOfCorruptRecord", "corrupt_document").json(path)
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def corrupt_documents(docs: DataFrame) -> DataFrame:
    """``(source_file, n)``: documents per file that could not be read."""
    broken = docs.select("source_file", "corrupt_document", "hourly")  # more than the text alone is read
    return broken.where("corrupt_document IS NOT NULL").groupBy("source_file").agg(F.count("*").alias("n"))


def parse_hourly_text(text: Column) -> Column:
    """A JSON text column -> the document struct."""
    return F.from_json(text, S.WEATHER_JSON_SCHEMA)


def explode_hourly(docs: DataFrame, doc_cols: list[str] | None = None) -> DataFrame:
    """One row per hour point: the document columns listed plus the point's
    fields (``time``, ``icon``, ``temperature`` ...) and ``point_pos``."""
    keep = [c for c in (doc_cols or ["location"]) if c in docs.columns]
    exploded = docs.select(*keep, F.posexplode("hourly.data").alias("point_pos", "p"))
    return exploded.select(*keep, "point_pos", "p.*")
