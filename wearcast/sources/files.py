"""Text sources and sinks: activity-log CSVs (S1, S2), the workbook export
(S3), coordinates (S5), the clothing-rules asset (S9), the empty template
(S11) and the sample-data sink (S6).

Schemas are always given, never inferred; booleans are read as text and
parsed with both spellings (Yes/No and TRUE/FALSE); the text 'None' stays a
category value.
"""

from __future__ import annotations

import csv
import datetime as dt
from collections.abc import Iterable, Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wearcast import schema as S
from wearcast.functions.parsing import parse_bool
from wearcast.operators.cleaning import drop_columns, drop_empty_rows, rename_workbook_headers, union_all_by_name

BOM = "\ufeff"


def _typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The declared columns by name, converted from text (a text that is no
    value of the type is NULL), missing ones NULL; other columns kept as text."""
    out = []
    for f in schema:
        if f.name not in df.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.BooleanType):
            out.append(parse_bool(f.name).alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name))
    return df.select(*out, *[F.col(f"`{c}`") for c in df.columns if c not in schema.fieldNames()])


# -- S1 ---------------------------------------------------------------------
def csv_path(path: str) -> str:
    """A named file always has the .csv suffix."""
    if path.endswith("/") or path.endswith(".csv") or "*" in path:
        return path
    stem = path.rsplit(".", 1)[0] if "." in path.rsplit("/", 1)[-1] else path
    return stem + ".csv"


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """``(header, files)``: each header line under ``path`` with the files that
    have it.  One distributed scan finds every file's first line; the result
    has one row per layout."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    firsts = (
        lines.where("start = 0")
        .withColumn("n", F.monotonically_increasing_id())
        .groupBy("file")
        .agg(F.min_by("value", "n").alias("header"))
    )
    return firsts.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))


def _layouts(spark: SparkSession, path: str) -> list[tuple[list[str], list[str]]]:
    """(columns, files) of each layout, in the order of their first files."""
    rows = sorted(file_headers(spark, path).collect(), key=lambda r: r["files"])
    return [(next(csv.reader([r["header"].removeprefix(BOM)])), [unquote(f) for f in r["files"]]) for r in rows]


def _read_layout(spark: SparkSession, columns: list[str], files: list[str], mode: str) -> DataFrame:
    """The rows of files of one layout, as text.  Whole lines are parsed
    whatever is selected, so a count equals the length of a full select."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("mode", mode).option("columnPruning", False).csv(files)


def read_activity_csv(spark: SparkSession, path: str, schema: T.StructType = S.ACTIVITY_LOG_SCHEMA) -> DataFrame:
    """A labelled activity log CSV with header (a file, folder or glob); a
    missing path and an unreadable file fail.  Every file is read by its own
    header: columns are matched by name in any order, typed by ``schema``;
    declared columns that a file lacks are NULL there, others stay text."""
    frames = [_typed(_read_layout(spark, columns, files, "PERMISSIVE"), schema) for columns, files in _layouts(spark, csv_path(path))]
    return union_all_by_name(*frames) if frames else spark.createDataFrame([], schema)


# -- S2 / U1 ----------------------------------------------------------------
def _belongs(columns: list[str], schema: T.StructType, min_share: float) -> bool:
    return len(set(columns) & set(schema.fieldNames())) >= min_share * len(schema)


def read_all_logs(spark: SparkSession, families: Sequence[tuple[str, T.StructType]], min_share: float = 0.5) -> DataFrame:
    """Every CSV of each schema family (glob, schema), unioned by column
    name with missing columns as NULL.  Each file is read by its own header.
    A file whose header has less than ``min_share`` of the family's columns is
    another table in the same folder and left out; lines with a wrong number
    of fields are dropped.  ``log_report`` counts both.  An unreadable file
    fails."""
    frames = [
        _typed(_read_layout(spark, columns, files, "DROPMALFORMED"), schema)
        for glob, schema in families
        for columns, files in _layouts(spark, glob)
        if _belongs(columns, schema, min_share)
    ]
    return union_all_by_name(*frames) if frames else spark.createDataFrame([], families[0][1])


def log_report(spark: SparkSession, families: Sequence[tuple[str, T.StructType]], min_share: float = 0.5) -> DataFrame:
    """What ``read_all_logs`` takes and leaves: one row per family and layout
    with ``(family, header, files, taken, lines_read, lines_dropped)``."""
    rows = []
    for glob, schema in families:
        for columns, files in _layouts(spark, glob):
            taken = _belongs(columns, schema, min_share)
            there = _read_layout(spark, columns, files, "PERMISSIVE").count() if taken else 0
            kept = _read_layout(spark, columns, files, "DROPMALFORMED").count() if taken else 0
            rows.append((glob, ",".join(columns), len(files), taken, kept, there - kept))
    return spark.createDataFrame(rows, "family string, header string, files int, taken boolean, lines_read long, lines_dropped long")


# -- S3 ---------------------------------------------------------------------
WORKBOOK_NUMERIC = ["distance", "duration", "wind_speed", "temp_f", "feels_like", "pct_humidity"]
WORKBOOK_BOOLEAN = ["is_light", "ears_hat", "arm_warmers", "gloves", "face_cover", "heavy_socks"]


def read_workbook_export(spark: SparkSession, path: str, first_columns: int = 25) -> DataFrame:
    """S3: a CSV/Parquet export of the activity workbook sheet: columns A..Y,
    fully empty rows dropped, headers renamed, Yes/No parsed, numbers typed.
    Each CSV file is read by its own header and matched by column name."""
    if path.endswith(".parquet"):
        sheets = [spark.read.parquet(path)]
    else:
        sheets = [_read_layout(spark, columns, files, "PERMISSIVE") for columns, files in _layouts(spark, path)]
    cut = [sheet.select(*[F.col(f"`{c}`") for c in sheet.columns[:first_columns]]) for sheet in sheets]
    return typed_sheet(drop_empty_rows(union_all_by_name(*cut)))


def typed_sheet(sheet: DataFrame) -> DataFrame:
    """A sheet's text columns renamed, the unused ones dropped, numbers and
    Yes/No parsed."""
    df = drop_columns(rename_workbook_headers(sheet), S.WORKBOOK_DROPS)
    typed = {c: F.col(c).cast("string").try_cast("double") for c in WORKBOOK_NUMERIC if c in df.columns}
    typed.update({c: parse_bool(c) for c in WORKBOOK_BOOLEAN if c in df.columns})
    return df.withColumns(typed)


# -- S5 ---------------------------------------------------------------------
def read_coordinates(spark: SparkSession, path: str, seed_missing: bool = False) -> DataFrame:
    """``location, latitude, longitude`` (location stays text, so zip
    codes keep leading zeros); the two default rows when no table exists,
    written to ``path`` first with ``seed_missing``."""
    try:
        return spark.read.schema(S.COORDINATE_SCHEMA).option("header", True).csv(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        defaults = spark.createDataFrame(S.DEFAULT_COORDINATES, S.COORDINATE_SCHEMA)
        if not seed_missing:
            return defaults
        defaults.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)
        return spark.read.schema(S.COORDINATE_SCHEMA).option("header", True).csv(path)


# -- S9 ---------------------------------------------------------------------
def _entries(df: DataFrame, column: str, key: str, value: str) -> DataFrame:
    """One row per entry of the objects in a variant column; what is no object
    has none."""
    spark = df.sparkSession
    each = df.lateralJoin(spark.tvf.variant_explode(F.col(column).outer()))
    return each.where("key IS NOT NULL").select(*[c for c in df.columns if c != column], F.col("key").alias(key), F.col("value").alias(value))


def read_clothing_rules(spark: SparkSession, path: str) -> DataFrame:
    """Nested rules JSON (activity -> condition -> body part -> item or
    list of items) flattened to ``(activity, condition, body_part, item)``.

    The document is read as one variant, so a value is a list or a scalar by
    its type and not by its text; an item that is neither is kept as its JSON.
    Empty and null items are dropped; a level that is no object has no
    entries."""
    doc = spark.read.option("singleVariantColumn", "v").option("multiLine", True).json(path)
    parts = _entries(_entries(_entries(doc, "v", "activity", "v"), "v", "condition", "v"), "v", "body_part", "v")
    many = F.try_variant_get("v", "$", "array<variant>")
    out = parts.select("activity", "condition", "body_part", F.explode(F.coalesce(many, F.array("v"))).alias("i"))
    item = F.try_variant_get("i", "$", "string")
    return out.select("activity", "condition", "body_part", item.alias("item")).where("item <> ''")


# -- S11 / O1 ---------------------------------------------------------------
def sample_template(spark: SparkSession, extra: Iterable[T.StructField] = ()) -> DataFrame:
    """The empty table in the cleaned schema (plus extra fields)."""
    return spark.createDataFrame([], T.StructType(list(extra) + list(S.CLEAN_SCHEMA.fields)))


# -- S6 ---------------------------------------------------------------------
def default_sample_name(now: dt.datetime | None = None) -> str:
    now = now or dt.datetime.now()
    return f"outfit_data_{now.day}{now.month}{now.hour}{now.minute}.csv"


def write_sample_data(df: DataFrame, directory: str, name: str = "", fmt: str = "csv", append: bool = False) -> str:
    """Write sample rows with a header (CSV) or as Parquet; returns
    the path.  An existing path is an error unless ``append`` adds to it; it
    is never overwritten."""
    target = f"{directory.rstrip('/')}/{name or default_sample_name()}"
    writer = df.write.mode("append" if append else "errorifexists")
    if fmt == "csv":
        writer.option("header", True).csv(target)
    else:
        writer.parquet(target)
    return target
