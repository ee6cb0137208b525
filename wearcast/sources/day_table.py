"""A store of days that an upsert changes in place of rewriting.

An upsert writes only the days it touches: its rows under ``data/v=N``, and
under ``dead/v=N`` a tombstone for every (place, day) it replaces.  A row of an
earlier version is dead if its (place, day) has a later tombstone; that is
settled when the store is read, by one join with the tombstones, and only for
days that lie in more than one version.  All other days are read as they are.

The manifest of a version lists, per day, the versions that hold rows of it.  A
pointer record, written last, names the manifest, so a reader sees a whole
version or the one before, and any version can be read.  ``compact_days``
merges the days that lie in many versions into one.  One writer at a time.

    base/data/v=N-<id>/obs_date=D/*.parquet     rows
    base/dead/v=N-<id>/obs_date=D/*.parquet     location_key
    base/manifest/v=N-<id>/*.json               day, version, folder
    base/_latest/*.json                         version, manifest
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wearcast.operators.store import KEYS, latest_per_key
from wearcast.sources.snapshots import write_snapshot

PLACE, DAY = "location_key", "obs_date"
_POINTER = "version long, manifest string"
_MANIFEST = "day string, version long, folder string"


@dataclass(frozen=True)
class Version:
    """One version of a store: per day text ('' for NULL) the (version,
    folder) pairs that hold rows of it, oldest first."""

    number: int
    days: dict[str, list[tuple[int, str]]]


def _day_text() -> Column:
    return F.coalesce(F.col(DAY).cast("string"), F.lit(""))


def current(spark: SparkSession, base: str, version: int | None = None) -> Version:
    """The newest version, or the one given; version 0 is the empty store."""
    try:
        pointers = spark.read.schema(_POINTER).json(f"{base}/_latest")
        if version is not None:
            pointers = pointers.where(F.col("version") <= version)
        rows = pointers.orderBy(F.desc("version")).limit(1).collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    if not rows or (version is not None and rows[0]["version"] != version):
        if version:
            raise ValueError(f"no version {version} in {base}")
        return Version(0, {})
    days: dict[str, list[tuple[int, str]]] = {}
    # one row per day and version that holds it
    for r in spark.read.schema(_MANIFEST).json(rows[0]["manifest"]).orderBy("day", "version").collect():
        days.setdefault(r["day"] or "", []).append((r["version"], r["folder"]))
    return Version(rows[0]["version"], days)


def _commit(spark: SparkSession, base: str, name: str, seen: Version, days: dict[str, list[tuple[int, str]]]) -> int:
    """Write the manifest, then the pointer that makes it the current one."""
    number = seen.number + 1
    manifest = f"{base}/manifest/{name}"
    rows = [(day, v, folder) for day, held in sorted(days.items()) for v, folder in held]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.json(manifest)
    if current(spark, base).number != seen.number:
        raise RuntimeError(f"another writer has changed {base}")
    spark.createDataFrame([(number, manifest)], _POINTER).coalesce(1).write.mode("append").json(f"{base}/_latest")
    return number


def _days_of(written: DataFrame) -> list[str]:
    """The days that were written, by folder name: one row a day."""
    return [r[0] for r in written.select(_day_text().alias("d")).distinct().collect()]


def upsert(df: DataFrame, base: str, keys: Sequence[str] = KEYS, order: Sequence[str] = ("snapshot_ts",)) -> int:
    """Whole-day upsert of ``df`` into the store at ``base`` (made if it is not
    there): a (place, day) in ``df`` replaces that place's day entirely; its
    hours are the newest writes by ``order``.  Writes the days of ``df`` only
    and returns the new version's number.

    A NULL place or day equals none, so it replaces nothing and is never
    replaced.  An empty ``df`` makes no version."""
    spark = df.sparkSession
    seen = current(spark, base)
    name = f"v={seen.number + 1}-{uuid.uuid4().hex}"
    rows = latest_per_key(df, keys, order).select(*df.columns)
    data = write_snapshot(rows, f"{base}/data/{name}")
    written = spark.read.schema(df.schema).parquet(data)
    touched = _days_of(written)
    if not touched:
        return seen.number
    dead = written.where(F.col(PLACE).isNotNull() & F.col(DAY).isNotNull()).select(PLACE, DAY).distinct()
    write_snapshot(dead, f"{base}/dead/{name}")
    days = {d: list(held) for d, held in seen.days.items()}
    for d in touched:
        days.setdefault(d, []).append((seen.number + 1, name))
    return _commit(spark, base, name, seen, days)


def _part(spark: SparkSession, root: str, schema, picked: dict[str, list[tuple[int, str]]]) -> DataFrame | None:
    """Rows of the folders under ``root`` that the manifest rows name, with
    their ``_v``; each folder is read once, pruned to its days."""
    by_folder: dict[tuple[int, str], list[str]] = {}
    for day, held in picked.items():
        for at in held:
            by_folder.setdefault(at, []).append(day)
    parts = [
        spark.read.schema(schema).parquet(f"{root}/{folder}").where(_day_text().isin(days)).withColumn("_v", F.lit(v).cast("long"))
        for (v, folder), days in sorted(by_folder.items())
    ]
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else None


def read(spark: SparkSession, base: str, schema, days: Sequence[str] | None = None, version: int | None = None) -> DataFrame:
    """The live rows of the store, of all days or of the ``days`` given as text
    ('2024-01-31'); ``schema`` is that of the frames upserted.  Days outside
    are not listed or read."""
    held = current(spark, base, version).days
    if days is not None:
        held = {d: held[d] for d in days if d in held}
    return _live(spark, base, schema, held)


def _live(spark: SparkSession, base: str, schema, held: dict[str, list[tuple[int, str]]]) -> DataFrame:
    plain = _part(spark, f"{base}/data", schema, {d: h for d, h in held.items() if len(h) == 1 or d == ""})
    several = {d: h for d, h in held.items() if len(h) > 1 and d != ""}
    out = [] if plain is None else [plain.drop("_v")]
    if several:
        keyed = f"{PLACE} {_type(schema, PLACE)}, {DAY} {_type(schema, DAY)}"
        # the oldest version of a day kills nothing
        later = {d: h[1:] for d, h in several.items()}
        dead = _part(spark, f"{base}/dead", keyed, later).groupBy(PLACE, DAY).agg(F.max("_v").alias("_dead"))
        rows = _part(spark, f"{base}/data", schema, several).join(dead, [PLACE, DAY], "left")
        out.append(rows.where(F.col("_dead").isNull() | (F.col("_v") >= F.col("_dead"))).drop("_v", "_dead"))
    if not out:
        return spark.createDataFrame([], schema)
    names = [f.name for f in schema.fields]
    return reduce(lambda a, b: a.unionByName(b), out).select(*names)


def _type(schema, name: str) -> str:
    return schema[name].dataType.simpleString()


def compact_days(spark: SparkSession, base: str, schema, versions: int = 4) -> int:
    """Merge every day that lies in ``versions`` or more versions into one
    folder; other days stay where they are.  Returns the version's number."""
    seen = current(spark, base)
    many = {d: h for d, h in seen.days.items() if len(h) >= versions}
    if not many:
        return seen.number
    name = f"v={seen.number + 1}-{uuid.uuid4().hex}"
    write_snapshot(_live(spark, base, schema, many), f"{base}/data/{name}")
    days = {d: ([(seen.number + 1, name)] if d in many else h) for d, h in seen.days.items()}
    return _commit(spark, base, name, seen, days)
