"""Structured Streaming: continuous weather ingest (ST1), continuous scoring
(ST2) and forecast expiry on read (ST3).

ST1 keeps an append-only observation log (Parquet, a folder per micro-batch,
days below it).  Every attempt at a micro-batch writes a folder of its own and
then a commit record that names it, so each batch counts once and only when it
is complete; a batch that is run again leaves what readers see alone until it
commits.  "Newest arrival wins per (place, hour)" is resolved
when the log is read, with the same last-write-wins aggregate as the batch
store.  Late or repeated hours therefore simply overwrite, as in the
original's dictionary, with no state kept in the stream.

``compact_log`` folds the committed batches into day folders of a snapshot.
Its cut is a batch number, not a time: a reader takes the snapshot plus every
batch after the cut, pruned by folder, and no row can fall between the two
whatever its stamp.  Only days that the new batches touch are rewritten.
Checkpoints and snapshots go under the session's shared checkpoint folder
unless given.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wearcast import schema as S
from wearcast.operators.cleaning import union_all_by_name
from wearcast.operators.observations import observations_from_points
from wearcast.operators.store import fresh_only, latest_per_key
from wearcast.operators.trees import TreeModel
from wearcast.session import shared_path
from wearcast.sources.snapshots import write_snapshot
from wearcast.sources.weather_json import explode_hourly

# A forecast document as it arrives: the hourly payload plus an envelope
# naming the place, when the snapshot was taken and its sequence number.
STREAM_DOC_SCHEMA = T.StructType(
    [
        T.StructField("location", T.StringType()),
        T.StructField("snapshot_ts", T.TimestampNTZType()),
        T.StructField("seq", T.LongType()),
        T.StructField("hourly", S.WEATHER_JSON_SCHEMA["hourly"].dataType),
    ]
)

LOG_ORDER = ("snapshot_ts", "seq", "epoch")
# Snapshot times travel with microseconds.
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def observation_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None, **obs_kw) -> DataFrame:
    """Streaming observations from forecast documents landing in ``path``."""
    reader = spark.readStream.schema(STREAM_DOC_SCHEMA).option("timestampNTZFormat", TS_FORMAT)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    docs = reader.json(path)
    points = explode_hourly(docs, ["location", "snapshot_ts", "seq"])
    return observations_from_points(points, **obs_kw)


def start_observation_log(
    stream: DataFrame, log_path: str, checkpoint: str | None = None, available_now: bool = True
) -> StreamingQuery:
    """ST1 sink: append observations to the log, one folder per micro-batch
    (``batch_id``) and day, stamped with the batch time (``ingest_ts``).  A
    log belongs to one stream, whose checkpoint numbers the batches."""
    ckpt = checkpoint or shared_path(stream.sparkSession, "streams", "observation_log")

    def append(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch.withColumn("ingest_ts", F.current_timestamp()), batch_id, log_path, "obs_date")

    writer = stream.writeStream.foreachBatch(append).outputMode("append").option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


_COMMIT = "batch_id long, folder string, committed long"


def append_batch(batch: DataFrame, batch_id: int, log_path: str, *partition_by: str) -> None:
    """One attempt at a batch: its rows in a new folder, then the commit."""
    folder = f"{batch_id}_{uuid.uuid4().hex}"
    batch.write.partitionBy(*partition_by).parquet(f"{log_path}/batch_id={folder}")
    record = batch.sparkSession.createDataFrame([(batch_id, folder, time.time_ns())], _COMMIT).coalesce(1)
    record.write.mode("append").json(f"{log_path}/_commits/n={batch_id}")


def _committed(spark: SparkSession, log_path: str, after: int = -1, upto: int | None = None) -> dict[int, str]:
    """The folder of each committed batch, of its last commit: one entry a
    batch.  A commit without a folder names one called as the batch."""
    n = F.col("batch_id")
    try:
        commits = spark.read.schema(_COMMIT).json(f"{log_path}/_commits").where(n > after)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    if upto is not None:
        commits = commits.where(n <= upto)
    last = commits.groupBy("batch_id").agg(F.max_by(F.coalesce("folder", n.cast("string")), F.struct("committed", "folder")).alias("folder"))
    return {r["batch_id"]: r["folder"] for r in last.collect()}


def last_batch(spark: SparkSession, log_path: str) -> int:
    """The last committed batch of a log (-1: none yet)."""
    return max(_committed(spark, log_path), default=-1)


def read_log(
    spark: SparkSession, log_path: str, schema: T.StructType | None = None, after: int = -1, upto: int | None = None, batch_as: str | None = None
) -> DataFrame:
    """Log rows of the committed batches after ``after`` up to ``upto``
    (default: the last one), with the batch's number if ``batch_as`` names a
    column for it.  Other folders are pruned."""
    folders = _committed(spark, log_path, after, upto)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.StringType())]) if "batch_id" not in schema.fieldNames() else schema)
    folder = F.col("batch_id").cast("string")
    rows = reader.parquet(log_path).where(folder.isin(list(folders.values())))
    if batch_as is not None:
        rows = rows.withColumn(batch_as, F.substring_index(folder, "_", 1).cast("long"))
    return rows.drop("batch_id")


def _snapshot(spark: SparkSession, manifest: str, like: DataFrame, days: list | None = None) -> DataFrame:
    """Rows of a compacted snapshot; with ``days`` only of those days."""
    folders = [r for r in spark.read.schema(_MANIFEST).json(manifest).collect() if days is None or r["obs_date"] in days]
    if not folders:
        return like.limit(0)
    rows = [spark.read.parquet(f) for f in sorted({r["folder"] for r in folders})]
    wanted = {f: [r["obs_date"] for r in folders if r["folder"] == f] for f in sorted({r["folder"] for r in folders})}
    parts = [df.where(F.col("obs_date").cast("string").isin(wanted[f])) for f, df in zip(wanted, rows)]
    return union_all_by_name(*parts)


_MANIFEST = "obs_date string, folder string"


def current_observations(
    spark: SparkSession,
    log_path: str,
    schema: T.StructType | None = None,
    now=None,
    ttl_hours: int | None = None,
    compacted: tuple[str, int] | None = None,
) -> DataFrame:
    """The store as of now: newest write per (place, hour) from the log;
    with ``now`` and ``ttl_hours`` only snapshots young enough count (ST3).

    With ``compacted`` = (manifest, batch) from ``compact_log``, the snapshot
    stands for the batches up to that one, and the read scans it plus the
    batches since instead of the whole history."""
    if compacted is None:
        rows = read_log(spark, log_path, schema)
    else:
        manifest, cut = compacted
        recent = read_log(spark, log_path, schema, after=cut)
        rows = _snapshot(spark, manifest, recent).unionByName(recent, allowMissingColumns=True)
    if now is not None and ttl_hours is not None:
        rows = fresh_only(rows, now, "snapshot_ts", ttl_hours)
    return latest_per_key(rows, order=LOG_ORDER)


def compact_log(
    spark: SparkSession, log_path: str, previous: tuple[str, int] | None = None, target: str | None = None
) -> tuple[str, int]:
    """Fold the batches committed since ``previous`` into a new snapshot.
    Returns (manifest, batch): the manifest names a folder for each day, and
    ``batch`` is the last one folded in.  Days without new rows keep the
    folder they have; the others are written anew, newest write per key."""
    base = target or shared_path(spark, "observation_snapshots")
    cut = last_batch(spark, log_path)
    recent = read_log(spark, log_path, after=previous[1] if previous else -1, upto=cut)
    days = sorted(str(r["obs_date"]) for r in recent.select("obs_date").distinct().collect())  # one row a day
    kept = []
    rows = recent
    if previous:
        kept = [(r["obs_date"], r["folder"]) for r in spark.read.schema(_MANIFEST).json(previous[0]).collect() if r["obs_date"] not in days]
        rows = _snapshot(spark, previous[0], recent, days).unionByName(recent, allowMissingColumns=True)
    write_snapshot(latest_per_key(rows, order=LOG_ORDER), f"{base}/days")
    entries = kept + [(d, f"{base}/days") for d in days]
    spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.json(f"{base}/manifest")
    return f"{base}/manifest", cut


def start_scoring(
    model: PipelineModel | TreeModel,
    stream: DataFrame,
    out_path: str,
    keep=("row_id",),
    checkpoint: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """ST2: stateless scoring of arriving scenarios, appended to ``out_path``."""
    from wearcast.operators.model import apply_model

    pred = apply_model(model, stream)
    cols = [c for c in keep if c in pred.columns] + [c for c in pred.columns if c.startswith("pred_")]
    ckpt = checkpoint or shared_path(stream.sparkSession, "streams", "scoring")
    writer = pred.select(*cols).writeStream.format("parquet").outputMode("append").option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(out_path)
