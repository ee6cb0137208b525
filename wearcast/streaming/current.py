"""ST1, ST3 with keyed state: what holds now per (place, hour), kept by the
stream itself.

The state of a place is the newest observation of each of its live hours.  A
row that is newer replaces it and is emitted once, as a ``set`` change; at the
end of a row's life ``expired`` is emitted and the row dropped.  A place is read
and written once a batch and has one timer, for the first of its rows to end:
every call from Python to the state store costs about as much as ten rows do.
Time is the stream's own: the watermark
trails the newest snapshot by ``ttl_hours``, so a row expires when a snapshot
that much younger has been seen, and rows that arrive expired are dropped as
late.  State is bounded by the keys that are alive, in RocksDB on the executors
and checkpointed with the stream; a place holds a row per live hour.

The changes go to a log of committed batches (``ingest.append_batch``); its
newest change per key is the store, and followers can read the changes
themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from wearcast import schema as S
from wearcast.operators.store import KEYS
from wearcast.session import shared_path
from wearcast.streaming.ingest import LOG_ORDER, append_batch, read_log

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT_TIME = "_at"


def _rank(values: tuple) -> tuple:
    """Values in order, None first."""
    return tuple((v is not None, v) for v in values)


class NewestPerKey(StatefulProcessor):
    """Holds the newest row of every key of a place until its time is over.
    The first of ``keys`` is the place, which the stream is grouped by."""

    def __init__(self, schema: T.StructType, keys: list[str], order: list[str]):
        self.inner, self.names = keys[1:], [f.name for f in schema if f.name not in keys]
        self.first = [self.names.index(c) for c in order]
        self.others = [i for i, n in enumerate(self.names) if n not in order]
        self.out = [*keys, "change", *self.names]
        held = T.StructType([*[schema[n] for n in [*self.inner, *self.names]], T.StructField("_until", T.LongType())])
        self.state_type = T.StructType([T.StructField("rows", T.ArrayType(held))])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", self.state_type)

    def _held(self) -> dict[tuple, tuple]:
        """The live rows by the rest of their key."""
        state, n = self.newest.get(), len(self.inner)
        return {tuple(r)[:n]: tuple(r)[n:] for r in state[0]} if state is not None else {}

    def _store(self, held: dict[tuple, tuple], before: int | None) -> None:
        """Keep ``held``; the timer stood at ``before``."""
        ends = min((row[-1] for row in held.values()), default=None)
        if before != ends and before is not None:
            self.handle.deleteTimer(before)
        if before != ends and ends is not None:
            self.handle.registerTimer(ends)
        if held:
            self.newest.update(([(*k, *row) for k, row in held.items()],))
        else:
            self.newest.clear()

    def _emit(self, place: tuple, rest: tuple, change: str, values: tuple) -> Row:
        return Row(**dict(zip(self.out, [*place, *rest, change, *values])))

    def _newer(self, row: tuple, old: tuple) -> bool:
        for places in (self.first, self.others):
            a, b = _rank([row[i] for i in places]), _rank([old[i] for i in places])
            if a != b:
                return a > b
        return False

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self._held()
        before = min((row[-1] for row in held.values()), default=None)
        changed: dict[tuple, tuple] = {}
        at: list[int] = []
        for r in rows:
            if not at:
                at = [r.__fields__.index(n) for n in [*self.inner, *self.names, EVENT_TIME]]
            values = [r[i] for i in at]
            rest, row = tuple(values[: len(self.inner)]), tuple(values[len(self.inner) :])
            old = changed.get(rest) or held.get(rest)
            if old is None or self._newer(row, old):
                changed[rest] = row
        if changed:
            self._store({**held, **changed}, before)
        for rest, row in changed.items():
            yield self._emit(key, rest, "set", row[:-1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, now = self._held(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        self._store({k: row for k, row in held.items() if row[-1] > now}, None)  # a timer that fires is gone
        for rest, row in held.items():
            if row[-1] <= now:
                yield self._emit(key, rest, "expired", row[:-1])

    def close(self) -> None:
        pass


def current_changes(stream: DataFrame, ttl_hours: int = S.FORECAST_TTL_HOURS, keys=KEYS, order=LOG_ORDER) -> DataFrame:
    """The changes of what holds per key: the keys, ``change`` (``set`` or
    ``expired``) and the row's other columns.  Rows with a NULL ``snapshot_ts``
    have no life and are left out; NULL keys are keys like any other."""
    keys, schema = list(keys), stream.schema
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("snapshot_ts"))
    timed = stream.where("snapshot_ts IS NOT NULL").withColumn("_time", F.timestamp_micros(micros)).withColumn(EVENT_TIME, F.floor(micros / 1000))
    others = [f for f in schema if f.name not in keys]
    out = T.StructType([*[schema[k] for k in keys], T.StructField("change", T.StringType()), *others])
    return (
        timed.withWatermark("_time", f"{ttl_hours} hours")
        .groupBy(keys[0])
        .transformWithState(statefulProcessor=NewestPerKey(schema, keys, list(order)), outputStructType=out, outputMode="Update", timeMode="EventTime")
    )


def start_current(
    stream: DataFrame, path: str, ttl_hours: int = S.FORECAST_TTL_HOURS, checkpoint: str | None = None, available_now: bool = True
) -> StreamingQuery:
    """Keep the store at ``path`` up to date with the observation ``stream``.
    The query runs with the RocksDB state store, which keyed timers need; the
    session's own setting is left as it was."""
    spark = stream.sparkSession
    ckpt = checkpoint or shared_path(spark, "streams", "current")

    def append(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch, batch_id, path, "change")

    before = spark.conf.get(STATE_PROVIDER)
    spark.conf.set(STATE_PROVIDER, ROCKSDB)  # a query copies the settings when it starts
    try:
        writer = current_changes(stream, ttl_hours).writeStream.foreachBatch(append).outputMode("update").option("checkpointLocation", ckpt)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
        return writer.start()
    finally:
        spark.conf.set(STATE_PROVIDER, before)


def read_changes(spark: SparkSession, path: str, after: int = -1) -> DataFrame:
    """The changes of the committed batches after ``after``, with ``batch``."""
    return read_log(spark, path, after=after, batch_as="batch")


def read_current(spark: SparkSession, path: str, keys=KEYS) -> DataFrame:
    """The store as the stream last left it: the newest change of each key,
    where that is a ``set``.  Within a batch an expiry comes last."""
    changes = read_changes(spark, path)
    rest = [c for c in changes.columns if c not in (*keys, "batch", "change")]
    order = [c for c in LOG_ORDER if c in rest]
    rank = F.struct("batch", (F.col("change") == "expired").alias("gone"), *order, *[c for c in rest if c not in order])
    last = changes.groupBy(*keys).agg(F.max(rank).alias("last")).where("NOT last.gone")
    return last.select(*keys, *[F.col("last")[c].alias(c) for c in rest])
