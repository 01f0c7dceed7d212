"""Polled device logs as streams: duplicates, change points, latest snapshot."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.logs import evaluate


def stream_dedupe(stream: DataFrame, delay: str, key: tuple[str, ...] = ("project", "device", "ts")) -> DataFrame:
    """Rows of a stream without repeats of ``key`` within the watermark. The first
    record wins, where a batch over a whole log keeps the last; rows later than
    ``delay`` are dropped."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(key))


def stream_changes(stream: DataFrame, delay: str, idle: str = "1 day") -> DataFrame:
    """Change points of each device. The state is its last record; it is dropped
    when the device was silent for ``idle`` past the watermark, and the device's
    next record then counts as a first one. Rows of a micro-batch are put in time
    order, rows older than the state are passed over."""
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def changes(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        # a device has few rows in a micro-batch, so plain tuples are put in order
        rows = sorted((r for b in batches for r in zip(b["ts"], b["seq"], b["value_num"], b["value_type"], strict=True)), key=lambda r: (r[0] is pd.NaT, *r[:2]))
        last = state.get if state.exists else None
        out = []
        for ts, _, value, kind in rows:
            at = ts.value
            if last is not None and at <= last[0]:
                continue
            if last is not None and (value != last[1] or kind != last[2]):
                out.append((*key, ts, value, kind, last[1], last[2]))
            last = (at, value, kind)
        if last is not None:
            state.update(last)
            state.setTimeoutTimestamp(max(last[0] // 1_000_000, state.getCurrentWatermarkMs()) + idle_ms)
        if out:
            yield pd.DataFrame(out, columns=["project", "device", "ts", "value_num", "value_type", "previous", "previous_type"])

    return (
        stream.withWatermark("ts", delay)
        .groupBy("project", "device")
        .applyInPandasWithState(changes, "project string, device string, ts timestamp, value_num double, value_type string, previous double, previous_type string", "at long, value double, kind string", "append", GroupStateTimeout.EventTimeTimeout)
    )


def latest(records: DataFrame) -> DataFrame:
    """Each device's latest record."""
    return records.groupBy("project", "device").agg(F.max_by(F.struct("ts", "seq", "value_num", "value_type"), F.struct("ts", "seq")).alias("r")).select("project", "device", "r.*")


#: The state store that keyed states with timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RECORD = "project string, device string, ts timestamp, seq long, value_num double, value_type string"
#: Parts of the snapshot, so that a lookup of some devices reads some of its files.
BUCKETS = 32


class LatestRecord(StatefulProcessor):
    """Keeps a device's last record and passes on one that changes its value or type.

    With ``idle_ms``, a device that was silent so long past the watermark gives a
    record without a value, once; its next record then is a change again.
    """

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, seq long, value double, kind string, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get() if self.last.exists() else None
        new = last
        for batch in rows:
            for r in batch.itertuples(index=False):
                at = (r.ts.value // 1000, int(r.seq))
                if new is None or at > tuple(new[:2]):
                    new = (*at, None if pd.isna(r.value_num) else float(r.value_num), r.value_type, True)
        if new is last:
            return
        self.last.update(new)
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(max(new[0] // 1000, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        if last is None or not last[4] or last[2] != new[2] or last[3] != new[3]:
            yield self._row(key, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, seq, *_ = self.last.get()
        self.last.update((at, seq, None, "silent", False))
        yield self._row(key, (at, seq, None, "silent"))

    def close(self) -> None:
        pass

    @staticmethod
    def _row(key, r) -> pd.DataFrame:
        return pd.DataFrame({"project": [key[0]], "device": [key[1]], "ts": [pd.Timestamp(r[0], unit="us")], "seq": [r[1]], "value_num": pd.Series([r[2]], dtype="float64"), "value_type": [r[3]]})


def stream_latest(stream: DataFrame, delay: str, idle: str | None = None) -> DataFrame:
    """The records of a stream that change a device's value or type, and with ``idle`` a
    record without a value for a device that fell silent. The state is one record
    a device. A micro-batch gives a device at most one record, its latest; records
    older than the state are passed over. The session's state store must be
    ``STORE``."""
    idle_ms = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = stream.withWatermark("ts", delay).select("project", "device", "ts", "seq", "value_num", "value_type")
    return rows.groupBy("project", "device").transformWithStateInPandas(LatestRecord(idle_ms), RECORD, "append", "EventTime")


def stream_newest(stream: DataFrame) -> DataFrame:
    """The latest record of each device that a micro-batch names, for output mode
    ``update``. The state is one record a device, kept by Spark's own aggregation, so a
    device costs no call of Python; records older than the state change nothing."""
    value = F.when(~F.isnan("value_num"), F.col("value_num")).alias("value_num")
    return stream.groupBy("project", "device").agg(F.max_by(F.struct("ts", "seq", value, "value_type"), F.struct("ts", "seq")).alias("r")).select("project", "device", "r.*")


def read_snapshot(spark: SparkSession, folder: str, upto: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """Each device's last change below ``folder``, of the micro-batches up to ``upto`` and
    the given buckets."""
    rows = spark.read.schema(f"{RECORD}, bucket int, batch long").option("recursiveFileLookup", "false").parquet(f"{folder}/changes")
    if upto is not None:
        rows = rows.where(F.col("batch") <= upto)
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(buckets))
    return rows.groupBy("project", "device").agg(F.max_by(F.struct("ts", "seq", "value_num", "value_type"), "batch").alias("r")).select("project", "device", "r.*")


def read_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Each output's last verdict below ``folder``."""
    rows = spark.read.parquet(f"{folder}/verdicts")
    key = ["project", "lddb", "pos", "out_device"]
    return rows.groupBy(*key).agg(F.max_by(F.struct("state", "branches"), "batch").alias("r")).select(*key, "r.*")


def stream_snapshot(stream: DataFrame, cond: DataFrame, folder: str, checkpoint: str, delay: str = "0 seconds", idle: str | None = None, threshold: float = 0.0):
    """Keeps each device's latest value, and each output's verdict under these, below
    ``folder``, and returns the started query.

    The state is one record a device; with ``idle`` it also tells which devices fell
    silent and leaves out what comes later than ``delay``. A micro-batch adds changed
    devices to
    ``changes/batch=n/bucket=k`` and judges only outputs whose conditions hold one
    of them, from the literals of these outputs and the buckets of their devices;
    the first one judges all. Nothing that is there is written again, but a
    repeated micro-batch replaces its own folders. A value is on above
    ``threshold``. ``read_snapshot`` and ``read_verdicts`` give the current state.
    """
    key = ["project", "lddb", "pos", "out_device"]
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    bucket = F.pmod(F.xxhash64("project", "device"), F.lit(BUCKETS)).cast("int")

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        path = f"{folder}/changes/batch={number}"
        if idle is None and number > 0:
            # the state passes on every device of the micro-batch
            told = read_snapshot(session, folder, number - 1).select("project", "device", F.struct("value_num", "value_type").alias("told"))
            same = F.col("told").eqNullSafe(F.struct("value_num", "value_type"))
            batch = batch.join(told, ["project", "device"], "left").where(~same).drop("told")
        batch.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        changed = session.read.schema(f"{RECORD}, bucket int").parquet(path).select("project", "device")
        touched = cond
        if number > 0:
            if changed.isEmpty():
                return
            touched = cond.join(cond.join(changed, ["project", "device"], "left_semi").select(*key).distinct(), key, "left_semi")
        asked = touched.select("project", "device").distinct().withColumn("bucket", bucket)
        needed = sorted(r.bucket for r in asked.select("bucket").distinct().collect())  # at most BUCKETS
        values = read_snapshot(session, folder, number, needed).join(asked.select("project", "device"), ["project", "device"], "left_semi")
        on = F.when(F.col("value_num").isNotNull(), (F.col("value_num") > threshold).cast("double"))
        evaluate(touched, values.select("project", "device", on.alias("value_num"))).write.mode("overwrite").parquet(f"{folder}/verdicts/batch={number}")

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        rows, mode = (stream_newest(stream), "update") if idle is None else (stream_latest(stream, delay, idle), "append")
        return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    finally:
        # the query keeps its own copy of the session's settings
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run_to_table(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there now and reads back what it wrote."""
    query = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)
