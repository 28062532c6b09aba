"""Review events as a stream: an extension to the event log, for rates while reviewers work, and for what waits too long.

`keep_state` rewrites a table of the whole queue in each batch, `watched` keeps each record's state in the state store
and only touches records that have events or whose time has come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from termweave.operators.review import EVENT, queue_state


def events(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """The stream of events that are appended to a folder as JSON lines; an event that comes twice counts once."""
    rows = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return rows.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"])


def action_rates(stream: DataFrame, width: str = "1 day") -> DataFrame:
    """Counts by window and action; late events are taken until the watermark passes."""
    rows = stream.filter("kind = 'DECIDE'")
    return rows.groupBy(F.window("ts", width).alias("w"), "action").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "action", "n")


def keep_state(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Maintain the queue's latest state as a table: each batch is merged with what was there and written beside it."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        before = sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(hadoop)) if fs.exists(hadoop) else []
        before = [b for b in before if b < number]
        own = batch.select(*[c.split()[0] for c in EVENT.split(", ")])
        rows = own if not before else own.unionByName(spark.read.parquet(f"{path}/batch={before[-1]}"))
        # The latest event of each record, and its latest enqueueing, are all that the state needs
        latest = rows.groupBy("record_id").agg(F.max_by(F.struct(*own.columns), F.struct("ts", "event_id")).alias("a"), F.max_by(F.struct(*own.columns), F.struct((F.col("kind") == "ENQUEUE"), "ts", "event_id")).alias("b"))
        kept = latest.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("e")).select("e.*")
        kept.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state_table(spark: SparkSession, path: str) -> DataFrame:
    """The state after the last batch."""
    rows = spark.read.parquet(path)
    last = rows.agg(F.max("batch").alias("b")).first()["b"]
    return queue_state(rows.filter(F.col("batch") == last).drop("batch"))


WATCHED = "record_id string, status string, action string, selected_code string, created_at timestamp, updated_at timestamp, n_decisions long, alert string"
#: The state store that timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Watch(StatefulProcessor):
    """The state of one record: its latest event decides, late ones only count; a timer stands while it is pending or escalated."""

    def __init__(self, pending_ms: int, escalated_ms: int) -> None:
        self.limits = {"PENDING": (pending_ms, "PENDING_TOO_LONG"), "ESCALATED": (escalated_ms, "ESCALATED_TOO_LONG")}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        text, number = StringType(), LongType()
        self.state = handle.getValueState("state", StructType([StructField("status", text), StructField("action", text), StructField("code", text), StructField("ts", number), StructField("event_id", number), StructField("created", number), StructField("n", number)]))
        # Every event id of the record, in the store and not in memory, so that an event that comes twice counts once
        self.seen = handle.getMapState("seen", StructType([StructField("event_id", number)]), StructType([StructField("there", BooleanType())]))

    def row(self, key, state: tuple, alert: str) -> pd.DataFrame:
        status, action, code, ts, _, created, n = state
        at = lambda ms: pd.NaT if ms is None else pd.Timestamp(ms, unit="ms")
        return pd.DataFrame({"record_id": [key[0]], "status": [status], "action": [action], "selected_code": [code], "created_at": [at(created)], "updated_at": [at(ts)], "n_decisions": [n], "alert": [alert]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else None
        changed = False
        for pdf in rows:
            for e in pdf.sort_values(["ts", "event_id"]).itertuples(index=False):
                if self.seen.containsKey((int(e.event_id),)):
                    continue
                self.seen.updateValue((int(e.event_id),), (True,))
                changed = True
                ts = e.ts.value // 1_000_000
                status, action, code, last, last_id, created, n = state or ("", "", "", -1, -1, None, 0)
                n += e.kind == "DECIDE"
                if e.kind == "ENQUEUE":
                    created = ts if created is None else max(created, ts)
                if (ts, e.event_id) > (last, last_id):
                    status = "PENDING" if e.kind == "ENQUEUE" else "ESCALATED" if e.action == "ESCALATE" else "RESOLVED"
                    action, code, last, last_id = e.action, e.selected_code, ts, int(e.event_id)
                state = (status, action, code, last, last_id, created, int(n))
        if changed:
            self.state.update(state)
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if state[0] in self.limits:
                self.handle.registerTimer(state[3] + self.limits[state[0]][0])
            yield self.row(key, state, "")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get())
        if state[0] in self.limits:
            yield self.row(key, state, self.limits[state[0]][1])

    def close(self) -> None:
        pass


def watched(stream: DataFrame, pending_hours: float = 24.0, escalated_hours: float = 72.0, late: str = "1 hour") -> DataFrame:
    """A row for each record whose state has changed (alert is blank), and one where it stayed pending or escalated too long, by the time of events.

    stream: review events. The latest event by (ts, event_id) decides, as in queue_state; later arrivals of older events
    and repeats do not change it. A record that is enqueued or escalated anew starts its time anew. The watermark is
    `late` behind the latest event seen; what comes later still is dropped. Needs the RocksDB state store (STORE),
    which the session has to name before the query starts; write it in update mode.
    """
    rows = stream.withWatermark("ts", late).select(*[c.split()[0] for c in EVENT.split(", ")])
    processor = Watch(int(pending_hours * 3_600_000), int(escalated_hours * 3_600_000))
    return rows.groupBy("record_id").transformWithStateInPandas(processor, outputStructType=WATCHED, outputMode="Update", timeMode="EventTime")
