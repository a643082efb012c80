"""Stream drivers: the task-queue stream (T3), the message-log append (T4),
and a runner that drives a stream over a finished input to completion
(``availableNow``) -- how the batch form of each stream is produced."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marquee.operators.history import cap_message_text
from marquee.operators.tasks import ACTIVE, FINISHED, QUEUED, RUNNING
from marquee.session import keyed_state, scratch_path, ship_package
from marquee.sources.ledger import create_ledger, epoch_writer, read_ledger


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run under the shared checkpoint folder."""
    return scratch_path(spark, f"streams/{name}-{uuid.uuid4().hex[:12]}")


def materialize_input(df: DataFrame, path: str, files: int = 8) -> None:
    """Write a table as several files so a file stream replays it in slices."""
    df.repartition(files).write.mode("overwrite").parquet(path)


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(path))


def run_to_parquet(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Drive a stream over everything available, writing a parquet table."""
    with keyed_state(stream.sparkSession):
        q = (stream.writeStream.format("parquet").option("path", out)
             .option("checkpointLocation", checkpoint).outputMode(mode)
             .trigger(availableNow=True).start())
    q.awaitTermination()


def run_foreach_batch(stream: DataFrame, fn, checkpoint: str, mode: str = "append") -> None:
    with keyed_state(stream.sparkSession):
        q = (stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
             .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()


_TIMES = ("created_at", "started_at", "finished_at")
TASK_SCHEMA = ("task_id long, status string, created_at timestamp, started_at timestamp, finished_at timestamp, "
               "error string, result_text string, version long")
_TASK = [f.split(" ")[0] for f in TASK_SCHEMA.split(", ")]


class TaskFold(StatefulProcessor):
    """One task's lifecycle as a mergeable fold: the latest event by (ts,
    event_id, status), the first QUEUED, the last RUNNING. Events that were
    folded before, or that come late, leave it as it is; a row is emitted only
    when it changed. Finished tasks are forgotten ``expire_ms`` later."""

    def __init__(self, expire_ms: int | None):
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle_of = handle
        self.task = handle.getValueState("task", "status string, at long, event_id long, created long, started long, "
                                                 "error string, result_text string, version long")

    def handleInputRows(self, key, rows, timerValues):
        held = self.task.get()
        status, ts, event_id, created, started, error, result, version = held or (None,) * 7 + (0,)
        before = (status, ts, event_id, created, started)
        for r in rows:
            if ts is None or (r["at"], r["event_id"], r["status"]) > (ts, event_id, status):
                status, ts, event_id, error, result = r["status"], r["at"], r["event_id"], r["error"], r["result_text"]
            if r["status"] == QUEUED:
                created = r["at"] if created is None else min(created, r["at"])
            elif r["status"] == RUNNING:
                started = r["at"] if started is None else max(started, r["at"])
        if (status, ts, event_id, created, started) == before:
            return
        version += 1
        self.task.update((status, ts, event_id, created, started, error, result, version))
        finished = ts if status in FINISHED else None
        if finished is not None and self.expire_ms is not None:
            self.handle_of.registerTimer(ts // 1000 + self.expire_ms)
        yield Row(**dict(zip(_TASK, (key[0], status, created, started, finished, error, result, version))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self.task.get()
        if held and held[0] in FINISHED and held[1] // 1000 + self.expire_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.task.clear()
        return iter(())

    def close(self) -> None:
        pass


def _folded(rows: DataFrame) -> DataFrame:
    """:class:`TaskFold` as a streaming aggregation (update mode). Each row has
    its batch's time; each part of the fold keeps the time of the batch that
    brought it first, so a task is emitted when one of them is of this batch."""
    now = F.col("now")
    parts = rows.withColumn("now", F.unix_micros(F.current_timestamp())).groupBy("task_id").agg(
        F.max(F.struct("at", "event_id", "status", (-now).alias("seen"), "error", "result_text")).alias("last"),
        F.min(F.when((F.col("status") == QUEUED) & F.col("at").isNotNull(), F.struct("at", now.alias("seen")))).alias("first"),
        F.max(F.when((F.col("status") == RUNNING) & F.col("at").isNotNull(), F.struct("at", (-now).alias("seen")))).alias("run"),
        F.max("now").alias("now"))
    version = F.greatest(-F.col("last.seen"), F.col("first.seen"), -F.col("run.seen"))
    return parts.where(version == F.col("now")).select(
        "task_id", "last.status", F.col("first.at").alias("created_at"), F.col("run.at").alias("started_at"),
        F.when(F.col("last.status").isin(*FINISHED), F.col("last.at")).alias("finished_at"), "last.error", "last.result_text",
        version.alias("version"))


def task_changes(events: DataFrame, expire_days: int | None = None) -> DataFrame:
    """A stream of task events (task_id, event_id, ts, status[, error,
    result_text]) to the task rows they change, each with a growing
    ``version``. With ``expire_days`` the stream is watermarked by it and the
    state of finished tasks goes that long after their end (a timer of
    :class:`TaskFold`); without, no task is forgotten and the fold is an
    aggregation, to be run in update mode."""
    text = [F.col(c) if c in events.columns else F.lit(None).cast("string").alias(c) for c in ("error", "result_text")]
    rows = events.select(F.col("task_id").cast("long"), F.col("event_id").cast("long"),
                         F.col("ts").cast("timestamp").alias("ts"), "status", *text)
    rows = rows.withColumn("at", F.unix_micros("ts"))
    if expire_days is None:
        changed = _folded(rows)
    else:
        ship_package(events.sparkSession)
        changed = rows.withWatermark("ts", f"{expire_days} days").groupBy("task_id").transformWithState(
            TaskFold(expire_days * 86_400_000), TASK_SCHEMA.replace("timestamp", "long"), "Update", "EventTime")
    return changed.select(*[F.timestamp_micros(c).alias(c) if c in _TIMES else F.col(c) for c in _TASK])


def current_tasks(spark: SparkSession, path: str) -> DataFrame:
    """The latest row of each task in a table of changes, and whether it is
    active."""
    rows = read_ledger(spark, path, TASK_SCHEMA)
    last = rows.groupBy("task_id").agg(F.max_by(F.struct(*_TASK[1:]), "version").alias("t")).select("task_id", "t.*")
    return last.withColumn("active", F.col("status").isin(*ACTIVE))


def task_stream(spark: SparkSession, events_stream: DataFrame, path: str, checkpoint: str,
                expire_days: int | None = None) -> DataFrame:
    """Fold the event stream into a table of task changes, each epoch once;
    a batch costs what its own tasks cost. Returns the current tasks."""
    create_ledger(spark, path, TASK_SCHEMA)
    run_foreach_batch(task_changes(events_stream, expire_days), epoch_writer(path), checkpoint,
                      "update" if expire_days is None else "append")
    return current_tasks(spark, path)


def append_messages(stream: DataFrame, out: str, checkpoint: str) -> None:
    """T4: message log append, text cut at 2,000 chars, stamped on arrival."""
    run_to_parquet(cap_message_text(stream).withColumn("stored_at", F.current_timestamp()),
                   out, checkpoint)
