"""Recommendation-task queue work: task lifecycle from events (R15), queue
positions (W6) and the resume batch (W7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Task statuses; QUEUED and RUNNING are the active ones.
QUEUED, RUNNING, DONE, FAILED, CANCELLED = "QUEUED", "RUNNING", "DONE", "FAILED", "CANCELLED"
ACTIVE = (QUEUED, RUNNING)
FINISHED = (DONE, FAILED)


def task_state(task_events: DataFrame) -> DataFrame:
    """Events (task_id, event_id, ts, status[, error, result_text]) ->
    one row per task: latest status (by ts, event_id, then status), created_at (first
    QUEUED), started_at (last RUNNING), finished_at (when the latest status
    is DONE/FAILED) and ``active``. One aggregation, partial before the
    shuffle."""
    # status is the last tie-breaker: events may repeat (ts, event_id)
    order = F.struct("ts", "event_id", "status")
    extra = [c for c in ("error", "result_text") if c in task_events.columns]
    agg = task_events.groupBy("task_id").agg(
        F.max_by("status", order).alias("status"),
        F.max(order).alias("_last"),
        F.min(F.when(F.col("status") == QUEUED, F.col("ts"))).alias("created_at"),
        F.max(F.when(F.col("status") == RUNNING, F.col("ts"))).alias("started_at"),
        *[F.max_by(c, order).alias(c) for c in extra])
    return (agg.withColumn("finished_at", F.when(F.col("status").isin(*FINISHED), F.col("_last.ts")))
            .withColumn("active", F.col("status").isin(*ACTIVE)).drop("_last"))


def active_queue(tasks: DataFrame) -> DataFrame:
    """QUEUED/RUNNING tasks per chat numbered from 1 by created_at (task
    id breaks ties)."""
    w = Window.partitionBy("chat_id").orderBy(F.asc("created_at"), F.asc("task_id"))
    return (tasks.filter(F.col("status").isin(*ACTIVE))
            .withColumn("position", F.row_number().over(w)))


def resume_batch(tasks: DataFrame, n: int = 100) -> DataFrame:
    """The oldest ``n`` active tasks; RUNNING ones go back to QUEUED with
    started_at cleared (a bounded TakeOrderedAndProject)."""
    top = (tasks.filter(F.col("status").isin(*ACTIVE))
           .orderBy(F.asc("created_at"), F.asc("task_id")).limit(n))
    running = F.col("status") == RUNNING
    return (top.withColumn("started_at", F.when(running, F.lit(None)).otherwise(F.col("started_at")))
            .withColumn("status", F.when(running, F.lit(QUEUED)).otherwise(F.col("status"))))
