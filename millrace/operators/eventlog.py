"""Event logs of workflows: the state of each task and workflow as a fold of its events, and which events break the rules.

A log has workflow_id, sequence, event_type, task_id, attempt, worker_id, error, lease_at, retry_at, output, created_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The status a task gets from an event.
TASK_STATUS = {
    "TaskQueued": "QUEUED", "TaskStarted": "RUNNING", "TaskSucceeded": "SUCCEEDED", "TaskFailed": "RETRY_WAIT",
    "TaskDeadLettered": "DEAD_LETTERED", "TaskSkipped": "SKIPPED",
}
#: Statuses from which an event is legal.
LEGAL_FROM = {
    "TaskQueued": ("PENDING", "RETRY_WAIT"), "TaskStarted": ("QUEUED",), "TaskSucceeded": ("QUEUED", "RUNNING"),
    "TaskFailed": ("QUEUED", "RUNNING"), "TaskDeadLettered": ("QUEUED", "RUNNING"), "TaskSkipped": ("PENDING",),
}
WORKFLOW_STATUS = {"WorkflowStarted": "RUNNING", "WorkflowCompleted": "COMPLETED", "WorkflowFailed": "FAILED", "WorkflowCancelled": "CANCELLED"}


def _lookup(c: Column, table: dict[str, str]) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, v in table.items():
        out = out.when(c == k, F.lit(v))
    return out


def _last(value: Column, where: Column) -> Column:
    """The value in the last event (by sequence) for which `where` holds."""
    return F.max_by(value, F.when(where, F.col("sequence")))


def task_states(log: DataFrame) -> DataFrame:
    """One row per task with events: a fold that needs no order, only the last event of each kind, so it combines on the map side."""
    kind = F.col("event_type")
    events = log.where(kind.isin(*TASK_STATUS))
    at = {k: F.max(F.when(kind == k, F.col("sequence"))) for k in ("TaskQueued", "TaskStarted")}
    folded = events.groupBy("workflow_id", "task_id").agg(
        F.max_by(kind, "sequence").alias("last_type"),
        _last(F.col("attempt"), kind == "TaskQueued").alias("queued_attempt"),
        _last(F.col("created_at"), kind == "TaskQueued").alias("queued_at"),
        _last(F.col("worker_id"), kind == "TaskStarted").alias("worker"),
        _last(F.col("lease_at"), kind == "TaskStarted").alias("lease"),
        _last(F.col("retry_at"), kind == "TaskFailed").alias("retry"),
        _last(F.col("error"), kind.isin("TaskFailed", "TaskDeadLettered", "TaskSkipped")).alias("last_error"),
        _last(F.col("output"), kind == "TaskSucceeded").alias("out"),
        at["TaskQueued"].alias("queued_seq"),
        at["TaskStarted"].alias("started_seq"),
        F.count(F.lit(1)).alias("n_events"),
    )
    last = F.col("last_type")
    held = last.isin("TaskStarted", "TaskSucceeded") & (F.col("started_seq") > F.coalesce("queued_seq", F.lit(-1)))
    return folded.select(
        "workflow_id",
        "task_id",
        _lookup(last, TASK_STATUS).alias("status"),
        F.coalesce("queued_attempt", F.lit(0)).alias("attempt"),
        "queued_at",
        F.when(held, F.col("worker")).alias("worker_id"),
        F.when(last == "TaskStarted", F.col("lease")).alias("lease_at"),
        F.when(last == "TaskFailed", F.col("retry")).alias("retry_at"),
        "last_error",
        F.when(last == "TaskSucceeded", F.col("out")).alias("output"),
        "n_events",
    )


def with_pending(states: DataFrame, definitions: DataFrame) -> DataFrame:
    """States of all defined tasks (workflow_id, task_id): PENDING, attempt 0, where there is no event."""
    out = definitions.select("workflow_id", "task_id").join(states, ["workflow_id", "task_id"], "left")
    return out.withColumns({"status": F.coalesce("status", F.lit("PENDING")), "attempt": F.coalesce("attempt", F.lit(0)), "n_events": F.coalesce("n_events", F.lit(0))})


def workflow_states(log: DataFrame) -> DataFrame:
    """workflow_id, status, version (number of events), created_at, updated_at, finished_at."""
    kind = F.col("event_type")
    status = _lookup(F.max_by(kind, F.when(kind.isin(*WORKFLOW_STATUS), F.col("sequence"))), WORKFLOW_STATUS)
    done = kind.isin("WorkflowCompleted", "WorkflowFailed", "WorkflowCancelled")
    return log.groupBy("workflow_id").agg(status.alias("status"), F.count(F.lit(1)).alias("version"), F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"), F.max(F.when(done, F.col("created_at"))).alias("finished_at"))


def illegal_transitions(log: DataFrame) -> DataFrame:
    """Task events that the event before them does not allow: workflow_id, sequence, task_id, event_type, from_status, why."""
    per_task = W.partitionBy("workflow_id", "task_id").orderBy("sequence")
    kind = F.col("event_type")
    rows = log.where(kind.isin(*TASK_STATUS)).withColumn("from_status", F.coalesce(_lookup(F.lag("event_type").over(per_task), TASK_STATUS), F.lit("PENDING")))
    current = F.coalesce(F.last(F.when(kind == "TaskQueued", F.col("attempt")), True).over(per_task.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("current_attempt", current)
    allowed = F.lit(False)
    for k, froms in LEGAL_FROM.items():
        allowed = allowed | ((kind == k) & F.col("from_status").isin(*froms))
    attempt_ok = F.when(kind == "TaskQueued", F.col("attempt") == F.col("current_attempt") + 1).when(kind == "TaskSkipped", F.lit(True)).otherwise(F.col("attempt") == F.col("current_attempt"))
    why = F.when(~allowed, "status").when(~attempt_ok, "attempt")
    return rows.withColumn("why", why).where("why IS NOT NULL").select("workflow_id", "sequence", "task_id", "event_type", "from_status", "why")


def before_start(log: DataFrame) -> DataFrame:
    """Events before their workflow's first WorkflowStarted, which must be the first event of all: workflow_id, sequence, event_type."""
    start = log.where("event_type = 'WorkflowStarted'").groupBy("workflow_id").agg(F.min("sequence").alias("start_sequence"))
    early = F.col("start_sequence").isNull() | (F.col("sequence") < F.col("start_sequence"))
    return log.join(start, "workflow_id", "left").where(early).select("workflow_id", "sequence", "event_type")


#: Statuses that a task does not leave.
TERMINAL = ("SUCCEEDED", "DEAD_LETTERED", "SKIPPED")


def progress(states: DataFrame) -> DataFrame:
    """workflow_id, all_terminal, any_dead_lettered, succeeded (task ids in order, joined by a comma), from states of tasks."""
    status = F.col("status")
    return states.groupBy("workflow_id").agg(
        F.bool_and(status.isin(*TERMINAL)).alias("all_terminal"),
        F.bool_or(status == "DEAD_LETTERED").alias("any_dead_lettered"),
        F.array_join(F.array_sort(F.collect_set(F.when(status == "SUCCEEDED", F.col("task_id")))), ",").alias("succeeded"),
    )


def running_after_end(log: DataFrame) -> DataFrame:
    """Events of a workflow behind its terminal one."""
    end = log.where(F.col("event_type").isin("WorkflowCompleted", "WorkflowFailed", "WorkflowCancelled")).groupBy("workflow_id").agg(F.min("sequence").alias("end_sequence"))
    return log.join(end, "workflow_id").where(F.col("sequence") > F.col("end_sequence")).select("workflow_id", "sequence", "event_type")


def page(runs: DataFrame, number: int = 0, size: int = 20, status: str | None = None, user: str | None = None, admin: bool = False) -> DataFrame:
    """A page of the runs a user may see, newest first, with total_elements and total_pages. A run without an owner is for admins only."""
    seen = visible(runs, user, admin)
    if status is not None:
        seen = seen.where(F.col("status") == status.upper())
    total = seen.agg(F.count(F.lit(1)).alias("total_elements")).withColumn("total_pages", F.ceil(F.col("total_elements") / size))
    chosen = seen.orderBy(F.col("created_at").desc(), "workflow_id").offset(number * size).limit(size)
    return chosen.join(F.broadcast(total), F.lit(True))


def visible(runs: DataFrame, user: str | None, admin: bool = False) -> DataFrame:
    return runs if admin else runs.where(F.col("owner") == F.lit(user))
