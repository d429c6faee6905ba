"""The completeness watermark: through which day all partitions are loaded, without gaps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def advance(runs: DataFrame) -> DataFrame:
    """runs (current, start_day, end_day) with `after`: end_day if there is no current one, or if the run follows on from it and ends later."""
    follows = (F.col("current") >= F.date_sub("start_day", 1)) & (F.col("end_day") > F.col("current"))
    return runs.withColumn("after", F.when(F.col("current").isNull() | follows, F.col("end_day")).otherwise(F.col("current")))


def incremental_window(current: dt.date, today: dt.date, lookback: int = 2, lag: int = 2) -> tuple[dt.date, dt.date]:
    """First and last day of an incremental run."""
    return current - dt.timedelta(lookback - 1), today - dt.timedelta(lag)


def plan_tasks(first: dt.date, last: dt.date, run_id: str) -> list[dict]:
    """The task graph of a run: a plan, a chain of four stages for each day, and a final task behind all chains. Retries and timeouts are fixed by stage."""
    #: Stage, retries, timeout.
    stages = (("extract", 5, "PT90S"), ("validate", 0, "PT2M"), ("transform", 2, "PT2M"), ("load", 3, "PT2M"))
    tasks = [{"id": "plan", "type": "etl.plan", "dependsOn": [], "maxRetries": 3, "timeout": "PT1M"}]
    days = [first + dt.timedelta(n) for n in range((last - first).days + 1)]
    for day in days:
        before = "plan"
        for name, retries, timeout in stages:
            task = f"{name}-{day}"
            tasks.append({"id": task, "type": f"etl.{name}", "dependsOn": [before], "maxRetries": retries, "timeout": timeout, "input": {"run_id": run_id, "date": str(day)}})
            before = task
    tasks.append({"id": "finalize", "type": "etl.finalize", "dependsOn": [f"load-{d}" for d in days], "maxRetries": 3, "timeout": "PT5M", "input": {"run_id": run_id}})
    return tasks
