"""Workflow runs as a user looks at them: faults of a definition, ids of runs, the view of a run, its events, pages of runs."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import dag, eventlog


def run_id(owner: str, key: str | None = None) -> str:
    """The same id for the same owner and key; a random one without a key."""
    if key is None:
        return str(uuid.uuid4())
    return str(uuid.UUID(bytes=hashlib.md5(f"{owner}:{key}".encode()).digest(), version=3))


def errors(definition: dict) -> list[str]:
    """Duplicate ids, then self and unknown dependencies by task, then a cycle. A definition is small: no Spark job."""
    names = [t["id"] for t in definition["tasks"]]
    out, known, seen = [], set(names), set()
    for n in names:
        if n in seen:
            out.append(f"duplicate task id '{n}'")
        seen.add(n)
    for t in definition["tasks"]:
        for d in t.get("dependsOn", []):
            if d == t["id"]:
                out.append(f"task '{d}' depends on itself")
            elif d not in known:
                out.append(f"task '{t['id']}' depends on unknown task '{d}'")
    _, cycle = dag.order_or_cycle(names, [t.get("dependsOn", []) for t in definition["tasks"]])
    return out + ([f"cycle detected (depends on): {' -> '.join(cycle)}"] if cycle else [])


def view(log: DataFrame, definitions: DataFrame, run: str | int) -> DataFrame:
    """The tasks of one run with their states, replayed from its events; tasks without events are pending."""
    one = F.col("workflow_id") == run
    return eventlog.with_pending(eventlog.task_states(log.where(one)), definitions.where(one))


def events(log: DataFrame, run: str | int) -> DataFrame:
    """The events of one run in order."""
    return log.where(F.col("workflow_id") == run).orderBy("sequence")


list_runs = eventlog.page
