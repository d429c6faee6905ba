"""Task graphs as edge tables over many workflows at once.

tasks: workflow_id, place (order of declaration), task_id, depends_on (array). Levels and reachability take a number
of rounds that grows with the logarithm of the depth: paths of 2, 4, 8 ... edges are joined with each other, so a chain
of 10,000 tasks takes 14 rounds and no depth is out of reach. Only what depends on the order of declaration inside one
workflow (first-in-first-out order, the path of a cycle) runs per workflow in Python, on the definition of that one
workflow, which is as small as what a user submits in one piece.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.storage import removed, stored


def dependencies(tasks: DataFrame) -> DataFrame:
    """workflow_id, task_id, dep, of all named dependencies, with their places."""
    return tasks.select("workflow_id", "place", "task_id", F.posexplode("depends_on").alias("dep_place", "dep"))


def first_tasks(tasks: DataFrame) -> DataFrame:
    """The first task of each id; later ones of the same id are errors and take part in nothing else."""
    return tasks.withColumn("_n", F.row_number().over(W.partitionBy("workflow_id", "task_id").orderBy("place"))).where("_n = 1").drop("_n")


def edges(tasks: DataFrame) -> DataFrame:
    """workflow_id, task_id, dep: distinct dependencies on other, known tasks."""
    first = first_tasks(tasks)
    known = first.select("workflow_id", F.col("task_id").alias("dep"))
    return dependencies(first).where("dep <> task_id").select("workflow_id", "task_id", "dep").distinct().join(known, ["workflow_id", "dep"], "left_semi").select("workflow_id", "task_id", "dep")


def structure_errors(tasks: DataFrame) -> DataFrame:
    """workflow_id, rank, error: duplicate ids first, then self and unknown dependencies by task. Cycles are in `orders`."""
    seen = F.row_number().over(W.partitionBy("workflow_id", "task_id").orderBy("place"))
    twice = tasks.withColumn("_n", seen).where("_n > 1").select("workflow_id", F.struct(F.lit(0).alias("a"), F.col("place").alias("b"), F.lit(0).alias("c")).alias("key"), F.concat(F.lit("duplicate task id '"), "task_id", F.lit("'")).alias("error"))
    known = tasks.select("workflow_id", F.col("task_id").alias("dep"), F.lit(True).alias("known")).distinct()
    deps = dependencies(tasks).join(known, ["workflow_id", "dep"], "left")
    text = F.when(F.col("dep") == F.col("task_id"), F.concat(F.lit("task '"), "task_id", F.lit("' depends on itself"))).when(
        F.col("known").isNull(), F.concat(F.lit("task '"), "task_id", F.lit("' depends on unknown task '"), "dep", F.lit("'"))
    )
    wrong = deps.select("workflow_id", F.struct(F.lit(1).alias("a"), F.col("place").alias("b"), F.col("dep_place").alias("c")).alias("key"), text.alias("error")).where("error IS NOT NULL")
    rank = F.row_number().over(W.partitionBy("workflow_id").orderBy("key"))
    return twice.union(wrong).select("workflow_id", rank.alias("rank"), "error")


def in_degrees(tasks: DataFrame) -> DataFrame:
    """workflow_id, task_id, in_degree, out_degree of all tasks."""
    e = edges(tasks)
    into = e.groupBy("workflow_id", "task_id").agg(F.count(F.lit(1)).alias("in_degree"))
    out = e.groupBy("workflow_id", F.col("dep").alias("task_id")).agg(F.count(F.lit(1)).alias("out_degree"))
    keys = ["workflow_id", "task_id"]
    return first_tasks(tasks).select(*keys).join(into, keys, "left").join(out, keys, "left").fillna(0, ["in_degree", "out_degree"])


def roots(tasks: DataFrame) -> DataFrame:
    return first_tasks(tasks).select("workflow_id", "task_id").join(edges(tasks), ["workflow_id", "task_id"], "left_anti")


def ready(tasks: DataFrame, states: DataFrame) -> DataFrame:
    """Pending tasks (by states: workflow_id, task_id, status) all of whose dependencies have succeeded."""
    keys = ["workflow_id", "task_id"]
    done = states.where("status = 'SUCCEEDED'").select("workflow_id", F.col("task_id").alias("dep"))
    waiting = edges(tasks).join(done, ["workflow_id", "dep"], "left_anti").select(*keys).distinct()
    touched = states.where("status <> 'PENDING'").select(*keys)
    return first_tasks(tasks).select(*keys).join(touched, keys, "left_anti").join(waiting, keys, "left_anti")


def _longest_chain(e: DataFrame) -> int:
    """More edges than any path without a repeated task has."""
    return (e.groupBy("workflow_id").agg(F.countDistinct("task_id").alias("n")).agg(F.max("n")).collect()[0][0] or 0) + 1


def levels(tasks: DataFrame) -> DataFrame:
    """workflow_id, task_id, level: length of the longest path to a root. Tasks in or behind a cycle have none.

    walks[k] holds who can be reached by exactly 2^k edges. A path of some length has parts of every smaller one, so a task's
    level is found bit by bit from the longest walks down. Walks longer than a workflow has tasks go round a cycle.
    """
    keys = ["workflow_id", "task_id"]
    walks = [stored(edges(tasks), "dag-walks")]
    most = _longest_chain(walks[0])
    ahead = lambda w: w.select("workflow_id", F.col("task_id").alias("dep"), F.col("dep").alias("further"))
    step = lambda left, right: left.join(ahead(right), ["workflow_id", "dep"]).select(*keys, F.col("further").alias("dep")).distinct()
    all_tasks = first_tasks(tasks).select(*keys)
    while not walks[-1].isEmpty():
        if 2 ** (len(walks) - 1) > most:
            # Who still walks is in or behind a cycle: it has no level, and neither path to it is needed any more.
            endless = stored(walks[-1].select(*keys).distinct(), "dag-endless")
            all_tasks = all_tasks.join(endless, keys, "left_anti")
            walks = [stored(w.join(endless, keys, "left_anti"), "dag-walks") for w in walks[:-1]]
            break
        walks.append(stored(step(walks[-1], walks[-1]), "dag-walks"))
    at = all_tasks.select(*keys, F.col("task_id").alias("dep"), F.lit(0).cast("long").alias("level"))
    for k in range(len(walks) - 1, -1, -1):
        further = at.join(ahead(walks[k]), ["workflow_id", "dep"]).select(*keys, F.col("further").alias("dep"), (F.col("level") + 2**k).alias("level")).distinct()
        further = stored(further, "dag-levels")
        at = stored(further.unionByName(at.join(further.select(*keys), keys, "left_anti")), "dag-levels")
    return at.select(*keys, "level").distinct()


def downstream(tasks: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """workflow_id, task_id, reached: all tasks that depend on a task, directly or not, without the task itself; of: only for these (workflow_id, task_id)."""
    found = stored(edges(tasks).select("workflow_id", F.col("dep").alias("task_id"), F.col("task_id").alias("reached")), "dag-closure")
    n = found.count()
    while True:
        # Paths so far are joined with each other, so their greatest length doubles.
        on = found.select("workflow_id", F.col("task_id").alias("reached"), F.col("reached").alias("further"))
        longer = found.join(on, ["workflow_id", "reached"]).select("workflow_id", "task_id", F.col("further").alias("reached"))
        more = stored(found.union(longer).distinct(), "dag-closure")
        removed(found)
        found, before, n = more, n, more.count()
        if n == before:
            break
    found = found.where("task_id <> reached")
    return found if of is None else found.join(of.select("workflow_id", "task_id").distinct(), ["workflow_id", "task_id"], "left_semi")


def order_or_cycle(names: list[str], deps: list[list[str]]) -> tuple[list[str], list[str]]:
    """First-in-first-out topological order by declaration, and a cycle's path ([] if there is none)."""
    known: dict[str, list[str]] = {}
    for name, ds in zip(names, deps):
        known.setdefault(name, ds)
    waits = {n: {d for d in ds if d != n and d in known} for n, ds in known.items()}
    followers: dict[str, list[str]] = {n: [] for n in known}
    for n, ds in waits.items():
        for d in ds:
            followers[d].append(n)
    place = {n: i for i, n in enumerate(known)}
    for f in followers.values():
        f.sort(key=place.__getitem__)
    left = {n: len(ds) for n, ds in waits.items()}
    queue, order = deque(n for n in known if not left[n]), []
    while queue:
        order.append(n := queue.popleft())
        for f in followers[n]:
            left[f] -= 1
            if not left[f]:
                queue.append(f)
    if len(order) == len(known):
        return order, []
    # Every task that is left waits for another one that is left: the first such dependencies lead into a cycle.
    left_over = known.keys() - set(order)
    onward = {n: next(d for d in known[n] if d in left_over and d in waits[n]) for n in left_over}
    met: dict[str, int] = {}
    at = next(n for n in known if n in left_over)
    while at not in met:
        met[at] = len(met)
        at = onward[at]
    return order, [*list(met)[met[at] :], at]


def _per_workflow(tasks: DataFrame, one, schema: str) -> DataFrame:
    """`one` for each workflow's definition (place, task_id, depends_on in order of place), in one pandas group per definition."""
    kind = tasks.schema["workflow_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        out = one(*order_or_cycle(pdf["task_id"].tolist(), [list(d) if d is not None else [] for d in pdf["depends_on"]]))
        out.insert(0, "workflow_id", pdf["workflow_id"].iloc[0])
        return out

    return tasks.select("workflow_id", "place", "task_id", "depends_on").groupBy("workflow_id").applyInPandas(run, f"workflow_id {kind}, {schema}")


def orders(tasks: DataFrame) -> DataFrame:
    """workflow_id, position (from 0), task_id: first-in-first-out topological order, as far as it comes where there is a cycle."""
    return _per_workflow(tasks, lambda order, _: pd.DataFrame({"position": pd.Series(range(len(order)), dtype="int64"), "task_id": pd.Series(order, dtype=object)}), "position long, task_id string")


def cycles(tasks: DataFrame) -> DataFrame:
    """workflow_id, position (from 0), task_id along the path of a cycle, whose first task comes again at the end; workflows without a cycle have no rows."""
    return _per_workflow(tasks, lambda _, cycle: pd.DataFrame({"position": pd.Series(range(len(cycle)), dtype="int64"), "task_id": pd.Series(cycle, dtype=object)}), "position long, task_id string")
