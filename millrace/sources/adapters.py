"""Event logs, runs, task graphs and traces made from the benchmark tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.eventlog import workflow_states
from millrace.sources.raw import table

KINDS = {"view": "TaskQueued", "click": "TaskStarted", "purchase": "TaskSucceeded", "error": "TaskFailed"}


def log_columns(events: DataFrame) -> DataFrame:
    """Events as log rows, without a sequence."""
    e = F.col("event_id")
    kind = F.when(e % 97 == 0, "WorkflowCompleted")
    for k, v in KINDS.items():
        kind = kind.when(F.col("event_type") == k, v)
    kind = kind.otherwise(F.element_at(F.array(F.lit("TaskDeadLettered"), F.lit("TaskSkipped"), F.lit("WorkflowStarted")), (e % 3 + 1).cast("int")))
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    error = F.when(e % 4 == 0, F.concat(text("lease expired (worker w", e % 6), F.lit(")"))).when(e % 4 == 1, text("timed out while waiting for the upstream service, request ", e)).otherwise(F.lit("connection refused"))
    return events.select(
        F.col("user_id").alias("workflow_id"), "event_id", kind.alias("event_type"), text("t", e % 4).alias("task_id"), (e % 3 + 1).cast("int").alias("attempt"),
        text("w", e % 6).alias("worker_id"), error.alias("error"), (F.col("ts") + F.expr("INTERVAL 30 SECONDS")).alias("lease_at"),
        (F.col("ts") + F.expr("INTERVAL 500 MILLISECONDS")).alias("retry_at"), text("out-", e).alias("output"), F.col("ts").alias("created_at"),
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("workflow_id").orderBy("created_at", "event_id"))
    return log_columns(table(spark, sf_dir, "events")).withColumn("sequence", place.cast("long"))


def run_table(log: DataFrame) -> DataFrame:
    """The read model of a log: workflow_states with a name and an owner (none for every eleventh)."""
    w = F.col("workflow_id")
    return workflow_states(log).withColumns({"name": F.concat(F.lit("wf"), (w % 7).cast("string")), "owner": F.when(w % 11 != 0, F.concat(F.lit("u"), (w % 5).cast("string")))})


#: Customers whose keys share a graph, of all nations: no graph has more tasks, whatever the size of the table.
GRAPH = 20_000


def task_graphs(spark: SparkSession, sf_dir: str, faults: bool = False) -> DataFrame:
    """Graphs by nation and stretch of keys over all customers: each task waits for the one at half its place, each fifth also for the one three places up. With faults: ids given twice, unknown and self dependencies."""
    workflow = F.floor(F.col("c_custkey") / GRAPH) * 100 + F.col("c_nationkey")
    c = table(spark, sf_dir, "customer").select(workflow.cast("long").alias("workflow_id"), "c_custkey")
    placed = c.withColumn("place", (F.row_number().over(W.partitionBy("workflow_id").orderBy("c_custkey")) - 1).cast("long")).withColumn("task_id", F.concat(F.lit("c"), F.col("c_custkey").cast("string")))
    name = lambda alias: placed.select(F.col("workflow_id").alias(f"{alias}_w"), F.col("place").alias(f"{alias}_p"), F.col("task_id").alias(alias))
    half, up = name("half"), name("up")
    joined = placed.join(half, (F.col("workflow_id") == F.col("half_w")) & (F.col("half_p") == F.floor((F.col("place") - 1) / 2)) & (F.col("place") > 0), "left").join(
        up, (F.col("workflow_id") == F.col("up_w")) & (F.col("up_p") == F.col("place") - 3) & (F.col("place") % 5 == 0), "left"
    )
    deps = [F.col("half"), F.col("up")]
    if faults:
        k = F.col("c_custkey")
        deps += [F.when(k % 37 == 0, F.concat(F.lit("x"), k.cast("string"))), F.when(k % 41 == 0, F.col("task_id"))]
    rows = joined.select("workflow_id", "place", "task_id", F.array_compact(F.array(*deps)).alias("depends_on"), "c_custkey")
    if faults:
        again = rows.where(F.col("c_custkey") % 43 == 0).withColumn("place", F.col("place") + 1_000_000)
        rows = rows.union(again)
    return rows.drop("c_custkey")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces from lineitem: an order is a trace, its lines are spans; line n hangs on line n div 2, services go by ship mode of the line number."""
    n = F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.max("l_shipdate").alias("l_shipdate"))
    start = F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000
    return lines.select(
        F.col("l_orderkey").alias("trace_id"), n.cast("long").alias("span_id"), F.when(n > 1, F.floor(n / 2).cast("long")).alias("parent_id"),
        F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("service"), F.concat(F.lit("op"), n.cast("string")).alias("name"), start.alias("start_ns"), (start + n * 1000).alias("end_ns"),
    )
