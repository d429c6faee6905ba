"""Questions asked of an event log after the fact: duplicates, retries, stalls, latencies, rates, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.staging import latest
from millrace.storage import stored


def status_histogram(runs: DataFrame, by: list[str]) -> DataFrame:
    """`STATUS=count` texts joined by a space, in order of status, for each group."""
    counts = runs.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("status", "n"))), lambda x: F.concat_ws("=", x["status"], x["n"].cast("string"))), " ")
    return counts.groupBy(*by).agg(text.alias("histogram"))


def duplicate_successes(log: DataFrame) -> DataFrame:
    """Tasks with more than one success."""
    return log.where("event_type = 'TaskSucceeded'").groupBy("workflow_id", "task_id").agg(F.count(F.lit(1)).alias("successes")).where("successes > 1")


def rerun_counts(log: DataFrame, *by: str) -> DataFrame:
    kind = F.col("event_type")
    return log.groupBy(*by).agg(
        F.count_if(kind == "TaskFailed").alias("failures"),
        F.count_if((kind == "TaskStarted") & (F.col("attempt") > 1)).alias("reruns"),
        F.count_if((kind == "TaskFailed") & F.col("error").startswith("lease expired")).alias("lease_expiries"),
    )


def retry_reasons(log: DataFrame, length: int = 45) -> DataFrame:
    return log.where("event_type = 'TaskFailed'").groupBy(F.left("error", F.lit(length)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def longest_stall(log: DataFrame, key: str = "workflow_id") -> DataFrame:
    """The longest gap between two events in sequence, in milliseconds, of each workflow."""
    gap = micros(F.col("created_at")) - F.lag(micros(F.col("created_at"))).over(W.partitionBy(key).orderBy("sequence"))
    return log.select(key, gap.alias("gap")).groupBy(key).agg((F.max("gap") / 1000).alias("max_stall_ms"))


def last_events(log: DataFrame, key: str = "workflow_id") -> DataFrame:
    return latest(log, [key], [F.col("sequence").desc()])


def stuck(log: DataFrame, limit: int = 10) -> DataFrame:
    """The last event of workflows that have not ended, the first `limit` by id."""
    open_ones = last_events(log).where(~F.col("event_type").isin("WorkflowCompleted", "WorkflowFailed", "WorkflowCancelled"))
    return open_ones.orderBy("workflow_id").limit(limit)


def throughput(runs: DataFrame, tasks: DataFrame, *by: str) -> DataFrame:
    """Seconds from the first start to the last update, and tasks per second."""
    span = runs.groupBy(*by).agg(((F.max(micros(F.col("updated_at"))) - F.min(micros(F.col("created_at")))) / 1_000_000).alias("elapsed_s"))
    done = tasks.groupBy(*by).agg(F.count(F.lit(1)).alias("tasks"))
    return span.join(done, list(by)).withColumn("tasks_per_s", F.when(F.col("elapsed_s") > 0, F.col("tasks") / F.col("elapsed_s")))


def latencies(log: DataFrame, start: str = "TaskQueued", end: str = "TaskSucceeded") -> DataFrame:
    """Milliseconds from the last `start` to the first `end` of each attempt; negative ones are left out."""
    kind = F.col("event_type")
    pairs = log.where(kind.isin(start, end)).groupBy("workflow_id", "task_id", "attempt").agg(
        F.max(F.when(kind == start, micros(F.col("created_at")))).alias("a"), F.min(F.when(kind == end, micros(F.col("created_at")))).alias("b")
    )
    return pairs.where("b >= a").select("workflow_id", "task_id", "attempt", ((F.col("b") - F.col("a")) / 1000).alias("ms"))


def quantiles(rows: DataFrame, value: str, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.percentile(value, F.lit(q)).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)])


def bucket_quantile(rows: DataFrame, value: str, bounds: list[float], q: float) -> DataFrame:
    """A quantile from histogram buckets, linear inside a bucket, as monitoring systems give it: one row, bounded state."""
    b = [0.0, *bounds]
    index = sum((F.col(value) > x).cast("int") for x in bounds)
    counts = rows.groupBy(index.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    # One row per bucket, as many as there are bounds: windows without a key are fine here.
    counts = counts.withColumns({"upto": F.sum("n").over(W.orderBy("bucket")), "total": F.sum("n").over(W.partitionBy())})
    rank = F.col("total") * F.lit(q)
    lows, highs = F.array(*[F.lit(x) for x in b]), F.array(*[F.lit(x) for x in [*bounds, bounds[-1]]])
    low, high = F.get(lows, "bucket"), F.get(highs, "bucket")
    value_at = F.when(F.col("bucket") >= len(bounds), F.lit(bounds[-1])).otherwise(low + (high - low) * (rank - (F.col("upto") - F.col("n"))) / F.col("n"))
    return counts.where(F.col("upto") >= rank).agg(F.min_by(value_at, "bucket").alias("quantile"))


def peak_rate(events: DataFrame, ts: str = "ts", width: str = "1 hour", step: str = "15 minutes", *by: str) -> DataFrame:
    """The greatest number of events in any sliding window, and when it begins."""
    slides = events.groupBy(*by, F.window(ts, width, step)).agg(F.count(F.lit(1)).alias("n"))
    return slides.groupBy(*by).agg(F.max("n").alias("peak"), F.max_by(F.col("window.start"), F.struct("n", -F.unix_micros(F.col("window.start").cast("timestamp")))).alias("peak_start"))


def rates(events: DataFrame, ts: str, width: str, step: str, *by: str) -> DataFrame:
    """start, increase, per_second: how many events each window of `width`, one every `step`, holds, and how many that is a second."""
    window = F.window(ts, width, step)
    counts = events.groupBy(*by, window).agg(F.count(F.lit(1)).alias("increase"))
    seconds = F.unix_timestamp("window.end") - F.unix_timestamp("window.start")
    return counts.select(*by, F.col("window.start").alias("start"), "increase", (F.col("increase") / seconds).alias("per_second"))


def greatest_rates(events: DataFrame, ts: str, width: str, step: str, over: str, *by: str) -> DataFrame:
    """The greatest rate of `width` windows in each stretch `over` in which they begin, as a monitoring query over a subquery gives it."""
    rated = rates(events, ts, width, step, *by)
    return rated.groupBy(*by, F.window("start", over).alias("stretch")).agg(F.max("per_second").alias("greatest")).select(*by, F.col("stretch.start").alias("start"), "greatest")


def append_result(result: DataFrame, folder: str) -> None:
    """Appends the rows of a result to a folder of JSON lines, an object each."""
    result.write.mode("append").json(folder)


def active_over_time(log: DataFrame) -> DataFrame:
    """Started and not ended workflows at each start or end: a running sum by day, carried from day to day."""
    kind = F.col("event_type")
    step = F.when(kind == "WorkflowStarted", 1).when(kind.isin("WorkflowCompleted", "WorkflowFailed", "WorkflowCancelled"), -1)
    moves = log.select("created_at", "workflow_id", "sequence", step.alias("step")).where("step IS NOT NULL").withColumn("day", F.to_date("created_at"))
    # One row per day: the window without a key is as long as the log has days.
    carried = moves.groupBy("day").agg(F.sum("step").alias("net")).withColumn("before", F.coalesce(F.sum("net").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.sum("step").over(W.partitionBy("day").orderBy("created_at", "workflow_id", "sequence"))
    return moves.withColumn("inside", inside).join(carried.select("day", "before"), "day").select("created_at", "workflow_id", "sequence", (F.col("before") + F.col("inside")).alias("active"))


def flat_spans(traces: DataFrame, body: str = "body") -> DataFrame:
    """service, trace_id, span_id, parent_id, name, start_ns, end_ns of exported traces (JSON with resource, scope and span lists)."""
    schema = (
        "struct<resourceSpans: array<struct<resource: struct<attributes: array<struct<key: string, value: struct<stringValue: string>>>>, "
        "scopeSpans: array<struct<spans: array<struct<traceId: string, spanId: string, parentSpanId: string, name: string, startTimeUnixNano: string, endTimeUnixNano: string>>>>>>>"
    )
    resource = traces.select(F.explode(F.from_json(body, schema)["resourceSpans"]).alias("r"))
    service = F.get(F.filter("r.resource.attributes", lambda a: a["key"] == "service.name"), 0)["value"]["stringValue"]
    spans = resource.select(service.alias("service"), F.explode(F.flatten(F.transform("r.scopeSpans", lambda s: s["spans"]))).alias("s"))
    return spans.select(
        "service", F.col("s.traceId").alias("trace_id"), F.col("s.spanId").alias("span_id"), F.nullif(F.col("s.parentSpanId"), F.lit("")).alias("parent_id"), F.col("s.name").alias("name"),
        F.col("s.startTimeUnixNano").cast("long").alias("start_ns"), F.col("s.endTimeUnixNano").cast("long").alias("end_ns"),
    )


def span_tree(spans: DataFrame) -> DataFrame:
    """spans with depth and start_ms relative to the trace. A span whose parent is missing is a root; spans whose parents go round in a circle have no depth.

    Each span points upward; pointers are followed twice as far in each round, so the rounds are the logarithm of the depth.
    """
    keys = ["trace_id", "span_id"]
    known = spans.select(F.col("trace_id").alias("k_trace"), F.col("span_id").alias("k_span"))
    linked = spans.join(known, (F.col("trace_id") == F.col("k_trace")) & (F.col("parent_id") == F.col("k_span")), "left")
    up = stored(linked.select(*keys, F.col("k_span").alias("up"), F.when(F.col("k_span").isNull(), 0).otherwise(1).cast("long").alias("depth")), "span-up")
    most = up.groupBy("trace_id").count().agg(F.max("count")).collect()[0][0] or 0
    reach, roots = 1, up.where("up IS NULL")
    climbing = up.where("up IS NOT NULL")
    while reach <= most and not climbing.isEmpty():
        both = up.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        moved = climbing.join(both, ["trace_id", "up"]).select(*keys, F.col("further").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        up = stored(roots.unionByName(moved), "span-up")
        reach, roots = 2 * reach, up.where("up IS NULL")
        climbing = up.where("up IS NOT NULL")
    depth = up.select(*keys, F.when(F.col("up").isNull(), F.col("depth").cast("int")).alias("depth"))
    first = spans.groupBy("trace_id").agg(F.min("start_ns").alias("t0"))
    return spans.join(depth, keys).join(first, "trace_id").select(*spans.columns, "depth", ((F.col("start_ns") - F.col("t0")) / 1_000_000).alias("start_ms"))


def fullest_trace(spans: DataFrame) -> DataFrame:
    """The trace with the most services, then spans, then the smallest id."""
    sizes = spans.groupBy("trace_id").agg(F.countDistinct("service").alias("services"), F.count(F.lit(1)).alias("spans"))
    return sizes.orderBy(F.col("services").desc(), F.col("spans").desc(), "trace_id").limit(1)
