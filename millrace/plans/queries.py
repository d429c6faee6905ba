"""The queries of this package on the benchmark tables, by name."""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.operators import dag, eventlog, forensics, merge, quality_gate, staging, star, watermark
from millrace.plans import load, runs
from millrace.sources import adapters, raw
from millrace.storage import new_path, stored
from millrace.streaming import folds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def as_of() -> Column:
    return F.lit(dt.datetime(2000, 1, 1, tzinfo=dt.timezone.utc))


def shown(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def reasoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.with_reason(staging.parse(raw.requests_from_orders(spark, sf_dir), as_of()))


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.stage(reasoned(spark, sf_dir))


# ---- quality gate ----


@query
def dq_profile(spark, sf_dir):
    return quality_gate.profile(raw.requests_from_orders(spark, sf_dir))


@query
def dq_profile_by_month(spark, sf_dir):
    rows = raw.requests_from_orders(spark, sf_dir).withColumn("month", F.date_format("partition_date", "yyyy-MM"))
    return quality_gate.profile(rows, "month")


@query
def dq_gate_status(spark, sf_dir):
    limits = quality_gate.Limits(min_rows=100, max_missing_pct=1.2)
    gated = quality_gate.gate(dq_profile_by_month(spark, sf_dir), limits)
    return gated.select("month", "total", "missing_agency_pct", "invalid_zip_pct", "duplicates_pct", "failures", "passed")


@query
def dq_volume_vs_median(spark, sf_dir):
    days = raw.table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n_rows"))
    return quality_gate.volume_check(days, days)


# ---- parse, reject, clean, deduplicate ----


@query
def reject_reasons(spark, sf_dir):
    return staging.rejected(reasoned(spark, sf_dir)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min("row_num").alias("first_row"))


@query
def rejected_rows(spark, sf_dir):
    return staging.rejected(reasoned(spark, sf_dir))


@query
def accepted_rows(spark, sf_dir):
    return reasoned(spark, sf_dir).where("reject_reason IS NULL").select("partition_date", "row_num", "unique_key")


@query
def clean_columns(spark, sf_dir):
    return staged(spark, sf_dir).select("unique_key", "agency_code", "agency_name", "complaint_type", "descriptor", "borough", "zip", "status", F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"))


@query
def local_to_utc_days(spark, sf_dir):
    return staged(spark, sf_dir).select("unique_key", shown("created_at").alias("created_utc"), shown("closed_at").alias("closed_utc"), "partition_date")


@query
def local_to_utc_clock_changes(spark, sf_dir):
    """Each half hour around both changes of the clock."""
    starts = spark.createDataFrame([("2026-03-08",), ("2026-11-01",)], "day string")
    steps = starts.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda n: F.to_timestamp_ntz("day") + F.make_dt_interval(F.lit(0), F.lit(0), n * 30))).alias("local"))
    return steps.select(shown("local").alias("local"), shown(C.local_to_utc(F.col("local"))).alias("utc"))


@query
def resolution_hours(spark, sf_dir):
    return staged(spark, sf_dir).select("unique_key", F.col("resolution_hours").cast("double").alias("resolution_hours"))


@query
def transform_stats(spark, sf_dir):
    r = reasoned(spark, sf_dir)
    return staging.transform_stats(r, staging.stage(r)).drop("run_id")


@query
def dedup_latest_version(spark, sf_dir):
    order = [F.col(c).desc() for c in ("l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")]
    return staging.latest(raw.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], order)


# ---- star schema ----


@query
def dim_date(spark, sf_dir):
    return star.dim_date(star.request_days(staged(spark, sf_dir)))


@query
def dim_agency_best_name(spark, sf_dir):
    return star.best_names(staged(spark, sf_dir))


@query
def dim_location(spark, sf_dir):
    return star.dimension("location", staged(spark, sf_dir))


def _star_rows(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Some columns of the staged rows, with the natural keys, computed once for the dimensions and the facts."""
    keys = [c for natural in star.NATURAL.values() for c in natural]
    return stored(staged(spark, sf_dir).select(*keys, *columns), "star-rows")


@query
def fact_star_join(spark, sf_dir):
    rows = _star_rows(spark, sf_dir, "unique_key", "created_at", "closed_at", "status", "resolution_hours")
    dims = star.dimensions(rows)
    fact = star.facts(rows, dims).join(dims["location"], "location_key").join(dims["complaint"], "complaint_key").join(dims["agency"], "agency_key")
    return fact.select("unique_key", "created_date_key", "closed_date_key", "agency_code", "complaint_type", "descriptor", "borough", "zip", "status", F.col("resolution_hours").cast("double").alias("resolution_hours"))


@query
def agg_daily(spark, sf_dir):
    rows = _star_rows(spark, sf_dir, "created_at", "closed_at", "resolution_hours")
    dims = star.dimensions(rows)
    return star.daily_aggregate(star.facts(rows, dims), dims).withColumn("avg_resolution_hours", F.col("avg_resolution_hours").cast("double"))


def _natural_fact(spark, sf_dir) -> tuple[DataFrame, list[Column]]:
    rows = staged(spark, sf_dir).withColumn("created_date_key", C.date_key(F.col("created_day")))
    return rows, [F.col("agency_code"), F.col("complaint_type"), F.col("borough"), F.col("zip")]


@query
def fact_checksum(spark, sf_dir):
    return star.checksum(*_natural_fact(spark, sf_dir))


@query
def fact_checksum_by_day(spark, sf_dir):
    return star.checksum_by_day(*_natural_fact(spark, sf_dir))


# ---- writes that read first ----


def _versions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Orders as an existing table (without every seventh) and as incoming rows (of every second), with versions that are older, equal, newer or missing."""
    o = raw.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    old = o.where(k % 7 != 0).select(k.alias("key"), F.col("o_orderstatus").alias("status"), F.when(k % 10 != 0, day).alias("version"))
    new = o.where(k % 2 == 0).select(k.alias("key"), F.lower("o_orderstatus").alias("status"), F.when(k % 12 != 0, F.date_add(day, (k % 3).cast("int") - 1)).alias("version"))
    return old, new


@query
def merge_newest_wins(spark, sf_dir):
    return merge.merge_newest_wins(*_versions(spark, sf_dir), ["key"], "version").withColumnRenamed("_action", "action")


@query
def merge_outcome_counts(spark, sf_dir):
    return merge.outcome_counts(merge.merge_newest_wins(*_versions(spark, sf_dir), ["key"], "version"))


@query
def merge_rerun_is_noop(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    once = merge.merge_newest_wins(old, new, ["key"], "version").drop("_action")
    return merge.outcome_counts(merge.merge_newest_wins(once, new, ["key"], "version"))


@query
def upsert_run_status(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return merge.upsert(old, new, ["key"], ["status"])


@query
def insert_absent_keys(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return merge.insert_absent(old, new, ["key"])


@query
def dimension_name_updates(spark, sf_dir):
    c = raw.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    old = c.where(k % 5 != 0).select(k.alias("code"), F.when(k % 4 != 0, F.col("c_name")).alias("name"))
    new = c.where(k % 3 == 0).select(k.alias("code"), F.when(k % 9 != 0, F.concat("c_name", F.when(k % 2 == 0, "!").otherwise(""))).alias("name"))
    return merge.update_names(old, new, "code", "name").withColumnRenamed("_action", "action")


@query
def replace_date_range(spark, sf_dir):
    daily = raw.table(spark, sf_dir, "orders").groupBy(C.date_key(F.col("o_orderdate")).alias("date_key")).agg(F.count(F.lit(1)).alias("n"))
    rebuilt = daily.where(F.col("date_key") % 3 != 0).withColumn("n", F.col("n") * 10)
    return merge.replace_range(daily, rebuilt, F.col("date_key").between(19960101, 19961231))


@query
def append_conflicts(spark, sf_dir):
    log = adapters.event_log(spark, sf_dir)
    late = log.withColumn("sequence", F.col("sequence") + F.when(F.col("event_id") % 2 == 0, 0).otherwise(1_000_000_000))
    return merge.conflicts(log, late).select("workflow_id", "sequence", "event_type")


@query
def numbered_appends(spark, sf_dir):
    events = adapters.log_columns(raw.table(spark, sf_dir, "events"))
    versions = events.groupBy("workflow_id").agg((F.max("event_id") % 100).alias("version")).where("workflow_id % 3 <> 0")
    return merge.number_events(events, versions, [F.col("created_at"), F.col("event_id")]).select("workflow_id", "event_id", "sequence")


@query
def watermark_advance_matrix(spark, sf_dir):
    d = lambda s: dt.date.fromisoformat(s) if s else None
    cases = [("none", None, "2024-01-01", "2024-01-31"), ("contiguous", "2024-01-31", "2024-02-01", "2024-02-10"), ("overlap", "2024-01-31", "2024-01-15", "2024-02-10"), ("gap", "2024-01-31", "2024-02-02", "2024-02-10"), ("backwards", "2024-01-31", "2024-01-01", "2024-01-10"), ("equal", "2024-01-31", "2024-01-31", "2024-01-31")]
    rows = spark.createDataFrame([(n, d(c), d(a), d(b)) for n, c, a, b in cases], "name string, current date, start_day date, end_day date")
    return watermark.advance(rows)


# ---- pages of records ----


@query
def json_unnest_ordinal(spark, sf_dir):
    e = raw.table(spark, sf_dir, "events")
    paged = e.withColumn("page_no", F.floor(F.col("event_id") / 100)).groupBy("page_no").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: F.struct(x["event_id"].cast("string").alias("id"), x["event_type"].alias("kind")))).alias("page"))
    rows = raw.unnest_page(paged.withColumn("page_offset", F.col("page_no") * 100))
    return rows.select("page_no", "row_num", F.col("record")["id"].alias("id"), F.col("record")["kind"].alias("kind"))


@query
def drop_key_fault(spark, sf_dir):
    e = raw.table(spark, sf_dir, "events")
    record = F.from_json("props", "map<string,string>")
    keys = F.map_keys(raw.drop_key(F.map_concat(record, F.create_map(F.lit("created_date"), F.col("event_type"))), "created_date"))
    return e.select("event_id", F.array_join(F.array_sort(keys), ",").alias("keys"))


@query
def props_profile(spark, sf_dir):
    e = raw.table(spark, sf_dir, "events").select("event_type", F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("key"))
    return e.groupBy("event_type", "key").agg(F.count(F.lit(1)).alias("n"))


# ---- forensics over the event log ----


@query
def events_join_runs_status_counts(spark, sf_dir):
    return forensics.status_histogram(adapters.run_table(adapters.event_log(spark, sf_dir)).fillna("NONE", ["status"]), ["name"])


@query
def event_type_counts(spark, sf_dir):
    log = adapters.event_log(spark, sf_dir)
    runs = adapters.run_table(log).select("workflow_id", "name")
    return log.join(runs, "workflow_id").groupBy("name", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query
def duplicate_successes(spark, sf_dir):
    return forensics.duplicate_successes(adapters.event_log(spark, sf_dir))


@query
def rerun_counts(spark, sf_dir):
    return forensics.rerun_counts(adapters.event_log(spark, sf_dir), "workflow_id")


@query
def retry_reasons(spark, sf_dir):
    return forensics.retry_reasons(adapters.event_log(spark, sf_dir))


@query
def max_stall_per_key(spark, sf_dir):
    return forensics.longest_stall(adapters.event_log(spark, sf_dir))


@query
def last_event_per_key(spark, sf_dir):
    return forensics.last_events(adapters.event_log(spark, sf_dir)).select("workflow_id", "sequence", "event_type", "task_id", "attempt")


@query
def stuck_workflows(spark, sf_dir):
    return forensics.stuck(adapters.event_log(spark, sf_dir)).select("workflow_id", "sequence", "event_type")


@query
def stuck_by_type_and_attempt(spark, sf_dir):
    last = forensics.last_events(adapters.event_log(spark, sf_dir)).where("event_type <> 'WorkflowCompleted'")
    return last.groupBy("event_type", "attempt").agg(F.count(F.lit(1)).alias("n"))


@query
def run_throughput(spark, sf_dir):
    log = adapters.event_log(spark, sf_dir)
    runs = adapters.run_table(log)
    tasks = log.where("event_type = 'TaskSucceeded'").join(runs.select("workflow_id", "name"), "workflow_id")
    return forensics.throughput(runs, tasks, "name")


@query
def latency_quantiles(spark, sf_dir):
    return forensics.quantiles(forensics.latencies(adapters.event_log(spark, sf_dir)).withColumn("attempt", F.col("attempt")), "ms", "attempt")


@query
def latency_buckets(spark, sf_dir):
    bounds = [float(x) for x in (1e6, 1e7, 5e7, 1e8, 5e8, 1e9, 5e9)]
    return forensics.bucket_quantile(forensics.latencies(adapters.event_log(spark, sf_dir)), "ms", bounds, 0.95)


@query
def peak_rate_sliding(spark, sf_dir):
    return forensics.peak_rate(raw.table(spark, sf_dir, "events"), "ts", "1 hour", "15 minutes", "event_type")


@query
def active_workflows(spark, sf_dir):
    return forensics.active_over_time(adapters.event_log(spark, sf_dir))


@query
def list_page(spark, sf_dir):
    runs = adapters.run_table(adapters.event_log(spark, sf_dir))
    return eventlog.page(runs, number=1, size=20, admin=True).select("workflow_id", "name", "created_at", "total_elements", "total_pages")


@query
def visible_rows(spark, sf_dir):
    return eventlog.visible(adapters.run_table(adapters.event_log(spark, sf_dir)), "u3").select("workflow_id", "name", "owner", "version")


@query
def run_view(spark, sf_dir):
    return adapters.run_table(adapters.event_log(spark, sf_dir))


@query
def task_state_fold(spark, sf_dir):
    return eventlog.task_states(adapters.event_log(spark, sf_dir))


@query
def illegal_transitions(spark, sf_dir):
    return eventlog.illegal_transitions(adapters.event_log(spark, sf_dir))


@query
def events_after_end(spark, sf_dir):
    return eventlog.running_after_end(adapters.event_log(spark, sf_dir))


@query
def events_before_start(spark, sf_dir):
    return eventlog.before_start(adapters.event_log(spark, sf_dir))


@query
def workflow_progress(spark, sf_dir):
    return eventlog.progress(eventlog.task_states(adapters.event_log(spark, sf_dir)))


@query
def run_events(spark, sf_dir):
    """The events of one run, in order."""
    return runs.events(adapters.event_log(spark, sf_dir), 7).select("workflow_id", "sequence", "event_type", "task_id")


@query
def run_tasks(spark, sf_dir):
    """The tasks of one run, those without events too."""
    log = adapters.event_log(spark, sf_dir)
    defined = log.select("workflow_id").distinct().select("workflow_id", F.explode(F.array(*[F.lit(f"t{n}") for n in range(6)])).alias("task_id"))
    return runs.view(log, defined, 7).select("workflow_id", "task_id", "status", "attempt", "n_events")


@query
def list_page_by_status(spark, sf_dir):
    """A user's own completed runs, newest first."""
    listed = adapters.run_table(adapters.event_log(spark, sf_dir))
    return eventlog.page(listed, size=5, status="completed", user="u3").select("workflow_id", "owner", "status", "total_elements", "total_pages")


@query
def event_rates(spark, sf_dir):
    return forensics.rates(raw.table(spark, sf_dir, "events"), "ts", "1 hour", "1 hour", "event_type")


@query
def greatest_rates(spark, sf_dir):
    return forensics.greatest_rates(raw.table(spark, sf_dir, "events"), "ts", "10 minutes", "5 minutes", "1 day", "event_type")


@query
def json_lines_results(spark, sf_dir):
    """Results appended twice to a folder of JSON lines, and read again."""
    result = raw.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    folder = new_path(spark, "results")
    for _ in range(2):
        forensics.append_result(result, folder)
    return spark.read.schema(result.schema).json(folder)


@query
def poison_records(spark, sf_dir):
    """Messages by schema, and those that do not parse."""
    e = raw.table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("broken "), F.col("event_id").cast("string"))).otherwise(F.to_json(F.struct("event_id", "event_type")))
    good, bad = folds.decoded(e.select(text.alias("value")), spark.createDataFrame([], "event_id long, event_type string").schema)
    return good.select("event_id", "event_type", F.lit(None).cast("string").alias("poison")).unionByName(bad.select(F.col("value").alias("poison")), allowMissingColumns=True)


@query
def key_partitions(spark, sf_dir):
    """The partition of twelve that each key goes to."""
    return raw.table(spark, sf_dir, "customer").select("c_custkey", C.partition_of(F.col("c_name"), 12).alias("partition"))


@query
def ignored_kinds(spark, sf_dir):
    reasons = F.element_at(F.array(*[F.lit(x) for x in ("stale attempt 1 for a (current 2)", "workflow already started", "workflow is FAILED", "workflow not started", "retry for a not due until x", "lease for a valid until x", "task a is RUNNING", "else")]), (F.col("event_id") % 8 + 1).cast("int"))
    return raw.table(spark, sf_dir, "events").select(C.ignored_kind(reasons).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query
def backoff_schedule(spark, sf_dir):
    grid = spark.range(1, 21).select(F.col("id").cast("int").alias("attempt"))
    base = C.backoff_millis(F.col("attempt"), F.lit(500), F.lit(2.0), F.lit(30_000))
    return grid.select("attempt", base.alias("base_ms"), C.jittered(base, F.lit(0.5)).alias("jittered_ms"))


@query
def idempotency_ids(spark, sf_dir):
    return raw.table(spark, sf_dir, "customer").select("c_custkey", C.name_uuid(F.concat_ws(":", F.lit("owner"), F.col("c_name"))).alias("run_id"))


# ---- task graphs and traces ----


@query
def dag_structure_errors(spark, sf_dir):
    return dag.structure_errors(adapters.task_graphs(spark, sf_dir, faults=True))


@query
def dag_unknown_deps(spark, sf_dir):
    return dag.structure_errors(adapters.task_graphs(spark, sf_dir, faults=True)).where(F.col("error").contains("unknown")).select("workflow_id", "error")


@query
def dag_duplicates(spark, sf_dir):
    return dag.structure_errors(adapters.task_graphs(spark, sf_dir, faults=True)).where(F.col("error").startswith("duplicate")).select("workflow_id", "error")


@query
def dag_roots(spark, sf_dir):
    return dag.roots(adapters.task_graphs(spark, sf_dir))


@query
def dag_indegree(spark, sf_dir):
    return dag.in_degrees(adapters.task_graphs(spark, sf_dir))


def _states(tasks: DataFrame) -> DataFrame:
    return tasks.select("workflow_id", "task_id", F.when(F.col("place") % 4 != 3, "SUCCEEDED").otherwise("PENDING").alias("status")).where(F.col("place") < 12)


@query
def dag_ready(spark, sf_dir):
    tasks = adapters.task_graphs(spark, sf_dir)
    return dag.ready(tasks, _states(tasks))


@query
def dag_levels(spark, sf_dir):
    return dag.levels(adapters.task_graphs(spark, sf_dir))


@query
def dag_downstream(spark, sf_dir):
    return dag.downstream(adapters.task_graphs(spark, sf_dir))


@query
def dag_orders(spark, sf_dir):
    return dag.orders(adapters.task_graphs(spark, sf_dir))


@query
def dag_cycle_path(spark, sf_dir):
    """The graphs with one edge turned back, so that each has a cycle."""
    tasks = adapters.task_graphs(spark, sf_dir)
    back = tasks.where("place = 4").select("workflow_id", F.col("task_id").alias("far"))
    return dag.cycles(tasks.join(back, "workflow_id").withColumn("depends_on", F.when(F.col("place") == 0, F.array("far")).otherwise(F.col("depends_on"))))


@query
def exported_spans(spark, sf_dir):
    """Spans flattened from one JSON body per trace, as collectors export them."""
    spans = adapters.spans(spark, sf_dir)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    one = F.struct(text("trace_id").alias("traceId"), text("span_id").alias("spanId"), text("parent_id").alias("parentSpanId"), "name", text("start_ns").alias("startTimeUnixNano"), text("end_ns").alias("endTimeUnixNano"))
    resource = F.struct(F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.col("service").alias("stringValue")).alias("value"))).alias("attributes"))
    by_service = spans.groupBy("trace_id", "service").agg(F.collect_list(one).alias("spans")).select("trace_id", F.struct(resource.alias("resource"), F.array(F.struct("spans")).alias("scopeSpans")).alias("r"))
    bodies = by_service.groupBy("trace_id").agg(F.to_json(F.struct(F.collect_list("r").alias("resourceSpans"))).alias("body"))
    return forensics.flat_spans(bodies)


@query
def span_tree(spark, sf_dir):
    tree = forensics.span_tree(adapters.spans(spark, sf_dir).where("NOT (span_id = 2 AND trace_id % 5 = 0)"))
    return tree.select("trace_id", "span_id", "depth", "start_ms")


@query
def fullest_trace(spark, sf_dir):
    return forensics.fullest_trace(adapters.spans(spark, sf_dir))


# ---- a whole load ----


def _loaded(spark: SparkSession, sf_dir: str, times: int, limits: quality_gate.Limits) -> list[Mapping[str, object]]:
    first, last = raw.table(spark, sf_dir, "orders").select(F.min(F.to_date("o_orderdate")), F.date_add(F.max(F.to_date("o_orderdate")), 1)).collect()[0]
    root = new_path(spark, "star")
    return [load.run(spark, raw.requests_from_orders(spark, sf_dir).drop("run_id"), root, f"run-{n}", first, last, limits=limits, as_of=as_of(), grain="month") for n in range(1, times + 1)]


#: Limits that let days of any size through.
OPEN = quality_gate.Limits(min_rows=0, max_missing_pct=100.0, max_borough_pct=100.0, max_zip_pct=100.0, max_duplicate_pct=100.0, min_volume_ratio=0.0)
SHOWN = ("run_id", "partitions", "rows_extracted", "rows_rejected", "duplicates_removed", "rows_accepted", "rows_inserted", "rows_updated", "rows_unchanged", "fact_rows_in_range", "aggregate_rows", "watermark_after")


def _reports(spark: SparkSession, reports: list[Mapping[str, object]]) -> DataFrame:
    kinds = {"run_id": "string", "watermark_after": "string"}
    return spark.createDataFrame([tuple(r[k] for k in SHOWN) for r in reports], ", ".join(f"{k} {kinds.get(k, 'long')}" for k in SHOWN))


@query
def load_backfill_report(spark, sf_dir):
    """All days of the feed, from raw records to the report of the run."""
    return _reports(spark, _loaded(spark, sf_dir, 1, OPEN))


@query
def load_rerun_is_noop(spark, sf_dir):
    """The report of a second run of the same days, and whether the checksum is that of the first."""
    one, two = _loaded(spark, sf_dir, 2, OPEN)
    return _reports(spark, [two]).withColumn("same_checksum", F.lit(one["fact_checksum"] == two["fact_checksum"]))


@query
def load_failed_days(spark, sf_dir):
    """Days that the gate holds back, with the reasons; the watermark stays where it was."""
    report = _loaded(spark, sf_dir, 1, dataclasses.replace(OPEN, max_missing_pct=10.0))[0]
    rows = [(text, report["watermark_after"]) for text in report["failed_days"]]
    return spark.createDataFrame(rows, "failure string, watermark_after string")


# ---- streams ----


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.file_stream(spark, sf_dir, "events.parquet", raw.table(spark, sf_dir, "events").schema)


@query
def stream_windowed_counts(spark, sf_dir):
    """Counts of the days that are closed: those that end an hour or more before the newest event."""
    timed = _event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = folds.windowed_counts(timed, "ts", "1 day", "1 hour", "event_type")
    return folds.drained(counts, "rates").select(F.to_timestamp_ntz(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss")).alias("day"), "event_type", "n")


@query
def stream_first_deliveries(spark, sf_dir):
    twice = _event_stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("ts", F.col("ts").cast("timestamp"))
    return folds.drained(folds.first_deliveries(twice, ["event_id"], "ts", "40 days"), "first").select("event_id", "user_id", "event_type")


@query
def stream_task_states(spark, sf_dir):
    """The fold of task_state_fold as a read model that a stream keeps: the last event of each task by time."""
    keys = ["workflow_id", "task_id"]
    log = adapters.log_columns(_event_stream(spark, sf_dir)).where(F.col("event_type").isin(*eventlog.TASK_STATUS))
    last = F.struct("created_at", "event_id", "event_type").alias("last")
    model = folds.upserted(log, keys, lambda rows: rows.groupBy(*keys).agg(F.max(last).alias("last"), F.count(F.lit(1)).alias("n_events")), lambda rows: rows.groupBy(*keys).agg(F.max("last").alias("last"), F.sum("n_events").alias("n_events")), "states")
    return model.select(*keys, F.col("last.event_type").alias("last_type"), "n_events")
