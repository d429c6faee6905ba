import datetime as dt
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from millrace.operators import dag, eventlog, forensics
from millrace.streaming import folds


def graph(spark, **deps):
    return spark.createDataFrame([("w", n, t, d) for n, (t, d) in enumerate(deps.items())], "workflow_id string, place long, task_id string, depends_on array<string>")


DIAMOND = {"a": [], "b": ["a"], "c": ["a"], "d": ["b", "c"]}


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_diamond(spark):
    g = graph(spark, **DIAMOND)
    assert pairs(dag.roots(g), "task_id") == [("a",)]
    assert pairs(dag.levels(g), "task_id", "level") == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert pairs(dag.downstream(g, spark.createDataFrame([("w", "a")], "workflow_id string, task_id string")), "reached") == [("b",), ("c",), ("d",)]
    assert pairs(dag.orders(g), "position", "task_id") == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert dag.cycles(g).count() == 0
    states = spark.createDataFrame([("w", "a", "SUCCEEDED"), ("w", "b", "SUCCEEDED")], "workflow_id string, task_id string, status string")
    assert pairs(dag.ready(g, states), "task_id") == [("c",)]


def test_all_errors_in_order(spark):
    g = spark.createDataFrame([("w", 0, "a", ["x"]), ("w", 1, "a", []), ("w", 2, "b", ["b"])], "workflow_id string, place long, task_id string, depends_on array<string>")
    assert [r["error"] for r in dag.structure_errors(g).orderBy("rank").collect()] == ["duplicate task id 'a'", "task 'a' depends on unknown task 'x'", "task 'b' depends on itself"]


def test_cycles():
    assert dag.order_or_cycle(["a", "b", "c"], [["c"], ["a"], ["b"]])[1] == ["a", "c", "b", "a"]
    assert dag.order_or_cycle(["r", "x", "y"], [[], ["r", "y"], ["x"]])[1] == ["x", "y", "x"]
    order, cycle = dag.order_or_cycle([f"t{n}" for n in range(10_000)], [[] if n == 0 else [f"t{n - 1}"] for n in range(10_000)])
    assert len(order) == 10_000 and not cycle


def test_levels_of_a_long_chain_take_few_rounds(spark):
    chain = spark.range(10_000).select(F.lit("w").alias("workflow_id"), F.col("id").alias("place"), F.concat(F.lit("t"), "id").alias("task_id"), F.when(F.col("id") > 0, F.array(F.concat(F.lit("t"), (F.col("id") - 1).cast("string")))).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    out = dag.levels(chain)
    assert out.count() == 10_000 and out.where("task_id <> concat('t', level)").count() == 0


def test_tasks_in_or_behind_a_cycle_have_no_level(spark):
    g = graph(spark, r=[], x=["r", "y"], y=["x"], behind=["y"], free=["r"], late=["free", "r"])
    assert pairs(dag.levels(g), "task_id", "level") == [("free", 1), ("late", 2), ("r", 0)]
    assert pairs(dag.cycles(g), "position", "task_id") == [(0, "x"), (1, "y"), (2, "x")]
    assert pairs(dag.downstream(g), "task_id", "reached") == [("free", "late"), ("r", "behind"), ("r", "free"), ("r", "late"), ("r", "x"), ("r", "y"), ("x", "behind"), ("x", "y"), ("y", "behind"), ("y", "x")]


def test_deep_spans_and_spans_in_a_circle(spark):
    rows = [("t", f"s{n}", f"s{n - 1}" if n else None, n * 1_000_000) for n in range(100)] + [("u", "a", "b", 0), ("u", "b", "a", 0), ("u", "c", None, 5_000_000)]
    out = forensics.span_tree(spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string, start_ns long"))
    assert {r["span_id"]: (r["depth"], r["start_ms"]) for r in out.where("trace_id = 't'").collect()} == {f"s{n}": (n, float(n)) for n in range(100)}
    assert sorted((r["span_id"], r["depth"]) for r in out.where("trace_id = 'u'").collect()) == [("a", None), ("b", None), ("c", 0)]


def test_duplicate_dependency_is_harmless(spark):
    assert pairs(dag.in_degrees(graph(spark, a=[], b=["a", "a"])), "task_id", "in_degree") == [("a", 0), ("b", 1)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=4), min_size=1, max_size=25))
def test_orders_put_dependencies_first(deps):
    names = [f"t{n}" for n in range(len(deps))]
    order, cycle = dag.order_or_cycle(names, [[f"t{d}" for d in ds if d < n] for n, ds in enumerate(deps)])
    assert not cycle and sorted(order) == sorted(names)
    assert all(order.index(f"t{d}") < order.index(f"t{n}") for n, ds in enumerate(deps) for d in ds if d < n)


def log_of(spark, *events):
    full = [(w, n, k, t, a, "x", "err" if k == "TaskFailed" else None, None, None, None, dt.datetime(2026, 1, 1, 0, 0, n)) for n, (w, k, t, a) in enumerate(events, 1)]
    return spark.createDataFrame(full, "workflow_id string, sequence long, event_type string, task_id string, attempt int, worker_id string, error string, lease_at timestamp, retry_at timestamp, output string, created_at timestamp")


def test_fold_keeps_the_last_error_over_a_retry(spark):
    log = log_of(spark, ("w", "WorkflowStarted", None, None), ("w", "TaskQueued", "a", 1), ("w", "TaskStarted", "a", 1), ("w", "TaskFailed", "a", 1), ("w", "TaskQueued", "a", 2))
    x = eventlog.task_states(log).collect()[0]
    assert (x["status"], x["attempt"], x["last_error"], x["worker_id"]) == ("QUEUED", 2, "err", None)
    assert eventlog.workflow_states(log).collect()[0]["version"] == 5
    assert eventlog.illegal_transitions(log).count() == 0
    pending = eventlog.with_pending(eventlog.task_states(log), spark.createDataFrame([("w", "a"), ("w", "b")], "workflow_id string, task_id string"))
    assert pairs(pending, "task_id", "status") == [("a", "QUEUED"), ("b", "PENDING")]


@pytest.mark.parametrize("events, why", [([("w", "TaskStarted", "a", 1)], "status"), ([("w", "TaskQueued", "a", 2)], "attempt"), ([("w", "TaskQueued", "a", 1), ("w", "TaskSucceeded", "a", 2)], "attempt")])
def test_illegal_events_are_found(spark, events, why):
    assert [r["why"] for r in eventlog.illegal_transitions(log_of(spark, *events)).collect()] == [why]


def test_the_first_event_must_start_the_workflow(spark):
    log = log_of(spark, ("w", "TaskQueued", "a", 1), ("w", "WorkflowStarted", None, None), ("w", "TaskQueued", "a", 1), ("v", "TaskQueued", "a", 1), ("u", "WorkflowStarted", None, None))
    assert pairs(eventlog.before_start(log), "workflow_id", "sequence") == [("v", 4), ("w", 1)]


def test_progress_over_all_tasks(spark):
    states = spark.createDataFrame([("w", "a", "SUCCEEDED"), ("w", "b", "SKIPPED"), ("v", "a", "DEAD_LETTERED"), ("v", "b", "RUNNING")], "workflow_id string, task_id string, status string")
    assert pairs(eventlog.progress(states), "workflow_id", "all_terminal", "any_dead_lettered", "succeeded") == [("v", False, True, ""), ("w", True, False, "a")]


def test_a_read_model_counts_a_repeated_batch_once(spark, tmp_path):
    for n, rows in enumerate([[("a", 1), ("b", 2)], [("a", 5)], [("c", 1), ("a", 3)]]):
        spark.createDataFrame(rows, "k string, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = folds.file_stream(spark, str(tmp_path / "in"), "*.parquet", spark.createDataFrame([], "k string, v long").schema, per_batch=1)
    fold = lambda rows: rows.groupBy("k").agg(F.max("v").alias("v"), F.count(F.lit(1)).alias("n"))
    model = folds.upserted(stream, ["k"], fold, lambda rows: rows.groupBy("k").agg(F.max("v").alias("v"), F.sum("n").alias("n")), buckets=2)
    assert pairs(model, "k", "v", "n") == [("a", 5, 3), ("b", 2, 1), ("c", 1, 1)]


def test_owners_see_their_own(spark):
    runs = spark.createDataFrame([("1", "a", "RUNNING", 1), ("2", None, "RUNNING", 2), ("3", "b", "FAILED", 3)], "workflow_id string, owner string, status string, created_at long")
    assert pairs(eventlog.visible(runs, "a"), "workflow_id") == [("1",)]
    assert pairs(eventlog.page(runs, admin=True, status="running", size=1), "workflow_id", "total_elements", "total_pages") == [("2", 2, 2)]


def test_poison_records_go_aside(spark):
    raw = spark.createDataFrame([('{"a": 1}',), ("nonsense",), ('{"a": "x"}',)], "value string")
    good, bad = folds.decoded(raw, spark.createDataFrame([], "a int").schema)
    assert good.collect() == [(1,)] and bad.count() == 2


def test_exported_traces(spark):
    span = lambda i, p, s: {"traceId": "t", "spanId": i, "parentSpanId": p, "name": i, "startTimeUnixNano": str(s), "endTimeUnixNano": str(s + 5)}
    body = {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "api"}}]}, "scopeSpans": [{"spans": [span("a", "", 0), span("b", "a", 2_000_000), span("c", "gone", 1_000_000)]}]}]}
    spans = forensics.flat_spans(spark.createDataFrame([(json.dumps(body),)], "body string"))
    assert pairs(forensics.span_tree(spans), "span_id", "depth", "start_ms") == [("a", 0, 0.0), ("b", 1, 2.0), ("c", 0, 1.0)]
