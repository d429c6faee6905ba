import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import merge, quality_gate, staging, star, watermark
from millrace.plans import load, queries
from millrace.sources import raw, rest

DAY = dt.date(2026, 10, 5)
GOOD = {"unique_key": "1", "created_date": "2026-10-05T10:00:00", "closed_date": "2026-10-05T12:00:00", ":updated_at": "2026-10-06T00:00:00Z", "agency": "nypd", "agency_name": "Police", "complaint_type": "noise", "borough": "bronx", "incident_zip": "10001", "status": "closed", "latitude": "40.5", "longitude": "-74.0"}


def as_of():
    return F.lit(dt.datetime(2027, 1, 1))


def rows(spark, *records, day=DAY):
    return spark.createDataFrame([("r", day, n, json.dumps(GOOD | r)) for n, r in enumerate(records, 1)], "run_id string, partition_date date, row_num long, payload string")


def reasoned(spark, *records):
    return staging.with_reason(staging.parse(rows(spark, *records), as_of()))


@pytest.mark.parametrize(
    "change, reason",
    [
        ({}, None),
        ({"unique_key": " ", "created_date": ""}, "missing unique_key"),
        ({"created_date": None}, "missing or invalid created_date"),
        ({"created_date": "2026-13-01T00:00:00"}, "missing or invalid created_date"),
        ({"agency": ""}, "missing agency"),
        ({"complaint_type": "   "}, "missing complaint_type"),
        ({"created_date": "2026-10-04T23:59:00"}, "created_date outside partition"),
    ],
)
def test_first_reason_wins(spark, change, reason):
    assert reasoned(spark, change).select("reject_reason").collect()[0][0] == reason


def test_impossible_closes_are_nulled_and_counted(spark):
    r = reasoned(spark, {"closed_date": "2026-10-05T09:00:00"}, {"unique_key": "2", "closed_date": "2028-01-01T00:00:00"}, {"unique_key": "3", "closed_date": "2026-10-05T10:00:00"})
    staged = {x["unique_key"]: x for x in staging.stage(r).collect()}
    assert [staged[k]["closed_at"] is None for k in "123"] == [True, True, False]
    assert str(staged["3"]["resolution_hours"]) == "0.00"
    stats = staging.transform_stats(r, staging.stage(r)).collect()[0]
    assert (stats["rows_in"], stats["impossible_closes"], stats["duplicates_removed"]) == (3, 2, 0)


def test_cleaning(spark):
    x = staging.stage(reasoned(spark, {"complaint_type": "\tnoise  - street", "descriptor": None, "borough": "unspecified", "incident_zip": "10001-22", "longitude": "-73.6", "latitude": "1e9", "status": ""})).collect()[0]
    assert (x["complaint_type"], x["descriptor"], x["borough"], x["zip"], x["status"], x["latitude"], str(x["longitude"])) == (" Noise - Street", "", "UNKNOWN", "10001", None, None, "-73.600000")


@pytest.mark.parametrize("versions, winner", [(["2026-10-06T00:00:00Z", "2026-10-07T00:00:00Z"], 2), ([None, "2026-10-06T00:00:00Z"], 2), (["2026-10-06T00:00:00Z"] * 3, 3), (["2026-10-07T00:00:00Z", "2026-10-06T00:00:00Z"], 1)])
def test_latest_version_wins(spark, versions, winner):
    assert staging.stage(reasoned(spark, *[{":updated_at": v} for v in versions])).select("row_num").collect() == [(winner,)]


def test_profile_counts_missing_keys_as_duplicates(spark):
    p = quality_gate.profile(rows(spark, {}, {}, {"unique_key": None}, {"incident_zip": None, "borough": " "})).collect()[0]
    assert (p["total"], p["duplicates"], p["missing_unique_key"], p["missing_borough"], p["invalid_zip"]) == (4, 3, 1, 1, 1)


def test_empty_day_fails_its_gate(spark):
    g = quality_gate.gate(quality_gate.profile(rows(spark, {}).limit(0))).collect()[0]
    assert g["missing_agency_pct"] == 100.0 and not g["passed"]


@pytest.mark.parametrize("n, history, status", [(50, 4, "skipped"), (49, 5, "failed"), (50, 5, "passed")])
def test_volume(spark, n, history, status):
    past = spark.createDataFrame([(DAY - dt.timedelta(k), 100) for k in range(1, history + 1)], "day date, n_rows long")
    assert quality_gate.volume_check(spark.createDataFrame([(DAY, n)], "day date, n_rows long"), past).collect()[0]["status"] == status


@pytest.mark.parametrize("old, new, action", [(None, None, "unchanged"), (None, 1, "update"), (1, None, "unchanged"), (2, 1, "unchanged"), (1, 1, "unchanged"), (1, 2, "update")])
def test_newest_wins(spark, old, new, action):
    schema = "k int, v int, c string"
    m = merge.merge_newest_wins(spark.createDataFrame([(1, old, "old"), (2, 1, "only")], schema), spark.createDataFrame([(1, new, "new"), (3, None, "fresh")], schema), ["k"], "v")
    got = {x["k"]: (x["_action"], x["c"]) for x in m.collect()}
    assert got == {1: (action, "new" if action == "update" else "old"), 2: ("keep", "only"), 3: ("insert", "fresh")}


def test_surrogate_keys_go_on_and_stay(spark):
    first = merge.assign_keys(spark.createDataFrame([], "id int, a string"), spark.createDataFrame([("b",), ("a",), ("b",)], "a string"), ["a"], "id")
    again = merge.assign_keys(first, spark.createDataFrame([("b",), ("0",)], "a string"), ["a"], "id")
    assert {x["a"]: x["id"] for x in again.collect()} == {"a": 1, "b": 2, "0": 3}


def test_replaced_range_loses_days_without_rows(spark):
    old = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "d int, n int")
    assert sorted(merge.replace_range(old, spark.createDataFrame([(2, 9)], "d int, n int"), F.col("d").between(1, 2)).collect()) == [(2, 9), (3, 1)]


def test_replaced_partitions_leave_others(spark, tmp_path):
    path = str(tmp_path / "t")
    merge.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), path, "p")
    merge.replace_partitions(spark.createDataFrame([(9, "b")], "v int, p string"), path, "p")
    assert sorted((x["v"], x["p"]) for x in spark.read.parquet(path).collect()) == [(1, "a"), (9, "b")]


@pytest.mark.parametrize("current, first, last, after", [(None, "2024-01-01", "2024-01-31", "2024-01-31"), ("2024-01-31", "2024-02-01", "2024-02-10", "2024-02-10"), ("2024-01-31", "2024-02-02", "2024-02-10", "2024-01-31"), ("2024-01-31", "2024-01-01", "2024-01-10", "2024-01-31")])
def test_watermark(spark, current, first, last, after):
    d = lambda s: dt.date.fromisoformat(s) if s else None
    row = spark.createDataFrame([(d(current), d(first), d(last))], "current date, start_day date, end_day date")
    assert watermark.advance(row).collect()[0]["after"] == d(after)


def test_plan_has_a_chain_per_day():
    tasks = watermark.plan_tasks(DAY, DAY + dt.timedelta(2), "r")
    assert len(tasks) == 4 * 3 + 2 and tasks[-1]["dependsOn"] == [f"load-{DAY + dt.timedelta(n)}" for n in range(3)]
    assert watermark.incremental_window(dt.date(2024, 1, 31), dt.date(2024, 2, 5)) == (dt.date(2024, 1, 30), dt.date(2024, 2, 3))


def test_checksum_of_nothing_is_that_of_the_empty_text(spark):
    empty = staging.stage(reasoned(spark, {"agency": None}))
    assert star.checksum(empty, [F.col("agency_code")], "created_day").collect()[0][0] == "d41d8cd98f00b204e9800998ecf8427e"


LIMITS = quality_gate.Limits(min_rows=1, max_duplicate_pct=60.0)


def week(spark, change=lambda r: r):
    out = None
    for n in range(3):
        day = DAY + dt.timedelta(n)
        records = [change({"unique_key": f"{n}-{k}", "created_date": f"{day}T10:00:00", "closed_date": None}) for k in range(4)]
        part = rows(spark, *records, day=day).drop("run_id")
        out = part if out is None else out.union(part)
    return out


@pytest.mark.parametrize("grain", ["day", "month"])
def test_backfill_rerun_update_and_bad_day(spark, tmp_path, grain):
    root = str(tmp_path / "house")
    days = (DAY, DAY + dt.timedelta(2))
    go = lambda rows, where, run_id, **more: load.run(spark, rows, where, run_id, *days, limits=LIMITS, as_of=as_of(), grain=grain, **more)
    first = load.checked(go(week(spark), root, "r1"))
    assert (first["rows_inserted"], first["rows_updated"], first["fact_rows_in_range"], first["watermark_after"]) == (12, 0, 12, str(days[1]))
    files = sorted(load.read(spark, root, "fact").inputFiles())
    again = go(week(spark), root, "r2")
    assert (again["rows_inserted"], again["rows_updated"], again["rows_unchanged"], again["fact_checksum"]) == (0, 0, 12, first["fact_checksum"])
    assert sorted(load.read(spark, root, "fact").inputFiles()) == files  # nothing new: no partition is written
    newer = week(spark, lambda r: r | ({":updated_at": "2026-12-01T00:00:00Z", "status": "open"} if r["unique_key"] == "1-1" else {}))
    third = go(newer, root, "r3")
    assert (third["rows_inserted"], third["rows_updated"]) == (0, 1) and third["fact_checksum"] != first["fact_checksum"]
    if grain == "day":
        assert len(set(load.read(spark, root, "fact").inputFiles()) & set(files)) == len(files) - 1
    if grain == "month":
        return
    # The same run again: its statistics are replaced and not added.
    fourth = go(newer, root, "r3")
    stats = load.read(spark, root, "stats")
    assert fourth["rows_extracted"] == 12 and stats.where("run_id = 'r3'").count() == 12 and {r[0] for r in stats.where("run_id = 'r3'").select("attempt").collect()} == {2}
    assert {(r["run_id"], r["status"]) for r in load.read(spark, root, "runs").collect()} == {("r1", "COMPLETED"), ("r2", "COMPLETED"), ("r3", "COMPLETED")}
    bad = week(spark, lambda r: r | ({"agency": None} if r["unique_key"].startswith("1-") else {}))
    fresh = str(tmp_path / "fresh")
    report = go(bad, fresh, "r1")
    assert report["rows_inserted"] == 8 and report["watermark_after"] is None and report["failed_days"] == [f"data quality gate failed for {DAY + dt.timedelta(1)}: missing_agency_pct=100.0% > 1.0%"]
    assert {r["stage"] for r in load.read(spark, fresh, "stats").where(F.col("partition_date") == DAY + dt.timedelta(1)).collect()} == {"extract", "validate"}
    assert load.read(spark, fresh, "runs").collect()[0]["status"] == "FAILED"
    with pytest.raises(load.QualityError):
        load.checked(report)


def test_facts_that_move_leave_no_empty_day_behind(spark, tmp_path):
    root, days = str(tmp_path / "house"), (DAY, DAY + dt.timedelta(1))
    go = lambda rows, run_id: load.run(spark, rows, root, run_id, *days, limits=quality_gate.Limits(min_rows=0, max_missing_pct=100.0, max_borough_pct=100.0, max_zip_pct=100.0), as_of=as_of())
    at = lambda day, version: rows(spark, {"unique_key": "k", "created_date": f"{day}T10:00:00", ":updated_at": version}, day=day).drop("run_id")
    assert go(at(days[0], "2026-11-01T00:00:00Z"), "r1")["fact_rows_in_range"] == 1
    moved = go(at(days[1], "2026-11-02T00:00:00Z"), "r2")
    assert (moved["rows_updated"], moved["fact_rows_in_range"], moved["aggregate_rows"]) == (1, 1, 1)
    assert [r["created_date_key"] for r in load.read(spark, root, "fact").collect()] == [int(days[1].strftime("%Y%m%d"))]


def test_days_without_records_and_faults_fail(spark, tmp_path):
    days = (DAY, DAY + dt.timedelta(3))
    report = load.run(spark, week(spark), str(tmp_path / "a"), "r", *days, limits=LIMITS, as_of=as_of())
    assert len(report["failed_days"]) == 1 and "row_count=0 outside 1..100000" in report["failed_days"][0]
    report = load.run(spark, week(spark), str(tmp_path / "b"), "r", *days, limits=LIMITS, as_of=as_of(), fault="drop_created_date")
    assert len(report["failed_days"]) == 4 and "missing_created_date_pct=100.0% > 1.0%" in report["failed_days"][0]


def test_volume_is_held_against_the_median_of_earlier_runs(spark, tmp_path):
    root = str(tmp_path / "house")
    many = None
    for n in range(7):
        day = DAY + dt.timedelta(n)
        part = rows(spark, *[{"unique_key": f"{n}-{k}", "created_date": f"{day}T10:00:00", "closed_date": None} for k in range(10 if n < 6 else 4)], day=day).drop("run_id")
        many = part if many is None else many.union(part)
    go = lambda run_id, a, b: load.run(spark, many, root, run_id, DAY + dt.timedelta(a), DAY + dt.timedelta(b), limits=LIMITS, as_of=as_of())
    assert not go("r1", 0, 5)["failed_days"]
    assert go("r2", 6, 6)["failed_days"] == [f"data quality gate failed for {DAY + dt.timedelta(6)}: volume 4 rows = 0.4x the trailing 14-day median (10), below 0.5x: source likely not fully published"]


def test_pages_end_at_the_first_that_is_not_full():
    asked = []

    def fetch(query):
        asked.append(int(query["$offset"]))
        return [{"k": n} for n in range(*slice(int(query["$offset"]), int(query["$offset"]) + 2).indices(4))]

    got = list(rest.day_rows(DAY, 2, fetch))
    assert asked == [0, 2, 4] and [r[1] for r in got] == [1, 2, 3, 4]


def test_feed_over_http(spark):
    import http.server
    import threading
    import urllib.parse

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query))
            body = json.dumps([{"n": n} for n in range(int(q["$offset"]), min(3, int(q["$offset"]) + int(q["$limit"])))]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(rest.RequestFeed)
    feed = spark.read.format("request_feed").options(url=f"http://127.0.0.1:{server.server_port}/", first="2024-01-01", last="2024-01-02", page_size="2").load()
    assert sorted((str(r[0]), r[1]) for r in feed.collect()) == [(f"2024-01-0{d}", n) for d in (1, 2) for n in (1, 2, 3)]
    server.shutdown()


def test_unnest_numbers_from_one_and_drop_key(spark):
    pages = spark.createDataFrame([('[{"a": "x"}, {"a": "y", "b": "z"}]', 50)], "page string, page_offset long")
    out = raw.unnest_page(pages)
    assert sorted((r["row_num"], r["record"]["a"]) for r in out.collect()) == [(51, "x"), (52, "y")]
    assert out.select(F.size(raw.drop_key(F.col("record"), "a")).alias("n")).agg(F.sum("n")).collect()[0][0] == 1


def test_staged_rows_are_computed_once_for_the_star(spark, sf_dir, monkeypatch):
    """Raw rows that a task has made are counted, whatever reads them: one pass for dimensions, facts and days."""
    orders = raw.table(spark, sf_dir, "orders").count()
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    made = raw.requests_from_orders
    n = made(spark, sf_dir).count()
    assert n > orders  # some have a copy
    monkeypatch.setattr(raw, "requests_from_orders", lambda *a: (df := made(*a)).mapInArrow(counted, df.schema))
    for name in ("agg_daily", "fact_star_join", "dim_location", "dim_date"):
        before = seen.value
        queries.QUERIES[name](spark, sf_dir).collect()
        assert seen.value - before == n, name


def test_stored_dimensions_are_small_to_joins(spark):
    rows = spark.createDataFrame([("A", "X", "", "B", "1"), ("A", "Y", "", "B", "2")], "agency_code string, complaint_type string, descriptor string, borough string, zip string")
    dims = star.dimensions(rows)
    assert all(d.inputFiles() for d in dims.values())
    assert star.dimension("location", rows, dims["location"]).orderBy("location_key").collect() == dims["location"].orderBy("location_key").collect()


def test_a_load_parses_records_once_and_a_rerun_makes_no_facts(spark, tmp_path, monkeypatch):
    parsed, made = [], []
    inside, facts = quality_gate.opened, star.facts
    monkeypatch.setattr(staging, "opened", lambda *a: parsed.append(a) or inside(*a))
    monkeypatch.setattr(quality_gate, "opened", lambda *a: parsed.append(a) or inside(*a))
    monkeypatch.setattr(star, "facts", lambda *a: made.append(a) or facts(*a))
    day = dt.date(2024, 1, 1)
    record = {"unique_key": "1", "created_date": "2024-01-01T10:00:00", "agency": "a", "complaint_type": "noise", ":updated_at": "2024-01-01T10:00:00Z"}
    rows = spark.createDataFrame([(day, k, json.dumps(record | {"unique_key": str(k)})) for k in range(1, 4)], "partition_date date, row_num long, payload string")
    reports = [load.run(spark, rows, f"file://{tmp_path}/house", f"run-{n}", day, day, limits=queries.OPEN) for n in (1, 2)]
    assert [(r["rows_inserted"], r["rows_unchanged"], r["fact_rows_in_range"]) for r in reports] == [(3, 0, 3), (0, 3, 3)]
    assert reports[0]["fact_checksum"] == reports[1]["fact_checksum"]
    assert (len(parsed), len(made)) == (2, 1)
