"""A backfill or incremental run: all days of a range in one job per stage, from raw records to star schema and report.

Days are rows of one DataFrame, not tasks: gates are per day, days that fail are left out (and reported), and the
watermark moves only if all days were loaded. Running the same range again inserts and updates nothing.

Tables are folders of Parquet under one root. Those that grow are partitioned, facts and aggregates by the day (or
month) of the request, and a run overwrites the partitions that it changes and no others: it reads two columns of the
history to find them, and a rerun without news rewrites none. Writes follow one another so that a run that died is
repaired by running its range again: dimensions, aggregates, then the facts that tell whether there is news, statistics,
and the watermark and the run's status last.
"""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import merge, quality_gate, staging, star, watermark
from millrace.storage import deleted, removed, stored

FACT = (
    "unique_key string, created_date_key int, closed_date_key int, agency_key int, complaint_key int, location_key int, status string, created_at timestamp, closed_at timestamp, "
    "resolution_hours decimal(10,2), latitude decimal(9,6), longitude decimal(9,6), source_updated_at timestamp, run_id string, partition_date date"
)
#: Columns of each table; `part` and the columns behind the bar are its partitions.
TABLES = {
    "raw": "partition_date date, row_num long, payload string, extracted_at timestamp | run_id string",
    "fact": f"{FACT} | part string",
    "daily": "date_key int, borough string, complaint_type string, requests long, closed long, avg_resolution_hours decimal(10,2) | part string",
    "stats": "partition_date date, stage string, rows_in long, rows_out long, rows_rejected long, duplicates_removed long, rows_inserted long, rows_updated long, attempt int, checks string, updated_at timestamp | run_id string",
    "rejected": "partition_date date, row_num long, unique_key string, reason string | run_id string",
    "runs": "pipeline string, mode string, start_date date, end_date date, partitions int, status string, started_at timestamp, finished_at timestamp, report string | run_id string",
    "watermark": "complete_through date, last_run_id string | pipeline string",
    "agency": "agency_key int, agency_code string",
    "agency_names": "agency_code string, agency_name string",
    "complaint": "complaint_key int, complaint_type string, descriptor string",
    "location": "location_key int, borough string, zip string",
    "date": "date_key int, full_date date, year int, month int, day int, day_of_week int, is_weekend boolean",
}
#: Records are costly to parse: small row groups let several tasks read one file.
ROW_GROUPS = {"raw": {"parquet.block.size": 8 << 20}}
#: Days or months as partitions of the growing tables.
GRAINS = {"day": "yyyyMMdd", "month": "yyyyMM"}


class QualityError(RuntimeError):
    """Days that failed their gates, with the reasons."""


def _columns(name: str) -> tuple[str, list[str]]:
    """The schema of a table, and its partition columns."""
    own, _, parts = TABLES[name].partition(" | ")
    return f"{own}, {parts}" if parts else own, [p.split()[0] for p in parts.split(", ")] if parts else []


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table, empty where nothing was written yet."""
    schema, _ = _columns(name)
    try:
        return spark.read.schema(schema).parquet(f"{root}/{name}")
    except AnalysisException:
        return spark.createDataFrame([], schema)


def replace(df: DataFrame, root: str, name: str, small: bool = False) -> None:
    """Overwrites the partitions of a table that df has rows in, with files of a good size (one, if small); a table without partitions is overwritten whole."""
    schema, parts = _columns(name)
    names = df.sparkSession.createDataFrame([], schema).columns
    df = df.select(*names)
    if parts:
        merge.replace_partitions(df.coalesce(1) if small else df.hint("rebalance", *parts), f"{root}/{name}", *parts, **ROW_GROUPS.get(name, {}))
    else:
        df.coalesce(1).write.mode("overwrite").parquet(f"{root}/{name}")


def _grown(spark: SparkSession, root: str, name: str, fresh: DataFrame) -> DataFrame:
    """A dimension with fresh members behind it. New members are few, and rows that are there never change."""
    old = read(spark, root, name)
    fresh = stored(fresh.select(*old.columns), f"load-{name}", small=True)
    old = stored(old, f"load-old-{name}", small=True)
    if not fresh.isEmpty():
        fresh.write.mode("append").parquet(f"{root}/{name}")
    return old.unionByName(fresh)


def run(
    spark: SparkSession,
    raw: DataFrame,
    root: str,
    run_id: str,
    first: dt.date,
    last: dt.date,
    mode: str = "backfill",
    pipeline: str = "requests",
    limits: quality_gate.Limits = quality_gate.Limits(),
    as_of: Column | None = None,
    grain: str = "day",
    page_size: int = 50_000,
    fault: str = "none",
) -> Mapping[str, object]:
    """Loads the raw days first..last (partition_date, row_num, payload) into the tables at root and returns the report.

    fault "drop_created_date" takes that key out of all records: a change of the feed's schema, for tests of the gate.
    """
    began = time.monotonic()
    digits = len(GRAINS[grain])
    part = lambda key: F.substring((F.col(key) if isinstance(key, str) else key).cast("string"), 1, digits)
    n_days = (last - first).days + 1
    in_range = F.col("partition_date").between(first, last)
    low, high = (int(d.strftime("%Y%m%d")) for d in (first, last))

    # Plan: the run is known from its start on; running it again keeps the time of the first start.
    before = read(spark, root, "runs").where(F.col("run_id") == run_id).collect()
    started = before[0]["started_at"] if before else dt.datetime.now(dt.timezone.utc)

    def told(status: str, report: str | None) -> None:
        row = (pipeline, mode, first, last, n_days, status, started, None if status == "RUNNING" else dt.datetime.now(dt.timezone.utc), report, run_id)
        replace(spark.createDataFrame([row], _columns("runs")[0]), root, "runs", small=True)

    told("RUNNING", None)

    # Extract: the records of the run, replacing what an earlier attempt has left.
    payload = F.col("payload") if fault == "none" else F.to_json(F.map_filter(F.from_json("payload", "map<string,string>"), lambda k, v: k != "created_date"))
    fetched = raw.where(in_range).select("partition_date", "row_num", payload.alias("payload"), F.current_timestamp().alias("extracted_at"), F.lit(run_id).alias("run_id"))
    deleted(spark, f"{root}/raw/run_id={run_id}")
    replace(fetched, root, "raw")
    landed = read(spark, root, "raw").where(F.col("run_id") == run_id).select("run_id", "partition_date", "row_num", "payload")

    # Validate: a row per day of the range, as bounded as the range; a day without records has a profile too.
    days = spark.createDataFrame([(first, last)], "a date, b date").select(F.explode(F.sequence("a", "b")).alias("partition_date"))
    # Records are parsed once, whatever their day: profile, rejects, statistics and facts are read from what was kept of that.
    parsed = stored(staging.with_reason(staging.parse(landed, as_of)), "load-reasoned")
    profiled = quality_gate.profile_of(parsed, "partition_date")
    profiled = days.join(profiled, "partition_date", "left").fillna(0)
    gates = quality_gate.gate(profiled, limits)
    past = read(spark, root, "stats").where((F.col("stage") == "extract") & F.col("partition_date").between(first - dt.timedelta(limits.history_days), last - dt.timedelta(1)))
    history = past.groupBy(F.col("partition_date").alias("day")).agg(F.max_by("rows_out", "updated_at").alias("n_rows"))
    gates = stored(gates, "load-gates", small=True)
    volume = quality_gate.volume_check(gates.select(F.col("partition_date").alias("day"), F.col("total").alias("n_rows")), history, limits)
    low_text = F.when(F.col("status") == "failed", F.concat(F.lit("volume "), F.col("total").cast("string"), F.lit(" rows = "), F.col("ratio").cast("string"), F.lit("x the trailing "), F.lit(str(limits.history_days)), F.lit("-day median ("), F.floor("median").cast("string"), F.lit(f"), below {limits.min_volume_ratio}x: source likely not fully published")))
    verdicts = gates.join(volume.select(F.col("day").alias("partition_date"), "status", "ratio", "median", "history"), "partition_date")
    verdicts = verdicts.withColumn("reasons", F.concat_ws("; ", F.nullif("reasons", F.lit("")), low_text)).withColumn("passed", F.col("reasons") == "")
    verdicts = stored(verdicts, "load-verdicts", small=True)
    bad = verdicts.where("NOT passed").select("partition_date", "reasons").orderBy("partition_date").collect()

    # Transform: days that passed.
    reasoned = parsed.join(F.broadcast(verdicts.where("passed").select("partition_date")), "partition_date", "left_semi")
    staged = staging.stage(reasoned.drop(*[quality_gate.raw_field(f) for f in staging.KEPT]).repartition("unique_key"))
    # One key may come in several days: the latest version, then the later day, then the later row, meets the facts.
    # A key has one row a day by now. A maximum needs no order of its own: the rows stand by key already.
    newest = F.max(F.struct("source_updated_at", "partition_date")).over(staging.W.partitionBy("unique_key"))["partition_date"]
    staged = stored(staged.withColumns({"newest": F.col("partition_date") == newest, "part": part(star.local_date_key("created_at"))}), "load-staged")
    incoming = staged.where("newest")

    # Load: dimensions grow, then the facts that changed replace their partitions.
    def names_grown() -> DataFrame:
        names = stored(merge.update_names(read(spark, root, "agency_names"), star.best_names(incoming), "agency_code", "agency_name"), "load-names", small=True)
        if not names.where("_action <> 'keep'").isEmpty():
            replace(names, root, "agency_names")
        return names

    new_days = lambda: star.dim_date(star.request_days(incoming)).join(read(spark, root, "date").select("date_key"), "date_key", "left_anti")
    with ThreadPoolExecutor(6) as pool:  # small independent jobs
        growing = {name: pool.submit(lambda name=name, keys=keys: _grown(spark, root, name, merge.fresh_keys(read(spark, root, name), incoming, keys, f"{name}_key"))) for name, keys in star.NATURAL.items()}
        others = [pool.submit(lambda: _grown(spark, root, "date", new_days())), pool.submit(names_grown), pool.submit(lambda: replace(staging.rejected(reasoned), root, "rejected"))]
        dims = {name: f.result() for name, f in growing.items()}
        names = [f.result() for f in others][1]
    old = read(spark, root, "fact")
    known = old.select("unique_key", F.col("source_updated_at").alias("old_version"), F.col("part").alias("old_part"), F.lit(True).alias("there"))
    outcome = incoming.select("unique_key", "partition_date", "part", "source_updated_at").join(known, "unique_key", "left")
    action = F.when(F.col("there").isNull(), "insert").when(merge.newer(F.col("source_updated_at"), F.col("old_version")), "update").otherwise("unchanged")
    outcome = stored(outcome.select("unique_key", "partition_date", "part", "old_part", action.alias("action")), "load-outcome")
    changed = outcome.where("action <> 'unchanged'")
    # As many partitions as days or months, for each action: a short list.
    found = outcome.select("action", F.explode(F.array_compact(F.array("part", F.when(F.col("action") == "update", F.col("old_part"))))).alias("p")).distinct().collect()
    touched = {p for action, p in found if action != "unchanged"}
    if touched:
        ours = old.where(F.col("part").isin(sorted(touched))).join(changed.select("unique_key"), "unique_key", "left_anti")
        # Facts are made of changed rows only; where all rows are, as in a first load, none has to be looked up.
        news = incoming if all(action != "unchanged" for action, _ in found) else incoming.join(changed.select("unique_key"), "unique_key", "left_semi")
        contents = stored(ours.unionByName(star.facts(news, dims).withColumn("part", part("created_date_key"))), "load-contents")
        left = {r[0] for r in contents.select("part").distinct().collect()}
        again = star.daily_aggregate(contents, dims).withColumn("part", part("date_key"))
        replace(again, root, "daily")
        replace(contents, root, "fact")
        for name in ("fact", "daily"):
            for p in touched - left:  # all its facts have moved to other days
                deleted(spark, f"{root}/{name}/part={p}")
        removed(contents)

    # Statistics by day and stage: written again by a rerun of the run, so nothing counts twice.
    now = F.current_timestamp()
    of = lambda df, stage, checks, **c: df.select(F.lit(run_id).alias("run_id"), "partition_date", F.lit(stage).alias("stage"), *[c.get(k, F.lit(0 if k in ("rows_rejected", "duplicates_removed") else None)).cast("long").alias(k) for k in ("rows_in", "rows_out", "rows_rejected", "duplicates_removed", "rows_inserted", "rows_updated")], F.to_json(checks).alias("checks"))
    total = F.col("total")
    extract = of(verdicts, "extract", F.struct((F.floor(total / page_size) + 1).alias("pages"), F.lit(fault).alias("injected_fault")), rows_in=total, rows_out=total)
    shown = F.struct("total", *[c for c in verdicts.columns if c.endswith("_pct")], F.col("status").alias("volume"), "ratio", "median", F.col("history").alias("history_days"), "reasons", "passed")
    validate = of(verdicts, "validate", shown, rows_in=total, rows_out=total - F.col("missing_any"), rows_rejected=F.col("missing_any"), duplicates_removed=F.col("duplicates"))
    # A day that passed without records was loaded too.
    per_day = verdicts.where("passed").select("partition_date").join(staging.transform_stats(reasoned, staged).drop("run_id"), "partition_date", "left").fillna(0)
    transform = of(per_day, "transform", F.struct("impossible_closes"), rows_in=F.col("rows_in"), rows_out=F.col("rows_out"), rows_rejected=F.col("rows_rejected"), duplicates_removed=F.col("duplicates_removed"))
    counted = outcome.groupBy("partition_date").agg(*[F.count_if(F.col("action") == a).alias(n) for a, n in (("insert", "inserted"), ("update", "updated"))])
    loaded = per_day.select("partition_date", "rows_out").join(counted, "partition_date", "left").fillna(0)
    load = of(loaded, "load", F.struct((F.col("rows_out") - F.col("inserted") - F.col("updated")).alias("unchanged")), rows_in=F.col("rows_out"), rows_out=F.col("inserted") + F.col("updated"), rows_inserted=F.col("inserted"), rows_updated=F.col("updated"))
    fresh = extract.unionByName(validate).unionByName(transform).unionByName(load)
    keys = ["run_id", "partition_date", "stage"]
    held = stored(read(spark, root, "stats").where(F.col("run_id") == run_id), "load-held", small=True)
    attempts = held.select(*keys, F.col("attempt").alias("tried"))
    fresh = stored(fresh.join(attempts, keys, "left").withColumns({"attempt": (F.coalesce("tried", F.lit(0)) + 1).cast("int"), "updated_at": now}).drop("tried"), "load-stats", small=True)
    replace(held.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh), root, "stats", small=True)

    # Finalize: all days must have been loaded before the watermark moves.
    complete = fresh.where("stage = 'load'").select("partition_date").distinct().count() == n_days
    mark = read(spark, root, "watermark").where(F.col("pipeline") == pipeline).collect()
    current = mark[0]["complete_through"] if mark else None
    after = current
    if complete:
        after = watermark.advance(spark.createDataFrame([(current, first, last)], "current date, start_day date, end_day date")).collect()[0]["after"]
    if after != current:
        replace(spark.createDataFrame([(after, run_id, pipeline)], _columns("watermark")[0]), root, "watermark", small=True)
    when = lambda stage, column: F.coalesce(F.sum(F.when(F.col("stage") == stage, F.col(column))), F.lit(0))
    sums = fresh.agg(when("extract", "rows_out").alias("rows_extracted"), when("transform", "rows_rejected").alias("rows_rejected"), when("transform", "duplicates_removed").alias("duplicates_removed"), when("transform", "rows_out").alias("rows_accepted"), when("load", "rows_inserted").alias("rows_inserted"), when("load", "rows_updated").alias("rows_updated"))
    pruned = lambda name: read(spark, root, name).where(F.col("part").between(str(low)[:digits], str(high)[:digits]))
    ranged = pruned("fact").where(F.col("created_date_key").between(low, high))
    facts = ranged.agg(F.count(F.lit(1)).alias("fact_rows_in_range"))
    digest = star.checksum(ranged, [F.col(c).cast("string") for c in ("agency_key", "complaint_key", "location_key")])
    aggregates = pruned("daily").where(F.col("date_key").between(low, high)).agg(F.count(F.lit(1)).alias("aggregate_rows"))
    one = sums.join(facts, F.lit(True)).join(digest, F.lit(True)).join(aggregates, F.lit(True)).collect()[0]  # one row each
    seconds = time.monotonic() - began
    report = {
        "run_id": run_id, "mode": mode, "range": f"{first} to {last}", "partitions": n_days, **{k: one[k] for k in ("rows_extracted", "rows_rejected", "duplicates_removed", "rows_accepted", "rows_inserted", "rows_updated")},
        "rows_unchanged": one["rows_accepted"] - one["rows_inserted"] - one["rows_updated"], **{k: one[k] for k in ("fact_rows_in_range", "fact_checksum", "aggregate_rows")},
        "duration_s": round(seconds, 2), "rows_per_s": round(one["rows_extracted"] / seconds) if seconds else 0, "watermark_before": str(current) if current else None, "watermark_after": str(after) if after else None,
        "failed_days": [f"data quality gate failed for {r['partition_date']}: {r['reasons']}" for r in bad],
    }
    told("COMPLETED" if complete else "FAILED", json.dumps(report))
    removed(gates, verdicts, parsed, staged, outcome, held, fresh, names)
    return report


def checked(report: Mapping[str, object]) -> Mapping[str, object]:
    """The report, or an error that names the days that failed."""
    if report["failed_days"]:
        raise QualityError("; ".join(report["failed_days"]))
    return report
