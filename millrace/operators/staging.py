"""Raw records to typed staging rows: parse, route rejects with a reason, clean, and keep the latest version of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.columns import DATE_ONLY, boxed_decimal, collapsed, hours_between, local_time, local_to_utc, title_case, trimmed
from millrace.operators.quality_gate import PROFILED, opened, raw_field

#: Raw fields that only the cleaning reads.
LATER = ("agency_name", "descriptor", "borough", "incident_zip", "status", "latitude", "longitude")
#: Raw fields that are kept beside what is read from them, for a profile.
KEPT = tuple(f for f in PROFILED if f not in LATER)


def parse(raw: DataFrame, as_of: Column | None = None) -> DataFrame:
    """run_id, partition_date, row_num, the fields that decide about a row, with local and UTC times, and the raw rest.

    What only changes how a row looks is left to `stage`, behind the removal of rejected rows and old versions. A text
    that only looks like a time gives null.
    """
    f = raw_field
    version = F.when(f(":updated_at").rlike(DATE_ONLY), F.try_to_timestamp(f(":updated_at")))
    out = opened(raw).select(
        "run_id",
        "partition_date",
        "row_num",
        *[f(k) for k in (*LATER, *KEPT)],
        trimmed(f("unique_key")).alias("unique_key"),
        local_time(f("created_date")).alias("created_local"),
        local_time(f("closed_date")).alias("closed_local"),
        version.alias("source_updated_at"),
        F.nullif(F.upper(F.trim(f("agency"))), F.lit("")).alias("agency_code"),
        collapsed(f("complaint_type")).alias("complaint_raw"),
    )
    out = out.withColumns({"created_at": local_to_utc(F.col("created_local")), "closed_raw": local_to_utc(F.col("closed_local"))})
    possible = (F.col("closed_raw") >= F.col("created_at")) & (F.col("closed_raw") <= (F.current_timestamp() if as_of is None else as_of))
    return out.withColumns({"closed_at": F.when(possible, F.col("closed_raw")), "impossible_close": F.col("created_at").isNotNull() & F.col("closed_raw").isNotNull() & ~F.coalesce(possible, F.lit(False))})


def with_reason(parsed: DataFrame) -> DataFrame:
    """parsed with reject_reason: the first that holds, or null. Accepted and rejected rows are told apart by this one column."""
    return parsed.withColumn(
        "reject_reason",
        F.when(F.col("unique_key").isNull(), "missing unique_key")
        .when(F.col("created_at").isNull(), "missing or invalid created_date")
        .when(F.col("agency_code").isNull(), "missing agency")
        .when(F.col("complaint_raw").isNull(), "missing complaint_type")
        .when(F.to_date("created_local") != F.col("partition_date"), "created_date outside partition"),
    )


def rejected(reasoned: DataFrame) -> DataFrame:
    return reasoned.where(F.col("reject_reason").isNotNull()).select("run_id", "partition_date", "row_num", "unique_key", F.col("reject_reason").alias("reason"))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key the first row in the order. Adaptive execution splits no key, so keys are identifiers, never categories."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", first).where("_place = 1").drop("_place")


def stage(reasoned: DataFrame) -> DataFrame:
    """Accepted rows in their final types, the latest version of each key of a partition."""
    f = raw_field
    newest = latest(reasoned.where(F.col("reject_reason").isNull()), ["unique_key", "partition_date", "run_id"], [F.col("source_updated_at").desc_nulls_last(), F.col("row_num").desc()])
    return newest.select(
        "run_id", "partition_date", "row_num", "unique_key", "created_at", "closed_at", "agency_code", trimmed(f("agency_name")).alias("agency_name"),
        title_case(F.col("complaint_raw")).alias("complaint_type"),
        F.coalesce(title_case(collapsed(f("descriptor"))), F.lit("")).alias("descriptor"),
        F.coalesce(F.nullif(F.nullif(F.upper(F.trim(f("borough"))), F.lit("")), F.lit("UNSPECIFIED")), F.lit("UNKNOWN")).alias("borough"),
        F.coalesce(F.regexp_extract(F.trim(f("incident_zip")), r"^(\d{5})", 1), F.lit("")).alias("zip"),
        title_case(trimmed(f("status"))).alias("status"),
        boxed_decimal(f("latitude"), "40.4", "41.0").alias("latitude"),
        boxed_decimal(f("longitude"), "-74.3", "-73.6").alias("longitude"),
        hours_between(F.col("created_at"), F.col("closed_at")).alias("resolution_hours"), "source_updated_at", F.to_date("created_local").alias("created_day"),
    )


def transform_stats(reasoned: DataFrame, staged: DataFrame) -> DataFrame:
    """run_id, partition_date, rows_in, rows_rejected, rows_out, duplicates_removed, impossible_closes."""
    keys = ["run_id", "partition_date"]
    seen = reasoned.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_in"), F.count("reject_reason").alias("rows_rejected"), F.count_if("impossible_close").alias("impossible_closes"))
    kept = staged.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_out"))
    out = seen.join(kept, keys, "left").withColumn("rows_out", F.coalesce("rows_out", F.lit(0)))
    return out.withColumn("duplicates_removed", F.col("rows_in") - F.col("rows_rejected") - F.col("rows_out"))
