"""One-pass quality profiles of raw partitions, gates on them, and a volume check against the trailing median."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import half_up, percent

#: Columns that a request must have, in the order of the reports.
REQUIRED = ("unique_key", "created_date", "agency", "complaint_type")
#: Raw fields that a profile reads.
PROFILED = (*REQUIRED, "borough", "incident_zip")


@dataclass(frozen=True)
class Limits:
    """Thresholds of the gate. Percentages are compared after rounding to 2 places."""

    min_rows: int = 1_000
    max_rows: int = 100_000
    max_missing_pct: float = 1.0
    max_borough_pct: float = 10.0
    max_zip_pct: float = 25.0
    max_duplicate_pct: float = 5.0
    min_volume_ratio: float = 0.5
    min_history_days: int = 5
    history_days: int = 14


#: Keys of a raw record.
FIELDS = (
    "unique_key", "created_date", "closed_date", ":updated_at", "agency", "agency_name", "complaint_type",
    "descriptor", "borough", "incident_zip", "status", "latitude", "longitude",
)
_RECORD = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])


def opened(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """raw with a column for each key (see raw_field) in place of the JSON text.

    The generator parses a record once: filters on a key stay above it and no expression repeats the parse.
    """
    keep = [c for c in raw.columns if c != payload]
    return raw.select(*keep, F.inline(F.array(F.from_json(payload, _RECORD))).alias(*[_column(f) for f in FIELDS]))


def _column(name: str) -> str:
    return "raw_" + name.strip(":")


def raw_field(name: str) -> Column:
    """A key of the raw record as text, on what `opened` returns."""
    return F.col(_column(name))


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def profile(raw: DataFrame, *by: str) -> DataFrame:
    """Counts of rows, of missing values by column and in any required one, bad zips and duplicate keys, in one aggregation.

    A missing key counts as a duplicate, since the distinct keys leave it out.
    """
    return profile_of(opened(raw), *by)


def profile_of(records: DataFrame, *by: str) -> DataFrame:
    """The profile of records that are open already and have their raw keys (see raw_field)."""
    fields = records.select(*by, *[raw_field(f).alias(f) for f in PROFILED])
    missing = [blank(F.col(c)) for c in REQUIRED]
    anything = missing[0]
    for m in missing[1:]:
        anything = anything | m
    return fields.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(m).alias(f"missing_{c}") for c, m in zip(REQUIRED, missing)],
        F.count_if(anything).alias("missing_any"),
        F.count_if(blank(F.col("borough")) | (F.upper(F.trim("borough")) == "UNSPECIFIED")).alias("missing_borough"),
        F.count_if(F.coalesce(~F.trim("incident_zip").rlike(r"^\d{5}"), F.lit(True))).alias("invalid_zip"),
        (F.count(F.lit(1)) - F.countDistinct("unique_key")).alias("duplicates"),
    )


def gate(profiled: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The profile with percentages, `failures` (names joined by "; "), `reasons` (texts with the values) and `passed`."""
    shares = {f"{c}_pct": percent(F.col(c), F.col("total")) for c in (*[f"missing_{c}" for c in REQUIRED], "missing_borough", "invalid_zip", "duplicates")}
    rated = profiled.withColumns(shares)
    text = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("string")
    checks: list[tuple[str, Column, Column]] = [
        ("row_count", F.col("total").between(limits.min_rows, limits.max_rows), F.concat(F.lit("row_count="), text(F.col("total")), F.lit(f" outside {limits.min_rows}..{limits.max_rows}")))
    ]
    most = [(f"missing_{c}", f"missing_{c}_pct", limits.max_missing_pct) for c in REQUIRED]
    most += [("missing_borough", "missing_borough_pct", limits.max_borough_pct), ("invalid_zip", "invalid_zip_pct", limits.max_zip_pct), ("duplicates", "duplicate_pct", limits.max_duplicate_pct)]
    for name, shown, limit in most:
        share = F.col(f"{name}_pct")
        checks.append((name, share <= limit, F.concat(F.lit(f"{shown}="), text(share), F.lit(f"% > {float(limit)}%"))))
    joined = lambda k: F.concat_ws("; ", *[F.when(~c[1], c[k] if k else F.lit(c[0])) for c in checks])
    return rated.withColumn("failures", joined(0)).withColumn("reasons", joined(2)).withColumn("passed", F.col("failures") == "")


def volume_check(days: DataFrame, history: DataFrame, limits: Limits = Limits(), day: str = "day", rows: str = "n_rows") -> DataFrame:
    """Each day's rows against the median of the days before it: day, n_rows, history, median, ratio, status (passed, failed, skipped).

    history is the same table of days as of the start of the run.
    """
    past = history.select(F.col(day).alias("past_day"), F.col(rows).alias("past_rows"))
    # Each past day is put beside the days that it is history of, so that the join is on equal days and not on a range.
    shifted = past.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(limits.history_days)), lambda n: F.date_add("past_day", n))).alias(day), "past_day", "past_rows")
    joined = days.join(shifted, day, "left")
    out = joined.groupBy(day, rows).agg(F.count("past_rows").alias("history"), F.percentile("past_rows", F.lit(0.5)).alias("median"))
    ratio = F.when((F.col("history") >= limits.min_history_days) & (F.col("median") > 0), half_up(F.col(rows) / F.col("median")))
    status = F.when(F.col("history") < limits.min_history_days, "skipped").when(ratio >= limits.min_volume_ratio, "passed").otherwise("failed")
    return out.select(day, rows, "history", "median", ratio.alias("ratio"), status.alias("status"))
