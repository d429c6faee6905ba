"""The star schema: dimensions, facts, daily aggregate, checksums."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import date_key
from millrace.operators.merge import assign_keys
from millrace.storage import stored

#: Natural keys of the dimensions.
NATURAL = {"agency": ["agency_code"], "complaint": ["complaint_type", "descriptor"], "location": ["borough", "zip"]}
#: What a fact takes from a staged row as it is, behind its keys.
CARRIED = ("status", "created_at", "closed_at", "resolution_hours", "latitude", "longitude", "source_updated_at", "run_id", "partition_date")


def dim_date(days: DataFrame, day: str = "day") -> DataFrame:
    """date_key, full_date, year, month, day, day_of_week (Monday 1), is_weekend of distinct days."""
    d = F.col(day)
    weekday = F.weekday(d) + 1
    return days.where(d.isNotNull()).select(day).distinct().select(
        date_key(d).alias("date_key"), d.alias("full_date"), F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"), weekday.alias("day_of_week"), (weekday >= 6).alias("is_weekend")
    )


def request_days(staged: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """All local days on which a request was made or closed."""
    local = lambda c: F.to_date(F.from_utc_timestamp(c, zone))
    # Both days of a row at once: a union would compute the rows twice.
    return staged.select(F.explode(F.array_compact(F.array(local("created_at"), local("closed_at")))).alias("day")).distinct()


def best_names(staged: DataFrame, key: str = "agency_code", name: str = "agency_name") -> DataFrame:
    """The smallest known name of each code."""
    return staged.groupBy(key).agg(F.min(name).alias(name))


def dimension(name: str, staged: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One of the dimensions, grown from an existing one (or none). It is stored: joins see its true size, and its keys are given out once."""
    key, natural = f"{name}_key", NATURAL[name]
    if existing is None:
        existing = staged.sparkSession.createDataFrame([], f"{key} int, {', '.join(f'{c} string' for c in natural)}")
    return stored(assign_keys(existing, staged, natural, key), f"dimension-{name}", small=True)


def dimensions(staged: DataFrame, agencies: DataFrame | None = None, complaints: DataFrame | None = None, locations: DataFrame | None = None) -> dict[str, DataFrame]:
    """agency, complaint and location dimensions, grown from existing ones (or none). Each reads staged, so staged should be stored."""
    with ThreadPoolExecutor(3) as pool:  # small independent jobs
        growing = {name: pool.submit(dimension, name, staged, old) for name, old in zip(NATURAL, (agencies, complaints, locations))}
        return {name: f.result() for name, f in growing.items()}


def local_date_key(c: Column | str, zone: str = "America/New_York") -> Column:
    """The date key of a time's local day."""
    return date_key(F.to_date(F.from_utc_timestamp(c, zone)))


def facts(staged: DataFrame, dims: dict[str, DataFrame], zone: str = "America/New_York") -> DataFrame:
    """One row per request with the keys of its dimensions and those of unique_key and CARRIED that staged has. Spark broadcasts a dimension while its size allows it."""
    joined = staged.join(dims["agency"], "agency_code").join(dims["complaint"], ["complaint_type", "descriptor"]).join(dims["location"], ["borough", "zip"])
    there = lambda *names: [c for c in names if c in staged.columns]
    return joined.select(*there("unique_key"), local_date_key("created_at", zone).alias("created_date_key"), local_date_key("closed_at", zone).alias("closed_date_key"), "agency_key", "complaint_key", "location_key", *there(*CARRIED))


def daily_aggregate(fact: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """date_key, borough, complaint_type, requests, closed, avg_resolution_hours."""
    joined = fact.join(dims["location"], "location_key").join(dims["complaint"], "complaint_key")
    return joined.groupBy(F.col("created_date_key").alias("date_key"), "borough", "complaint_type").agg(
        F.count(F.lit(1)).alias("requests"), F.count("closed_at").alias("closed"), F.round(F.avg("resolution_hours"), 2).cast("decimal(10,2)").alias("avg_resolution_hours")
    )


def fact_line(keys: list[Column]) -> Column:
    """What a fact contributes to a checksum: key, status, closing time, then the given keys, joined by a bar."""
    return F.concat_ws("|", "unique_key", F.coalesce("status", F.lit("")), F.coalesce(F.date_format("closed_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")), *keys)


def checksum(fact: DataFrame, keys: list[Column], day: str = "created_date_key") -> DataFrame:
    """fact_checksum in one row: the MD5 of all days' digests in order of days, a day's being the MD5 of its lines in order of keys.

    A day, which the quality gate bounds, is the most that meets in one task; above it stands one text per day. Without facts it is that of the empty text.
    """
    line = lambda rows: F.md5(F.array_join(F.transform(F.array_sort(rows), lambda x: x["line"]), ","))
    days = fact.groupBy(day).agg(line(F.collect_list(F.struct("unique_key", fact_line(keys).alias("line")))).alias("digest"))
    return days.agg(line(F.collect_list(F.struct(day, F.concat_ws(":", F.col(day).cast("string"), "digest").alias("line")))).alias("fact_checksum"))


def checksum_by_day(fact: DataFrame, keys: list[Column], day: str = "created_date_key") -> DataFrame:
    """day, facts, day_checksum: order-free sums of 60-bit parts of each line's MD5; a day's facts never meet in one task."""
    digest = F.md5(fact_line(keys))
    part = lambda start: F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(38,0)")
    return fact.groupBy(day).agg(F.count(F.lit(1)).alias("facts"), F.concat_ws("-", F.sum(part(1)).cast("string"), F.sum(part(16)).cast("string")).alias("day_checksum"))
