"""Writes that read first: newest-wins upserts, inserts of what is absent, replaced partitions and ranges, surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.ranges import with_running_sums


def newer(incoming: Column, existing: Column) -> Column:
    """Whether a version replaces another: strictly later, or a known one an unknown one."""
    return F.coalesce(incoming > existing, existing.isNull() & incoming.isNotNull())


def merge_newest_wins(existing: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The merged table with `_action`: insert, update, unchanged (incoming lost) or keep (nothing came in).

    Keys are unique on both sides. Only existing rows that stay carry `keep`, so callers rewrite partitions with another action.
    """
    values = [c for c in existing.columns if c not in keys]
    old = existing.select(*keys, F.struct(*values).alias("_old"))
    new = incoming.select(*keys, F.struct(*[F.col(c).cast(existing.schema[c].dataType).alias(c) for c in values]).alias("_new"))
    action = (
        F.when(F.col("_old").isNull(), "insert")
        .when(F.col("_new").isNull(), "keep")
        .when(newer(F.col(f"_new.{version}"), F.col(f"_old.{version}")), "update")
        .otherwise("unchanged")
    )
    joined = old.join(new, keys, "full_outer").withColumn("_action", action)
    picked = F.when(F.col("_action").isin("insert", "update"), F.col("_new")).otherwise(F.col("_old"))
    return joined.withColumn("_row", picked).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in values], "_action")


def outcome_counts(merged: DataFrame) -> DataFrame:
    """inserted, updated, unchanged: one row."""
    return merged.agg(*[F.count_if(F.col("_action") == a).alias(n) for a, n in (("insert", "inserted"), ("update", "updated"), ("unchanged", "unchanged"))])


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Incoming wins always; with `columns`, existing rows take only these and keep the rest."""
    values = [c for c in existing.columns if c not in keys]
    old = existing.select(*keys, F.struct(*values).alias("_old"))
    new = incoming.select(*keys, F.struct(*values).alias("_new"))
    both = old.join(new, keys, "full_outer")

    def pick(c: str) -> Column:
        if columns is None or c in columns:
            return F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
        return F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}"))

    return both.select(*keys, *[pick(c).alias(c) for c in values])


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """existing, and those rows of incoming (unique by key) whose key it lacks."""
    return existing.unionByName(incoming.join(existing.select(*keys), keys, "left_anti").select(*existing.columns))


def update_names(existing: DataFrame, incoming: DataFrame, key: str, name: str) -> DataFrame:
    """Names change only to known and different ones; unknown keys are added."""
    both = existing.select(key, F.col(name).alias("_old"), F.lit(True).alias("_there")).join(incoming.select(key, F.col(name).alias("_new")), key, "full_outer")
    changed = F.col("_there").isNotNull() & F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("_old"))
    return both.select(key, F.coalesce("_new", "_old").alias(name), F.when(F.col("_there").isNull(), "insert").when(changed, "update").otherwise("keep").alias("_action"))


def fresh_keys(existing: DataFrame, incoming: DataFrame, natural: list[str], key: str) -> DataFrame:
    """New natural keys (key, natural), numbered on from existing's greatest surrogate key in natural order, so reruns give the same keys."""
    fresh = incoming.select(*natural).distinct().join(existing.select(*natural), natural, "left_anti")
    top = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))  # one row
    numbered = with_running_sums(fresh, [F.col(c).asc() for c in natural], {"_n": F.lit(1)}, "keys").join(F.broadcast(top), F.lit(True))
    return numbered.select((F.col("_top") + F.col("_n") + 1).cast("int").alias(key), *natural)


def assign_keys(existing: DataFrame, incoming: DataFrame, natural: list[str], key: str) -> DataFrame:
    """existing with the fresh keys of incoming behind it."""
    return existing.select(key, *natural).unionByName(fresh_keys(existing, incoming, natural, key))


def replace_range(existing: DataFrame, rebuilt: DataFrame, inside: Column) -> DataFrame:
    """existing without its rows inside the range, and the rebuilt ones; a day that gets no rows disappears."""
    return existing.where(~F.coalesce(inside, F.lit(False))).unionByName(rebuilt.where(inside).select(*existing.columns))


def replace_partitions(df: DataFrame, path: str, *by: str, **options: object) -> None:
    """Overwrites just the partitions that df has rows in."""
    df.write.mode("overwrite").options(**options).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def conflicts(log: DataFrame, appended: DataFrame) -> DataFrame:
    """Rows to append whose (workflow_id, sequence) is taken: an append goes through only if there are none."""
    return appended.join(log.select("workflow_id", "sequence"), ["workflow_id", "sequence"], "left_semi")


def number_events(events: DataFrame, versions: DataFrame, order: list[Column]) -> DataFrame:
    """events with `sequence`: on from each workflow's expected version, in order of emission."""
    place = F.row_number().over(W.partitionBy("workflow_id").orderBy(*order))
    return events.join(versions.select("workflow_id", "version"), "workflow_id", "left").withColumn("sequence", F.coalesce("version", F.lit(0)).cast("long") + place).drop("version")
