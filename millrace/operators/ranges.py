"""Sums and numbers along an order of all rows, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.storage import stored


def with_running_sums(df: DataFrame, order: list[Column], values: dict[str, Column], name: str = "ranges") -> DataFrame:
    """df with a column for each of values: its sum over all rows that stand before the row in the order (0 for the first).

    Rows are dealt by ranges of the order and summed inside their range; the only window without a key runs over one row per range.
    """
    ranged = stored(df.withColumns({f"_{k}": v for k, v in values.items()}).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    bases = ranged.groupBy("_range").agg(*[F.sum(f"_{k}").alias(f"_{k}_all") for k in values])
    bases = bases.select(F.col("_range").alias("_of"), *[F.coalesce(F.sum(f"_{k}_all").over(before), F.lit(0)).alias(f"_{k}_base") for k in values])
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    summed = ranged.withColumns({f"_{k}_in": F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0)) for k in values}).join(bases, F.col("_range") == F.col("_of"))
    return summed.select(*df.columns, *[(F.col(f"_{k}_base") + F.col(f"_{k}_in")).alias(k) for k in values])
