"""Event logs as streams: windowed rates with late data, first-delivery filters, and the log of a directory of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.merge import replace_partitions
from millrace.storage import new_path, stored


def file_stream(spark: SparkSession, folder: str, pattern: str, schema: T.StructType, per_batch: int = 100) -> DataFrame:
    """Parquet files that appear in a folder, at most `per_batch` of them in a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(folder)


def windowed_counts(events: DataFrame, ts: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts by tumbling window and keys; rows later than `late` behind the newest are dropped, and windows come out once closed."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def first_deliveries(messages: DataFrame, keys: list[str], ts: str, within: str) -> DataFrame:
    """Messages without those whose keys came before, within a time that bounds the state."""
    return messages.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def decoded(raw: DataFrame, schema: T.StructType, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Messages by schema, and the texts that do not parse: one poison record never stops a batch."""
    with_bad = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = raw.withColumn("m", F.from_json(column, with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("m").isNull() | F.col("m._corrupt_record").isNotNull()
    return parsed.where(~bad).select(*[F.col(f"m.{f.name}") for f in schema.fields]), parsed.where(bad).select(column)


def drained(stream: DataFrame, name: str = "stream") -> DataFrame:
    """What an append-mode stream gives for all input that is there now, through a checkpointed file sink."""
    spark = stream.sparkSession
    out, state = new_path(spark, name), new_path(spark, f"{name}-state")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def upserted(stream: DataFrame, keys: list[str], fold: Callable[[DataFrame], DataFrame], combine: Callable[[DataFrame], DataFrame], name: str = "model", buckets: int = 32) -> DataFrame:
    """A read model by keys that a stream keeps up to date, for all input that is there now.

    fold: a batch to one row per key; combine: rows of the model and of folded batches to one row per key. The model lies in buckets by
    hash, and a batch rewrites those it has keys in. Each bucket names the last batch in it, so a batch that is repeated after a failure counts once.
    """
    spark = stream.sparkSession
    out, state = new_path(spark, name), new_path(spark, f"{name}-state")
    columns = fold(stream.sparkSession.createDataFrame([], stream.schema)).schema
    table = T.StructType([*columns.fields, T.StructField("_batch", T.LongType()), T.StructField("_bucket", T.IntegerType())])
    replace_partitions(spark.createDataFrame([], table), out, "_bucket")

    def merged(batch: DataFrame, number: int) -> None:
        folded = stored(fold(batch).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")), f"{name}-batch")
        touched = [r[0] for r in folded.select("_bucket").distinct().collect()]  # `buckets` at most
        old = spark.read.schema(table).parquet(out).where(F.col("_bucket").isin(touched))
        done = [r[0] for r in old.where(F.col("_batch") >= number).select("_bucket").distinct().collect()]
        both = old.unionByName(folded, allowMissingColumns=True).where(~F.col("_bucket").isin(done)).select(*columns.names)
        rows = combine(both).withColumns({"_batch": F.lit(number).cast("long"), "_bucket": F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")})
        replace_partitions(rows.select(*table.names), out, "_bucket")

    stream.writeStream.foreachBatch(merged).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(table).parquet(out).select(*columns.names)
