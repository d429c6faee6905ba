"""Raw service requests: JSON records in daily partitions, from pages of a feed or made up from orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.quality_gate import FIELDS

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unnest_page(pages: DataFrame, page: str = "page", offset: str = "page_offset") -> DataFrame:
    """A row for each object of a page (a JSON array), with row_num = offset + place counted from 1."""
    items = F.from_json(F.col(page), T.ArrayType(T.MapType(T.StringType(), T.StringType())))
    keep = [c for c in pages.columns if c not in (page, offset)]
    return pages.select(*keep, offset, F.posexplode(items).alias("at", "record")).select(*keep, (F.col(offset) + F.col("at") + 1).alias("row_num"), "record")


def drop_key(record: Column, key: str) -> Column:
    """A record (map) without a key: a fault for tests of the quality gate."""
    return F.map_filter(record, lambda k, v: k != key)


def requests_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, partition_date, row_num, payload: an order as a service request, with faults dealt by the order's number."""
    order = table(spark, sf_dir, "orders")
    closes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("closed"))
    place = (
        table(spark, sf_dir, "customer")
        .join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "c_mktsegment", "r_name")
    )
    rows = order.join(place, F.col("o_custkey") == F.col("c_custkey")).join(closes, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k = F.col("o_orderkey")
    every = lambda n: k % n == 0
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    day = F.to_date("o_orderdate")
    created = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(0), (k % 24).cast("int"), (k % 60).cast("int"))
    copy = F.explode(F.when(every(89), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    rows = rows.select("*", copy)
    record = {
        "unique_key": F.when(every(101), F.lit(None)).when(every(103), F.lit("  ")).otherwise(F.concat(F.lit(" "), k.cast("string"))),
        "created_date": F.when(every(83), F.lit("not a date")).otherwise(iso(created)),
        "closed_date": iso(F.col("closed").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(23), (k % 60).cast("int"))),
        ":updated_at": F.when(every(107), F.lit(None)).otherwise(F.concat(iso(created + F.make_dt_interval(F.col("copy"))), F.lit("Z"))),
        "agency": F.when(every(97), F.lit(None)).otherwise(F.lower("c_mktsegment")),
        "agency_name": F.when(every(13), F.lit("")).otherwise(F.concat(F.lit("Department of "), "c_mktsegment")),
        "complaint_type": F.when(every(79), F.lit(" ")).otherwise(F.concat(F.lit(" "), F.regexp_replace("o_orderpriority", "-", " - "), F.lit("/side's a.b"))),
        "descriptor": F.when(every(11), F.lit(None)).otherwise(F.concat(F.lit("status  "), "o_orderstatus")),
        "borough": F.when(every(71), F.lit(None)).when(every(73), F.lit("unspecified")).otherwise(F.concat(F.lit(" "), F.lower("r_name"), F.lit(" "))),
        "incident_zip": F.when(every(67), F.lit("abc")).when(every(61), F.lit("10001-22")).otherwise(F.lpad(F.col("o_custkey").cast("string"), 5, "0")),
        "status": F.when(F.col("copy") == 1, F.lit("RE-OPENED")).when(every(59), F.lit("")).otherwise(F.lit("closed")),
        "latitude": F.when(every(53), F.lit("1e9")).otherwise(F.concat(F.lit("40."), F.lpad((k % 1000).cast("string"), 3, "0"))),
        "longitude": F.when(every(47), F.lit("-73.6\n")).otherwise(F.concat(F.lit("-73."), F.lpad((k % 1000).cast("string"), 3, "0"))),
    }
    payload = F.to_json(F.struct(*[record[f].alias(f) for f in FIELDS]))
    landed = F.when(every(91), F.date_add(day, 1)).otherwise(day)
    # A number that is the same in every run: the feed has one, and so has an order with its copy.
    return rows.select(F.lit("run-1").alias("run_id"), landed.alias("partition_date"), (k * 2 + F.col("copy")).alias("row_num"), payload.alias("payload"))
