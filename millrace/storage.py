"""Where lineage is cut: the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder on a local master, as in tests, and an error on a cluster, whose executors would not see it."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
    global _own
    if _own is None:
        _own = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df on the shared folder: what follows neither recomputes nor loses it with an executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there and a lost executor costs no recomputation.

    small: a table far smaller than its input; it is written in a fifth as many files as a shuffle has partitions.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if small:
        df = df.coalesce(max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 5))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def removed(*tables: DataFrame) -> None:
    """Deletes the files of `stored` tables. Only for tables that nothing reads any more; tables from elsewhere are left alone."""
    for table in tables:
        spark = table.sparkSession
        base = shared_folder(spark)
        folders = {f.rpartition("/")[0] for f in table.inputFiles()}
        for folder in folders:
            if re.sub("^file:/+", "/", folder).startswith(re.sub("^file:/+", "/", base) + "/"):
                deleted(spark, folder)
