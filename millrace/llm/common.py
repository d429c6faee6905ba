"""What the operators of this subpackage share: words, shared storage and id columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.ranges import with_running_sums
from millrace.storage import new_path, removed, shared_folder, stored

__all__ = ["dealt", "documents", "free_name", "labels", "new_path", "pages", "removed", "rows_of", "shared_folder", "stored", "text_of", "with_row_key", "with_running_sums", "word_array"]

#: ASCII white space that separates words; every other character belongs to a word.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def text_of(column: str) -> Column:
    """The text as a string, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_array(text: Column) -> Column:
    """The words of a text, in order; an empty array for a text without words."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def dealt(rows: DataFrame, n_bytes: int, *by: str, per_task: int = 1 << 27) -> DataFrame:
    """rows that each stand for a part of a file, dealt by `by` over tasks of about per_task bytes of file.

    The rows themselves are tiny: only a fixed number of partitions keeps adaptive execution from putting them all into one task.
    """
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(1, usual, -(-n_bytes // per_task)), *by)


def free_name(df: DataFrame, name: str) -> str:
    """name, or one like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


#: The column that tells rows apart where ids are missing or repeated.
ROW = "row_key"


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number of its own for each row in ROW; written once, so that every reading finds the same numbers."""
    if ROW in docs.columns:
        return docs
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), name)


def rows_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose ROW is in kept, which has each of them once."""
    # Kept rows grow with the corpus, so they are dealt like the documents and never broadcast.
    chosen = kept.select(F.col(ROW).alias("kept_row")).hint("shuffle_hash")
    return docs.join(chosen, docs[ROW] == chosen["kept_row"], "left_semi")
