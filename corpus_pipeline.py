"""A corpus from raw documents: quality rules, exact duplicates, near duplicates, source mix, packed sequences.

Each stage is a function of (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Stages are joined by Parquet in the shared folder, so a lost executor costs one stage's tasks at most. The
result of a stage is to be written before the next one begins, which deletes what the one before has left there.
Verdicts are found per row and take effect on that row: rows have a key of their own, as ids may be null or repeated.
A stage gives its rows keys where they have none; run() gives them once, for all stages up to the mix.

In every stage null and empty texts, null and repeated ids, repeated rows and further columns are rows like others: each
stage says what it does with them. An empty table stays empty. Columns come out as they went in, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import exact_dedup, mixing, near_dup, packing, quality
from millrace.llm.common import ROW, documents, labels, removed, rows_of, stored, with_row_key

#: Tables of a stage that its result reads.
_left: list[DataFrame] = []


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with row keys. Deletes the tables of earlier stages, but for those that docs itself reads."""
    reading = set(docs.inputFiles())
    for table in list(_left):
        if reading.isdisjoint(table.inputFiles()):
            removed(table)
            _left.remove(table)
    rows = with_row_key(docs, "pipeline-rows")
    if rows is not docs:
        _left.append(rows)
    return rows


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the n-gram ratio; null, empty and short texts go, and repeated rows share a verdict."""
    return quality.kept_documents(_keyed(docs), labels(spark, sf_dir)).select(*docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, with the smallest doc_id; a row without an id stays only where no copy has one, and of rows that tie one stays. Null equals the empty text."""
    rows = _keyed(docs)
    verdicts = stored(exact_dedup.exact_groups(rows, keep="smallest").select(ROW, "kept"), "pipeline-exact")
    return rows_of(rows, verdicts.where("kept")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row, with the smallest doc_id; a row without an id stays only where the class has none, and of rows that tie one stays. Texts without words are one class."""
    rows = _keyed(docs)
    verdicts = stored(near_dup.near_groups(rows).select(ROW, "kept"), "pipeline-near")
    return rows_of(rows, verdicts.where("kept")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, twice at most; null is a source of its own, texts without words are not taken, and rows with the same id are taken together."""
    return mixing.mixed(docs.drop(ROW))  # copies are no rows of their own


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces in sequences; null and empty texts are one end id, and repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("best_fit_packing", packed),
]

#: Hashed n-gram ratios and subword ids have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_row_key(documents(spark, sf_dir), "pipeline-rows")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out = stored(out, f"pipeline-{name}")
            removed(docs)
        docs = out
    return docs
