"""Token counts from flat token files by separator scan.

A token file is nothing but token ids of a fixed width, one document after the other, each ended by an end-of-document
id; it has no index. Files are read in blocks by many tasks: each searches its block for the end id with one array
comparison. What a block cannot know is how many documents ended before it and where the last of them did. Those two
numbers per block go through a prefix scan (a window over one row per block), and joining them back gives every
document its ordinal, start and number of tokens, also where it lies across many blocks.

Edge cases: an empty document (two end ids in a row, or null and empty texts when files are written) has 0 tokens;
tokens behind the last end id are a document that is not complete; an empty file has no documents; rows with equal or
null ids are documents each; an id that the width cannot hold is an error, never a wrong id; an empty table gives an
empty result; only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import dealt, new_path, stored
from millrace.llm.files import attempt_name, opened, output
from millrace.llm.tokens import DEFAULT, tokenizer

END = 49407
WIDTH = "<u2"
#: Bytes of a block.
BLOCK = 1 << 22


def _flat(folder: str, name: str, end: int, width: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # An id of the separator inside a text would end its document, so special tokens are ordinary text here.
        tok, last = tokenizer(name, plain_marks=True), np.array([end], width)
        most = np.iinfo(width).max
        stream = file = None
        ordinal = written = 0
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if stream is None:
                    stream, file = output(folder, attempt_name(".tokens"))
                for ids in tok.encode(batch.column(1)):
                    if len(ids) and int(ids.max()) > most:
                        raise ValueError(f"token id {ids.max()} does not fit into {width}")
                    data = ids.astype(width).tobytes() + last.tobytes()
                    stream.write(data)
                    written += len(data)
                n = batch.num_rows
                yield pa.record_batch([pa.array([file] * n), pa.array(np.arange(ordinal, ordinal + n)), batch.column(0), pa.array(np.full(n, -1))], names=["file", "ordinal", "doc_id", "bytes"])
                ordinal += n
            if stream is not None:
                yield pa.record_batch([pa.array([file]), pa.array([-1]), pa.array([None], pa.int64()), pa.array([written])], names=["file", "ordinal", "doc_id", "bytes"])
        finally:
            if stream is not None:
                stream.close()

    return run


def write_tokens(docs: DataFrame, folder: str | None = None, tokenizer_file: str = DEFAULT, end: int = END, width: str = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Writes flat token files. Returns the files (file, bytes) and the order of documents in them (file, ordinal, doc_id), which the files do not hold."""
    folder = folder or new_path(docs.sparkSession, "tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = stored(rows.mapInArrow(_flat(folder, tokenizer_file, end, width), "file string, ordinal long, doc_id long, bytes long"), "token-order")
    return told.where("ordinal < 0").select("file", "bytes"), told.where("ordinal >= 0").select("file", "ordinal", "doc_id")


def _scan(end: int, width: str, block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (file, block, nth, at, before): of each end id its number in the block, its place and that of the one before; and one with nth -1: number of end ids, and the last one."""
    size = np.dtype(width).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, k, start, stop in zip(*(batch.column(i).to_pylist() for i in range(4))):
                where, path = opened(file)
                with where.open_input_file(path) as source:
                    ids = np.frombuffer(source.read_at(stop - start, start), width)
                at = np.flatnonzero(ids == end) + start // size
                n = len(at)
                before = [None, *at[:-1].tolist()] if n else []
                yield pa.record_batch(
                    [pa.array([file] * (n + 1)), pa.array(np.full(n + 1, k)), pa.array(np.arange(-1, n)), pa.array([int(at[-1]) if n else None, *at.tolist()], pa.int64()), pa.array([n, *before], pa.int64()), pa.array(np.full(n + 1, stop // size))],
                    names=["file", "block", "nth", "at", "before", "stop"],
                )

    return run


def count_tokens(files: DataFrame, end: int = END, width: str = WIDTH, block: int = BLOCK) -> DataFrame:
    """file, ordinal, start, n_tokens, complete: one row per document of the files (file, bytes)."""
    size = np.dtype(width).itemsize
    block -= block % size
    usable = F.col("bytes") - F.col("bytes") % size
    blocks = files.where(usable > 0).select("file", usable.alias("usable")).select("file", "usable", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("usable") - 1) / block))).alias("block"))
    blocks = blocks.select("file", "block", (F.col("block") * block).alias("start"), F.least((F.col("block") + 1) * block, "usable").alias("stop"))
    total = files.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).collect()[0]["n"]
    blocks = dealt(blocks, total, "file", "block")
    seen = stored(blocks.mapInArrow(_scan(end, width, block), "file string, block long, nth long, at long, before long, stop long"), "token-ends")
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = seen.where("nth = -1").select(
        "file",
        "block",
        F.coalesce(F.sum("before").over(earlier), F.lit(0)).alias("ended"),
        F.coalesce(F.max("at").over(earlier), F.lit(-1)).alias("last"),
    )
    docs = seen.where("nth >= 0").join(carried, ["file", "block"])
    start = F.coalesce("before", "last") + 1
    whole = docs.select("file", (F.col("ended") + F.col("nth")).alias("ordinal"), start.alias("start"), (F.col("at") - start).alias("n_tokens"), F.lit(True).alias("complete"))
    tails = seen.where("nth = -1").groupBy("file").agg(F.sum("before").alias("ordinal"), (F.coalesce(F.max("at"), F.lit(-1)) + 1).alias("start"), F.max("stop").alias("stop"))
    rest = tails.where("stop > start").select("file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), F.lit(False).alias("complete"))
    return whole.unionByName(rest)


def document_tokens(docs: DataFrame, tokenizer_file: str = DEFAULT, end: int = END, width: str = WIDTH, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, start: documents written to flat files and counted from the files alone."""
    files, order = write_tokens(docs, None, tokenizer_file, end, width)
    return count_tokens(files, end, width, block).join(order, ["file", "ordinal"]).select("doc_id", "n_tokens", "start")
