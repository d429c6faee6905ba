"""Best-fit packing of documents into sequences, with large-item matching.

Pieces (documents cut at the capacity) have whole lengths from 1 to the capacity, so everything the packing needs is
the number of pieces of each length: a table of at most `capacity` rows, whatever the size of the corpus. The plan is
made on that table. Pieces above a third of the capacity go at most two to a sequence: from the longest down, each
takes the longest partner that still fits. Smaller pieces follow, longest first, each into the fullest sequence with
room. Equal sequences are planned as one group, so the plan is a list of slots: "the pieces of length l with numbers
from r to r + n lie at offset o of sequences s to s + n". The number of slots depends on the capacity, not the data.

Spark numbers the pieces of each length (hash parts, a count for each part, and a window inside a part, so that a
length which a third of all pieces share is spread over many tasks) and looks up each number's slot.

Edge cases: null and empty texts are documents of one token (the end id); rows with equal ids are packed like others;
a document longer than the capacity is cut, its last piece may be shorter; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import stored
from millrace.llm.tokens import DEFAULT, tokenizer

CAPACITY = 4096
END = 1
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(name: str, capacity: int, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(name)
        last = np.array([end], "<u4")
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), tok.encode(batch.column(1))):
                ids = np.concatenate([ids, last]).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    cut = ids[at : at + capacity]
                    rows.append((doc, k, at, len(cut), zlib.crc32(cut.tobytes())))
            doc, k, at, length, crc = zip(*rows) if rows else ((),) * 5
            yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(at, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer_file: str = DEFAULT, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end id, in pieces of at most `capacity`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_cut(tokenizer_file, capacity, end), _PIECE)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Slots of a packing of counts[l] pieces of each length l: columns length, first number, how many, first sequence, offset."""
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    slots: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: groups of (first sequence, how many)
    order: list[int] = []  # gaps in use, ascending
    sequences = 0

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        slots.append((length, used[length], n, sequence, offset))
        used[length] += n
        left[length] -= n

    def leave(gap: int, sequence: int, n: int) -> None:
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(order, gap)
        gaps[gap].append((sequence, n))

    large = sorted(n for n in left if 3 * n > capacity)
    live = list(large)
    for length in reversed(large):
        while left[length]:
            while live and not left[live[-1]]:
                live.pop()
            k = bisect.bisect_right(live, min(length, capacity - length)) - 1
            while k >= 0 and (not left[live[k]] or live[k] == length and left[length] < 2):
                if not left[live[k]]:
                    del live[k]
                k -= 1
            partner = live[k] if k >= 0 else None
            n = left[length] if partner is None else left[length] // 2 if partner == length else min(left[length], left[partner])
            put(length, n, sequences, 0)
            if partner is not None:
                put(partner, n, sequences, length)
            leave(capacity - length - (partner or 0), sequences, n)
            sequences += n
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while count := left[length]:
            k = bisect.bisect_left(order, length)
            if k == len(order):
                per = capacity // length
                n, each = (count // per, per) if count >= per else (1, count)
                leave(capacity, sequences, n)
                sequences += n
                k = len(order) - 1
            gap = order[k]
            sequence, n = gaps[gap].pop()
            each = gap // length
            if count < each:
                take, each = 1, count
            else:
                take = min(n, count // each)
            for j in range(each):
                put(length, take, sequence, capacity - gap + j * length)
            if n > take:
                gaps[gap].append((sequence + take, n - take))
            if not gaps[gap]:
                del gaps[gap]
                del order[k]
            leave(gap - each * length, sequence, take)
    return np.array(slots, np.int64).reshape(-1, 5)


def _placed(slots: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Looks up the slot of a piece by its length and number."""
    shift = np.int64(48)  # numbers stay below 2 ** 48
    keys = (slots[:, 0] << shift) + slots[:, 1]
    order = np.argsort(keys)
    keys, slots = keys[order], slots[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            length, number = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            s = slots[np.searchsorted(keys, (length << shift) + number, "right") - 1]
            yield pa.record_batch([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(s[:, 3] + number - s[:, 1]), pa.array(s[:, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_file: str = DEFAULT, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer_file, capacity, end), "pack-pieces")
    parts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    # Of each length and part one number: `capacity` times `parts` rows at most.
    counts = stored(cut.groupBy("length", "part").count(), "pack-counts")
    slots = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}, capacity)
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = cut.withColumn("inside", F.row_number().over(inside) - 1).join(bases, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("inside")).alias("number"))
    return numbered.mapInArrow(_placed(slots), f"{_PIECE}, sequence_id long, offset long")
