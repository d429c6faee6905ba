"""Exact duplicates by content sort.

Sampled splitters (Spark's range partitioning) cut the order of all texts into ranges; inside a range the external
sort places equal texts next to each other, and one pass compares each text in full with its neighbour. The order
is that of a text's first bytes, its SHA-256 digest, the text and the identifier: the digest keeps the sampled keys
short, and the identifier lets a splitter fall inside a group of copies, so that a group with a third of all rows
is cut over many tasks. Only the first and last group of a range can go on in the next one. They are at most two
per range and are put together by digest: across a border equality rests on SHA-256, everywhere else on the full
texts. That small table is all that is broadcast.

Edge cases: null counts as the empty text and equals it; rows with equal ids and texts are one group, of which one
row (any, they are alike) stays; a group without any id keeps one of its rows and has no keep_id; a group of one row
keeps itself; an empty table gives an empty result; columns beside id, text and row key are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import ROW, stored, text_of

NORMALIZERS: dict[str, Callable[[Column], Column]] = {
    "none": lambda c: c,
    "folded": lambda c: F.lower(F.btrim(F.regexp_replace(c, r"\s+", " "))),
}

_RUNS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("sha", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("keep_id", T.LongType()), T.StructField("first", T.BooleanType()), T.StructField("edge", T.BooleanType())]
)
_NAMES = _RUNS.names


def _runs(keep: str, carry: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reads a sorted range and returns its rows with the size and the kept id of the run of equal texts they are in. Only ids are held for a run, never its texts. The columns in carry come along."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(ids: list[np.ndarray], null: list[np.ndarray], more: list[list[pa.Array]], sha: bytes, edge: bool) -> pa.RecordBatch:
            every, missing = np.concatenate(ids), np.concatenate(null)
            real = every[~missing]
            kept = None if not len(real) else int(real.max() if keep == "largest" else real.min())
            n = len(every)
            first = np.zeros(n, dtype=bool)
            first[int(np.flatnonzero(missing)[0]) if kept is None else int(np.flatnonzero((every == kept) & ~missing)[0])] = True
            return pa.record_batch(
                [pa.array(every, mask=missing), pa.array([sha], pa.binary()).take(pa.array(np.zeros(n, np.int32))), pa.array(np.full(n, n)), pa.array([kept], pa.int64()).take(pa.array(np.zeros(n, np.int32))), pa.array(first), pa.array(np.full(n, edge)), *(pa.concat_arrays(c) for c in zip(*more))],
                names=[*_NAMES, *carry],
            )

        text, sha, ids, null, more, head = None, b"", [], [], [], True
        ready: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            texts, raw = batch.column("content"), batch.column("doc_id")
            doc_ids, missing = raw.fill_null(0).to_numpy(zero_copy_only=False), raw.is_null().to_numpy(zero_copy_only=False)
            others = [batch.column(c) for c in carry]
            differs = np.ones(n, dtype=bool)
            differs[0] = text is None or texts[0].as_py() != text
            if n > 1:
                differs[1:] = pc.not_equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(differs)
            shas = batch.column("sha")
            # Runs that begin and end inside this batch and hold one row need no loop.
            bounds = np.append(starts, n)
            if len(starts) == 0 or starts[0] > 0:
                stop = int(bounds[0]) if len(starts) else n
                ids.append(doc_ids[:stop])
                null.append(missing[:stop])
                more.append([c.slice(0, stop) for c in others])
            single: list[int] = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if ids:
                    ready.append(closed(ids, null, more, sha, head))
                    held += ready[-1].num_rows
                    head = False
                    ids, null, more = [], [], []
                if b < n and b - a == 1 and not head:
                    single.append(a)
                    continue
                ids, null, more, sha = [doc_ids[a:b]], [missing[a:b]], [[c.slice(a, b - a) for c in others]], shas[a].as_py()
            if single:
                at = pa.array(single)
                k = len(single)
                ready.append(pa.record_batch([raw.take(at), shas.take(at), pa.array(np.ones(k, np.int64)), raw.take(at), pa.array(np.ones(k, bool)), pa.array(np.zeros(k, bool)), *(c.take(at) for c in others)], names=[*_NAMES, *carry]))
                held += k
            text = texts[n - 1].as_py()
            if held >= 10_000:
                yield from ready
                ready, held = [], 0
        if ids:
            ready.append(closed(ids, null, more, sha, True))
        yield from ready

    return scan


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalize: str = "none", keep: str = "smallest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs, of which a group has one kept. keep: "smallest" or "largest" id of a group.

    Where docs has a ROW column, the result has it too.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep}")
    content = F.encode(NORMALIZERS[normalize](text_of(text_col)), "UTF-8")
    carry = [ROW] if ROW in docs.columns else []
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), content.alias("content"), *carry).withColumn("sha", F.unhex(F.sha2("content", 256))).withColumn("lead", F.substring("content", 1, 16))
    ranges = keyed.repartitionByRange("lead", "sha", "doc_id").sortWithinPartitions("lead", "sha", "content", "doc_id", *carry).drop("lead")
    schema = T.StructType([*_RUNS, *(T.StructField(c, T.LongType()) for c in carry)])
    runs = stored(ranges.mapInArrow(_runs(keep, carry), schema), "exact-runs")
    best = F.max if keep == "largest" else F.min
    # At most two groups per range reach a border, so this table has at most twice as many rows as there are ranges.
    edges = runs.where("edge").groupBy("sha").agg(F.count(F.lit(1)).alias("edge_n"), best("keep_id").alias("edge_id"))
    edges = edges.select(F.col("sha").alias("edge_sha"), "edge_n", "edge_id")
    # Rows without an edge never look for a partner: their key is null.
    joined = runs.join(F.broadcast(edges), F.when(F.col("edge"), F.col("sha")) == F.col("edge_sha"), "left")
    keep_id = F.coalesce("edge_id", "keep_id")
    return joined.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("edge_n", "n").alias("group_size"),
        (F.col("first") & F.col("keep_id").eqNullSafe(keep_id)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *carry,
    )


ORACLE = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
