"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Each source gets a share of the budget by weight. A source whose share exceeds max_epochs times its size is
clamped there, and the excess is shared by weight among the others until no share is above its cap. With r the
cap over the weight, sources clamp in the order of r, so running sums over the sources (a table of one row per
source, dealt by ranges, as sources may be as many as sites) give the water level: the greatest (budget - caps so far)
/ (weights left) over that order.

A source at level f = target / size takes every document floor(f) times, and once more those documents that come
first in a seeded order, up to the words still missing; the last one is taken when that brings the sum nearer.
The order is that of md5(seed:doc_id), so the choice for one source is a single cut in that order: documents
are not sorted, and a source with a third of all rows is only ever summed, in 4,096 parts of the hash range. Joins
with the table of sources are left to Spark's check of its size; where it is too large to broadcast, the documents of
a source meet it under SALTS keys.

Edge cases: a null or empty text has size 0 and takes 0 words; null is a source of its own, after all others;
rows with the same id share one place in the order and are taken together; an empty table gives an empty result;
sources without words get target 0; the operator reads only its three columns, and `mixed` returns all columns of its
input, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import WORD, free_name, stored, text_of, with_running_sums

SEED = 17
#: Keys over which the documents of one source are spread when they are joined with the sources.
SALTS = 16
CYCLE = (3.0, 1.0, 2.0)


def place(id_column: str, seed: int) -> Column:
    """Where a document stands in the seeded order of its source."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("null"))))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size: number of words."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
    )


def source_targets(sized: DataFrame, cycle: Sequence[float] = CYCLE, budget: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """source, source_size, target: one row per source."""
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = with_running_sums(per_source, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)}, "mix-ranks")
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    weighted = ranked.withColumn("weight", F.get(weights, (F.col("rank") % len(cycle)).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    weighted = weighted.withColumn("level_at", F.col("cap") / F.col("weight"))
    order = [F.col("level_at").asc(), F.col("source").asc_nulls_first()]
    filled = stored(with_running_sums(weighted, order, {"caps": F.col("cap"), "weights": F.col("weight")}, "mix-order"), "mix-levels")
    total = filled.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("all_weights"))
    level = (F.col("words") * F.lit(float(budget)) - F.col("caps")) / (F.col("all_weights") - F.col("weights"))
    level = filled.join(F.broadcast(total), F.lit(True)).agg(F.max(level).alias("level"))  # totals and level are one row each
    return filled.join(F.broadcast(level), F.lit(True)).select("source", "source_size", F.least(F.col("cap"), F.col("weight") * F.col("level")).alias("target"))


def mixing_plan(sized: DataFrame, targets: DataFrame, seed: int = SEED, parts_digits: int = 3) -> DataFrame:
    """source, source_size, target, whole, cut: how often every document is taken, and up to where in the order once more."""
    targets = (
        targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int"))
        .withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    placed = sized.where(F.col("size") > 0).select("source", "size", place("doc_id", seed).alias("place")).withColumn("part", F.substring("place", 1, parts_digits))
    parts = placed.groupBy("source", "part").agg(F.sum("size").alias("words"))
    running = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum("words").over(running), F.lit(0)))
    t = targets.select(F.col("source").alias("t_source"), "extra")
    # The part of the hash range in which a source's extra words end, and no other, is read row by row.
    crossed = parts.join(t, F.col("source").eqNullSafe(F.col("t_source"))).where((F.col("start") <= F.col("extra")) & (F.col("extra") > 0))
    last = crossed.groupBy("source").agg(F.max_by(F.struct("part", "start", "extra"), F.col("part")).alias("last"))
    last = last.select(F.col("source").alias("l_source"), F.col("last.part").alias("l_part"), F.col("last.start").alias("l_start"), F.col("last.extra").alias("l_extra"))
    rows = placed.join(last, F.col("source").eqNullSafe(F.col("l_source")) & (F.col("part") == F.col("l_part")))
    ordered = W.partitionBy("source").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.col("l_start") + F.coalesce(F.sum("size").over(ordered), F.lit(0)))
    # Above the chosen documents of that part stand all parts before it: a cut of its bare prefix takes just these.
    cuts = rows.groupBy("source", "l_part").agg(F.max(F.when(F.col("start") + F.col("size") / 2 <= F.col("l_extra"), F.col("place"))).alias("cut"))
    cuts = cuts.select(F.col("source").alias("c_source"), F.coalesce("cut", "l_part").alias("cut"))
    return targets.join(cuts, F.col("source").eqNullSafe(F.col("c_source")), "left").select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit("")).alias("cut"))


def with_copies(rows: DataFrame, plan: DataFrame, into: str, id_col: str = "doc_id", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """rows with a struct `into` of source_size, target and copies. Spark chooses the join by the size of the plan."""
    p = plan.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")).select(F.struct("source", "source_size", "target", "whole", "cut", "salt").alias(into))
    salt = F.pmod(F.xxhash64(rows[id_col].cast("string")), F.lit(SALTS)).cast("int")
    joined = rows.join(p, rows[source_col].cast("string").eqNullSafe(p[into]["source"]) & (salt == p[into]["salt"]))
    copies = p[into]["whole"] + (place(id_col, seed) <= p[into]["cut"]).cast("int")
    return joined.withColumn(into, F.struct(p[into]["source_size"].alias("source_size"), p[into]["target"].alias("target"), copies.alias("copies")))


def _plan(docs: DataFrame, cycle: Sequence[float], budget: float, max_epochs: float, seed: int) -> tuple[DataFrame, DataFrame]:
    sized = stored(sizes(docs), "mix-sizes")
    targets = stored(source_targets(sized, cycle, budget, max_epochs), "mix-targets")
    return sized, stored(mixing_plan(sized, targets, seed), "mix-plan")


def mix(docs: DataFrame, cycle: Sequence[float] = CYCLE, budget: float = 1.5, max_epochs: float = 2.0, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row per row of docs."""
    sized, plan = _plan(docs, cycle, budget, max_epochs, seed)
    out = with_copies(sized, plan, "mix", seed=seed)
    return out.select("doc_id", "source", "size", "mix.source_size", "mix.target", (F.col("size") * F.col("mix.copies")).alias("taken"))


def mixed(docs: DataFrame, cycle: Sequence[float] = CYCLE, budget: float = 1.5, max_epochs: float = 2.0, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs."""
    _, plan = _plan(docs, cycle, budget, max_epochs, seed)
    into = free_name(docs, "mix")
    out = with_copies(docs, plan, into, seed=seed).where(F.col(into)["copies"] > 0)
    return out.withColumn(into, F.explode(F.array_repeat(F.lit(0), F.col(into)["copies"]))).select(*[docs[c] for c in docs.columns])


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5('{SEED}:' || CAST(doc_id AS VARCHAR)) AS place
  FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, ([3.0, 1.0, 2.0])[1 + CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INT)]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap
  FROM per_source),
levels AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighted WINDOW before AS (ORDER BY cap / weight, source ASC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
ordered AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS extra,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN extra > 0 AND start + size / 2.0 <= extra THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ordered
"""
