"""Quality rules: counts of plain faults, and a hashed n-gram log-likelihood ratio, with DataFrame functions only.

Words and pairs of words are hashed into buckets. Over all distinct texts the bucket counts give the multinomial of the
raw corpus (a text that occurs often counts once, or its copies would speak against it; it is trusted if a copy is);
over trusted documents (labels of quality 1, a bounded sample of them) the one of the target. A bucket's
ratio compares its target count with the count that the raw multinomial leads to expect, both with PRIOR more, so
that rare n-grams, of which the sample says nothing, do not count against a clean document. A document's score is the
mean log ratio of its n-grams, so long documents weigh no more than short ones. Ratios are kept as whole millionths:
sums are the same in any order, and the verdict of a document at the threshold does not depend on how rows are dealt.

The counts are summed on the map side before the shuffle (a row per bucket and task), the ratios are a table with
as many rows as there are buckets, and the scores are summed by document where the document is read.

Edge cases: null and empty texts have no words, fail the base rules and are not kept; without trusted documents all
ratios are 0 and the base rules decide; rows with equal or null ids are scored by themselves; an empty table gives an
empty result; only doc_id, text and the row key are read, so other columns may have any name. Repeated windows of words
are told by a 64-bit hash of their words, inside one text only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ROW, WHITE, rows_of, stored, text_of, with_row_key, word_array

BUCKETS = 1 << 18
#: Documents of the trusted sample at most; the sample is the fitted part, everything else covers all rows.
TRUSTED = 20_000
#: Added to the found and the expected count of a bucket.
PRIOR = 3.0
THRESHOLD = -0.25
SCALE = 1_000_000


def repeated_words(words: Column) -> Column:
    """Number of words that stand in a 3-word window found twice or more in the text."""
    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(hashes: Column) -> Column:
        # Sorted by hash and then by place, equal windows are neighbours.
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(pairs: Column) -> Column:
            hit = F.filter(pairs, lambda p, k: (F.get(pairs, k - 1)["h"].eqNullSafe(p["h"])) | (F.get(pairs, k + 1)["h"].eqNullSafe(p["h"])))
            return F.sort_array(F.transform(hit, lambda p: p["i"]))

        def union(places: Column) -> Column:
            # A window adds three words, less those that the window before it has added.
            return F.aggregate(
                places,
                F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
                lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
                lambda a: a["n"],
            )

        # Each step is bound to a lambda variable once, so that no step is worked out again for each element.
        step = F.transform(F.array(ordered), lambda pairs: twice(pairs))
        return F.get(F.transform(step, lambda places: union(places)), 0)

    held = F.transform(F.array(windows), lambda hashes: F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(hashes)))
    return F.get(held, 0).cast("long")


def base_counts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep columns, words, and the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text_of(text_col)
    # Spark works an array of words out once: several columns below read it, so it stays a column of its own.
    worded = docs.select(*keep, text.alias("q_text"), word_array(text).alias("q_words"))
    lines = F.filter(F.split(F.col("q_text"), "\n", -1), lambda line: F.btrim(line, F.lit(WHITE)) != "")
    counted = worded.select(
        *keep,
        "q_words",
        F.size("q_words").cast("long").alias("n_words"),
        F.length(F.array_join("q_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("q_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.get(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), 0).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("q_words")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _grams(rows: DataFrame, keep: list[str], words: str, buckets: int) -> DataFrame:
    """keep columns and bucket: a row for each word and each pair of neighbouring words."""
    single = rows.select(*keep, words, F.posexplode(words).alias("at", "w"))
    first = F.pmod(F.xxhash64("w"), F.lit(buckets)).cast("int")
    pair = F.when(F.col("at") + 1 < F.size(words), F.pmod(F.xxhash64("w", F.get(words, F.col("at") + 1)), F.lit(buckets)).cast("int"))
    return single.select(*keep, F.explode(F.array(first, pair)).alias("bucket")).where(F.col("bucket").isNotNull())


def trusted_ids(labelled: DataFrame, limit: int = TRUSTED) -> DataFrame:
    """doc_id of at most `limit` documents labelled with quality 1, the first by hash."""
    good = labelled.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("t_id")).where("t_id IS NOT NULL")
    return good.distinct().orderBy(F.xxhash64("t_id"), "t_id").limit(limit)


def log_ratios(docs: DataFrame, labelled: DataFrame, buckets: int = BUCKETS, limit: int = TRUSTED, prior: float = PRIOR) -> DataFrame:
    """bucket, ratio: the log ratio of target and raw probability in whole millionths. One row per bucket in use, `buckets` at most."""
    marked = docs.select(F.col("doc_id").cast("long").alias("d_id"), text_of("text").alias("q_text")).join(F.broadcast(trusted_ids(labelled, limit)), F.col("d_id") == F.col("t_id"), "left")
    # Copies are put together on the map side first, so a group with a third of all rows is no hot key.
    texts = marked.groupBy(F.unhex(F.sha2("q_text", 256)).alias("sha")).agg(F.max(F.col("t_id").isNotNull().cast("int")).alias("good"), F.first("q_text").alias("q_text"))
    words = texts.select("good", word_array(F.col("q_text")).alias("q_words"))
    counts = _grams(words, ["good"], "q_words", buckets).groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("target"))
    counts = stored(counts, "quality-counts")
    totals = counts.agg(F.sum("raw").alias("raw_all"), F.sum("target").alias("target_all"))
    expected = F.col("raw") / F.col("raw_all") * F.col("target_all")
    ratio = F.when(F.col("target_all") > 0, F.round(F.log((F.col("target") + prior) / (expected + prior)) * SCALE)).otherwise(F.lit(0)).cast("long")
    # One row of totals beside at most `buckets` rows of counts.
    return counts.join(F.broadcast(totals), F.lit(True)).select(F.col("bucket").alias("r_bucket"), ratio.alias("ratio"))


def quality(docs: DataFrame, labelled: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, limit: int = TRUSTED) -> DataFrame:
    """doc_id, the base counts, base_failed, score (mean log ratio of the n-grams) and kept: one row per row of docs."""
    ratios = stored(log_ratios(docs, labelled, buckets, limit), "quality-ratios")
    return _scored(docs, ["doc_id"], ratios, threshold, buckets)


def _scored(docs: DataFrame, carry: list[str], ratios: DataFrame, threshold: float, buckets: int) -> DataFrame:
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = base_counts(docs, carry).withColumn("q_row", F.monotonically_increasing_id())
    each = rows.select("q_row", *carry, *counts, "q_words", F.posexplode_outer("q_words").alias("at", "w"))
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(buckets)).cast("int")
    each = each.select(
        "q_row",
        *carry,
        *counts,
        F.when(F.col("w").isNotNull(), bucket("w")).alias("b1"),
        F.when(F.col("at") + 1 < F.col("n_words"), bucket("w", F.get("q_words", F.col("at") + 1))).alias("b2"),
    )
    # At most `buckets` rows, a number fixed by the parameter.
    one, two = (F.broadcast(ratios.select(F.col("r_bucket").alias(f"k{i}"), F.col("ratio").alias(f"r{i}"))) for i in (1, 2))
    each = each.join(one, F.col("b1") == F.col("k1"), "left").join(two, F.col("b2") == F.col("k2"), "left")
    # All n-grams of a document are summed in the task that reads it; one row per document is shuffled.
    summed = each.groupBy("q_row").agg(*[F.first(c).alias(c) for c in (*carry, *counts)], (F.coalesce(F.sum("r1"), F.lit(0)) + F.coalesce(F.sum("r2"), F.lit(0))).alias("total"))
    grams = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    # Compared in whole numbers, so that no rounding decides.
    good = F.col("total") >= F.lit(round(threshold * SCALE)) * grams
    return summed.select(*carry, *counts, (F.col("total") / grams / SCALE).alias("score"), (~F.col("base_failed") & good).alias("kept"))


def kept_documents(docs: DataFrame, labelled: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that pass, with the columns of docs. The verdict is found and takes effect per row, whatever ids the rows have."""
    rows = with_row_key(docs, "quality-rows")
    ratios = stored(log_ratios(rows, labelled), "quality-ratios")
    kept = stored(_scored(rows, [ROW], ratios, threshold, BUCKETS).where("kept").select(ROW), "quality-kept")
    return rows_of(rows, kept).select(*docs.columns)
