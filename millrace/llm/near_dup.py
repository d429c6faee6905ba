"""Near duplicates by DartMinHash signatures and banded joining (T. Christiani, "DartMinHash", 2020).

Each element of a weighted set (a 5-word shingle) owns a region of the plane of weight and rank. Darts fall on it at
unit density, at places that hash functions of the element fix, so the same region gets the same darts in every
document. A document sees the darts within its elements' weights whose rank is below a bound of (darts wanted) /
(total weight). Each dart has a hashed coordinate, and per coordinate the earliest dart is the signature. Two
documents agree at a coordinate with the probability of their weighted Jaccard similarity; a sparse document of n
elements costs n steps plus one for each dart, not n for each coordinate. When a coordinate has no dart yet, the
document's bound is doubled and its darts are thrown again, so the bound never shows in the result.

A shingle weighs as often as it occurs in its text. Two texts are linked if their weighted Jaccard similarity, or the
plain one of their sets of shingles, is at least the threshold; the two differ only for texts that repeat a shingle.
Such a text takes part under two views, the counts and the set, each with its own signature, and the two are linked.

Links: texts with the same words are one node before anything else (counts are summed on the map side, so a group
of copies with a third of all rows is no hot key). Signatures are cut into bands, and views that share a band's
value meet in a bucket. No bucket is expanded into its pairs: each round compares the members of a bucket with one
of them, its pivot, and joins those of exact similarity >= threshold; buckets whose members are all in one class are
done, and classes found so far are carried along, so each round links classes and not texts. After the rounds only
members of a bucket that are still in different classes are left. These are compared one with another in cells: members
of similar size (others cannot be similar), in groups of about CELL by hash, a cell for each two groups. So a bucket of
many texts that look alike without being similar is spread over many tasks, whatever its size, and no link that shares
a bucket is lost. Two tests come before a comparison. Each view has a parity sketch, in which an element flips one bit:
the bits in which two sketches differ are never more than the elements in which the views differ, so a pair with too
many is surely below the threshold. And four bits of each signature coordinate travel along: a pair whose coordinates
differ at more places than DEVIATIONS standard deviations above what the threshold leads to expect is not one (3 in a
million links at the very threshold); that one also works for long texts, whose parity sketches are full. Classes are
connected components, found by joins; labels never leave the executors.

Hot keys: pivots, counts and classes are written before they are joined, so each join stands on exchanges of its own and
adaptive execution splits a partition in which the members of a large bucket, class or group of copies meet.

Edge cases: a text of 1 to 4 words is one shingle of all its words; texts without a word (null, empty, white space)
are equal to each other and form one class; nodes are named by a row key, never by an id, so texts without an id or with
the id of another text are compared like all others; the class of texts without any id has no class_id; of the rows of
a class exactly one is kept, also where ids are null or repeated; an empty table gives an empty result; other columns
than doc_id, text and the row key are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ROW, removed, stored, with_row_key
from millrace.llm.wordbytes import mixed, steps, text_bytes, word_hashes, words

WORDS = 5
THRESHOLD = 0.8
BANDS = 40
ROWS = 6
ROUNDS = 3
#: Bits of each coordinate in a sketch.
BITS = 4
DEVIATIONS = 4.5
#: Bits of a parity sketch.
PARITY = 1024
#: Members of a group in the last comparison of a bucket.
CELL = 256


def shingles(hashes: np.ndarray, counts: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words of each text (of all words where there are fewer), and how many each text has."""
    per = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    begins = np.cumsum(counts) - counts
    at = np.repeat(begins - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))
    stop = np.repeat(begins + counts, per)
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        inside = at + k < stop
        word = np.where(inside, hashes[np.minimum(at + k, max(len(hashes) - 1, 0))], np.uint64(k + 1)) if len(at) else out
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + word)
    return out, per


def strips(elements: np.ndarray, which: np.ndarray | None = None, seed: int = 1) -> np.ndarray:
    """Names of strips of unit weight in the elements' regions: the first ones, or those numbered by which."""
    named = elements * np.uint64(3)
    return mixed((named if which is None else named + which.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) + np.uint64(seed))


def counted(elements: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct elements of each text, how often each occurs, and how many each text has."""
    owner = np.repeat(np.arange(len(per)), per)
    order = np.lexsort((elements, owner))
    e, o = elements[order], owner[order]
    first = np.flatnonzero(np.append(True, (e[1:] != e[:-1]) | (o[1:] != o[:-1]))) if len(e) else np.zeros(0, np.int64)
    return e[first], np.diff(np.append(first, len(e))), np.bincount(o[first], minlength=len(per))


def dart_signatures(elements: np.ndarray, weights: np.ndarray | None, per: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """A row of `size` values for each text, from its distinct elements and their weights (None: 1 each). Texts need an element each.

    A value packs the rank (upper half) and the hash (lower half) of the earliest dart of a coordinate.
    """
    n_texts = len(per)
    owner = np.repeat(np.arange(n_texts), per)
    if weights is None:
        strip, room, total = strips(elements, None, seed), None, per.astype(float)
    else:
        # The region of an element is cut into strips of unit weight; the last one counts only up to the weight.
        cuts = np.ceil(weights).astype(np.int64)
        which = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        strip = strips(np.repeat(elements, cuts), which, seed)
        room = np.repeat(weights, cuts) - which
        total = np.bincount(owner, weights, n_texts)
        owner = np.repeat(owner, cuts)
    darts = size * (np.log(size) + 2)
    empty = np.iinfo(np.uint64).max
    out = np.full((n_texts, size), empty, np.uint64)
    bound = darts / np.maximum(total, 1e-9)
    todo = np.ones(n_texts, bool)
    while todo.any():
        take = todo[owner]
        s, o = strip[take], owner[take]
        w = None if room is None else room[take]
        rank = np.zeros(len(s))
        limit = bound[o]
        k = 0
        while len(s):
            k += 1
            # Along the rank axis darts arrive at exponential gaps: the k-th gap of a strip is a hash of strip and k.
            h = mixed(s + np.uint64(k * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
            rank = rank - np.log(((h >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53)
            near = rank < limit
            s, o, rank, limit, h = s[near], o[near], rank[near], limit[near], h[near]
            w = None if w is None else w[near]
            dart = mixed(h ^ np.uint64(0xE7037ED1A0B428DB))
            hit = slice(None) if w is None else ((dart >> np.uint64(40)).astype(float) + 0.5) * 2.0**-24 < w
            d = dart[hit]
            value = (rank[hit].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (mixed(d) & np.uint64(0xFFFFFFFF))
            np.minimum.at(out.reshape(-1), o[hit] * size + (d % np.uint64(size)).astype(np.int64), value)
        todo &= (out == empty).any(axis=1)
        bound = bound * 2
    return out


def sketches(signatures: np.ndarray) -> np.ndarray:
    """The lowest BITS bits of all coordinates: for each bit as many 64-bit words as the coordinates fill."""
    n, k = signatures.shape
    planes = np.zeros((n, BITS, -(-k // 64) * 64), np.uint8)
    for p in range(BITS):
        planes[:, p, :k] = (signatures >> np.uint64(p)) & np.uint64(1)
    return np.packbits(planes, axis=2).reshape(n, -1).view(np.int64)


def could_be_similar(a: str, b: str, coordinates: int, threshold: float) -> Column:
    """Whether two sketches differ at no more coordinates than similar sets do, but for DEVIATIONS standard deviations."""
    words = -(-coordinates // 64)
    same = threshold + (1 - threshold) / 2**BITS
    most = int(coordinates * (1 - same + DEVIATIONS * (same * (1 - same) / coordinates) ** 0.5))
    differ = F.lit(0)
    for w in range(words):
        either = F.lit(0).cast("long")
        for p in range(BITS):
            at = p * words + w
            either = either.bitwiseOR(F.get(F.col(a), F.lit(at)).bitwiseXOR(F.get(F.col(b), F.lit(at))))
        differ = differ + F.bit_count(either)
    return differ <= most


def within_reach(a: str, b: str, a_size: str, b_size: str, threshold: float) -> Column:
    """Whether two parity sketches differ in no more bits than similar sets differ in elements. Never false for similar sets."""
    differ = F.lit(0)
    for w in range(PARITY // 64):
        differ = differ + F.bit_count(F.get(F.col(a), F.lit(w)).bitwiseXOR(F.get(F.col(b), F.lit(w))))
    return differ <= (F.col(a_size) + F.col(b_size)) * F.lit((1 - threshold) / (1 + threshold)) + F.lit(1e-6)


_SIGNED = [ROW, "doc_id", "d1", "d2", "keys", "sketch", "set_keys", "set_sketch"]


def _signed(bands: int, rows: int, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mixed(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for a, b in steps(offsets):
                cut = offsets[a : b + 1]
                starts, ends, counts = words(raw, cut)
                hashes = word_hashes(raw, cut, starts, ends)
                values, per = shingles(hashes, counts, n)
                # The sequence of words, as two independent 64-bit sums over position and word.
                begins = np.cumsum(counts) - counts
                place = (np.arange(len(hashes)) - np.repeat(begins, counts)).astype(np.uint64)
                digest = []
                for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                    sums = np.zeros(len(hashes) + 1, np.uint64)
                    np.cumsum(mixed(hashes * np.uint64(m) + mixed(place + np.uint64(m))), out=sums[1:])
                    digest.append(sums[begins + counts] - sums[begins] + counts.astype(np.uint64))
                items, often, per = counted(values, per)
                owner = np.repeat(np.arange(b - a), per)
                repeats = np.bincount(owner, often > 1, b - a) > 0
                # A text that repeats a shingle has two signatures: by counts, and of the set.
                views: list[tuple[list, list]] = []
                for texts, weights in ((np.flatnonzero(per), often.astype(float)), (np.flatnonzero(repeats), None)):
                    keys: list[np.ndarray | None] = [None] * (b - a)
                    bits: list[np.ndarray | None] = [None] * (b - a)
                    starts_at = np.cumsum(per) - per
                    for lo in range(0, len(texts), 256):
                        part = texts[lo : lo + 256]
                        at = np.repeat(starts_at[part] - (np.cumsum(per[part]) - per[part]), per[part]) + np.arange(int(per[part].sum()))
                        # Without repeats all weights are 1, which needs no strips beyond the first.
                        heavy = weights is not None and repeats[part].any()
                        sig = dart_signatures(items[at], weights[at] if heavy else None, per[part], bands * rows)
                        band = np.broadcast_to(salt, (len(part), bands)).copy()
                        for r in range(rows):
                            band = mixed(band * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows])
                        for i, row, sketch in zip(part.tolist(), band.view(np.int64), sketches(sig)):
                            keys[i], bits[i] = row, sketch
                    views.append((keys, bits))
                longs = pa.list_(pa.int64())
                yield pa.record_batch(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), *(pa.array(d.view(np.int64)) for d in digest), *(pa.array(x, longs) for view in views for x in view)],
                    names=_SIGNED,
                )

    return run


def _views(column: pa.Array, n: int) -> Iterator[list[np.ndarray]]:
    """The views of each text as elements in order: its counts (a strip for each occurrence of a shingle), and its set where that is another one."""
    raw, offsets = text_bytes(column)
    for a, b in steps(offsets):
        cut = offsets[a : b + 1]
        starts, ends, counts = words(raw, cut)
        items, often, per = counted(*shingles(word_hashes(raw, cut, starts, ends), counts, n))
        limits = np.cumsum([0, *per]).tolist()
        for lo, hi in zip(limits[:-1], limits[1:]):
            one, times = items[lo:hi], often[lo:hi]
            plain = np.sort(strips(one).view(np.int64))
            if hi > lo and times.max() > 1:
                which = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                yield [np.sort(strips(np.repeat(one, times), which).view(np.int64)), plain]
            else:
                yield [plain]


def _sized(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """unit (twice the row key, and one more for the set of a text that repeats a shingle), number of elements and parity sketch of each view."""

    def parity(items: np.ndarray) -> np.ndarray:
        flips = np.bincount((mixed(items.view(np.uint64)) % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
        return np.packbits(flips.astype(np.uint8)).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(2 * node + k, len(v), parity(v)) for node, views in zip(batch.column(0).to_pylist(), _views(batch.column(1), n)) for k, v in enumerate(views)]
            units, sizes, flips = zip(*rows) if rows else ((),) * 3
            yield pa.record_batch([pa.array(units, pa.int64()), pa.array(sizes, pa.int64()), pa.array(flips, pa.list_(pa.int64()))], names=["unit", "size", "parity"])

    return run


def _similar(threshold: float, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The labels (smaller, greater) of pairs with Jaccard similarity >= threshold, from the texts of both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = []
            for c in ("x", "y"):
                # A pivot is in many pairs: each text is read once per batch.
                nodes, first, where = np.unique(b.column(c).to_numpy() // 2, return_index=True, return_inverse=True)
                views = list(_views(b.column(f"{c}_text").take(pa.array(first)), n))
                sides.append([views[k][u] for k, u in zip(where.tolist(), (b.column(c).to_numpy() % 2).tolist())])
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(*sides)):
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                if len(small) < threshold * len(large) - 1e-9 or not len(small):
                    continue
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int(np.count_nonzero(large[at] == small))
                keep[i] = both >= threshold * (len(x) + len(y) - both) - 1e-9
            x, y = (b.column(c).to_numpy()[keep] for c in ("x_label", "y_label"))
            yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return run


def nearer_labels(labels: DataFrame, both: DataFrame) -> DataFrame:
    """node, old, label: labels (node, label) after each node has heard its neighbours' labels (both: a, b in both directions) and taken its label's own label."""
    heard = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
    lower = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
    jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
    return lower.join(jump, "label").select("node", "old", F.least("label", "further").alias("label"))


def components(links: DataFrame) -> DataFrame:
    """node, label of all nodes with links (a, b): the smallest node of the component."""
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "near-both", small=True)
    labels = both.select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("label"))
    while True:
        once = nearer_labels(labels, both).select("node", "label")
        new = stored(nearer_labels(once, both), "near-components", small=True)
        labels = new.select("node", "label")
        if new.where(F.col("old") != F.col("label")).isEmpty():
            removed(both)
            return labels


def cells(members: DataFrame, threshold: float, per: int = CELL) -> DataFrame:
    """members (key, unit, label, size and more), each as often as there are cells that it is in, with `cell` and `side` (0, 1, or 2 where both sides are one group).

    The members of a bucket are cut by size into classes so wide that similar ones are in one class or in neighbours, by whether they have the
    bucket's most frequent label, and by hash into groups of about `per`. A cell is two groups. Any two members of different labels that can be
    similar share exactly one cell, no cell has more than two groups, and those of the most frequent label never meet each other.
    """
    width = -math.log(threshold - 0.01)  # a little wider than need be, so that no rounding parts two members
    often = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("often"))
    rows = members.join(stored(often, "near-often", small=True), "key").withColumn("c", 2 * F.floor(F.log("size") / width).cast("int") + (F.col("label") == F.col("often")).cast("int"))
    # As many classes as sizes have orders of magnitude, so the maps are small.
    sizes = rows.groupBy("key", "c").agg(F.ceil(F.count(F.lit(1)) / per).cast("int").alias("g"))
    sizes = stored(sizes.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("c", "g"))).alias("groups")), "near-cells", small=True)
    rows = rows.join(sizes, "key").withColumn("h", F.pmod(F.xxhash64("unit"), F.element_at("groups", F.col("c"))).cast("int"))
    c, h = F.col("c"), F.col("h")
    upto = lambda c2: F.filter(F.sequence(F.lit(0), F.greatest(F.coalesce(F.try_element_at("groups", c2), F.lit(0)), F.lit(1)) - 1), lambda k: k < F.coalesce(F.try_element_at("groups", c2), F.lit(0)))
    cell = lambda first, k1, second, k2, side: F.struct(F.xxhash64("key", first, k1, second, k2).alias("cell"), side.alias("side"))
    here, there = F.lit(0), F.lit(1)
    below = lambda d: F.transform(upto(c + d), lambda k: cell(c, h, c + d, k, here))
    above = lambda d: F.transform(upto(c + d), lambda k: cell(c + d, k, c, h, there))
    own = F.transform(upto(c), lambda k: cell(c, F.least(h, k), c, F.greatest(h, k), F.when(h == k, 2).when(h < k, 0).otherwise(1)))
    # An even class number: other labels. They meet their own size and both neighbours, and in all three those of the frequent label.
    rare = [own, below(2), above(-2), below(1), below(3), below(-1)]
    frequent = [above(-1), above(-3), above(1)]
    return rows.select(*members.columns, F.inline(F.when(F.pmod(c, F.lit(2)) == 0, F.concat(*rare)).otherwise(F.concat(*frequent))))


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, n: int = WORDS, bands: int = BANDS, rows: int = ROWS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), class_size, kept: one row per row of docs. Of a class one row with the smallest id is kept.

    Where docs has a ROW column, it must tell its rows apart (by numbers from 0 to 2 ** 62), and the result has it too.
    """
    carry = [ROW] if ROW in docs.columns else []
    text = with_row_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry), "near-rows").select(ROW, "text", "doc_id")
    kinds = [*["long"] * 4, *["array<long>"] * 4]
    signed = stored(text.mapInArrow(_signed(bands, rows, n), ", ".join(f"{name} {kind}" for name, kind in zip(_SIGNED, kinds))), "near-signed")
    # One node per sequence of words; its name is the key of the row that stands first in it, a row with the smallest id.
    best = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", ROW)
    nodes = signed.groupBy("d1", "d2").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("copies"))
    nodes = stored(nodes.withColumn("node", F.col("best")[ROW]), "near-nodes")
    # Nodes grow with the corpus, so they are dealt like the texts and never broadcast.
    first = signed.where("keys IS NOT NULL").join(nodes.select("node").hint("shuffle_hash"), F.col(ROW) == F.col("node"), "left_semi")
    views = F.array(F.struct((F.col(ROW) * 2).alias("unit"), "keys", "sketch"), F.struct((F.col(ROW) * 2 + 1).alias("unit"), F.col("set_keys").alias("keys"), F.col("set_sketch").alias("sketch")))
    units = stored(first.select(F.inline(views)).where("keys IS NOT NULL"), "near-units")
    keyed = units.select("unit", F.explode("keys").alias("key"))
    shared = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "near-shared", small=True)
    met = stored(keyed.join(shared, "key"), "near-met")
    live = met.select(F.floor(F.col("unit") / 2).cast("long").alias("node")).distinct()
    texts = stored(text.join(live.hint("shuffle_hash"), F.col(ROW) == F.col("node"), "left_semi").select(F.col(ROW).alias("node"), "text"), "near-texts")
    sizes = texts.mapInArrow(_sized(n), "unit long, size long, parity array<long>")
    sketched = stored(units.select("unit", "sketch").join(sizes, "unit"), "near-sketched", small=True)
    about = ("size", "parity", "sketch")
    of = lambda unit, mark: sketched.select(F.col("unit").alias(unit), *[F.col(c).alias(mark + c) for c in about])
    alike = within_reach("parity", "p_parity", "size", "p_size", threshold) & could_be_similar("sketch", "p_sketch", bands * rows, threshold)
    pair = ("x", "y", "x_label", "y_label")
    spent = [units, shared, texts, sketched]

    def classes_of(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """labels (unit, label) after the pairs (x, y and their labels) were compared exactly and classes with a link between them were put together."""
        pairs = stored(pairs.distinct(), "near-pairs", small=True)
        node = lambda c: F.floor(F.col(c) / 2).cast("long")
        met_nodes = pairs.select(node("x").alias("node")).union(pairs.select(node("y"))).distinct()
        some = texts.join(met_nodes, "node", "left_semi")
        text_of_side = lambda c: some.select(F.col("node").alias(f"{c}_node"), F.col("text").alias(f"{c}_text"))
        both = pairs.withColumns({"x_node": node("x"), "y_node": node("y")}).join(text_of_side("x"), "x_node").join(text_of_side("y"), "y_node").select(*pair, "x_text", "y_text")
        links = stored(both.mapInArrow(_similar(threshold, n), "a long, b long").distinct(), "near-links", small=True)
        joined = components(links).select(F.col("node").alias("label"), F.col("label").alias("into"))
        out = stored(labels.join(joined, "label", "left").select("unit", F.coalesce("into", "label").alias("label")), "near-labels", small=True)
        removed(pairs, links)
        return out

    # The two views of a text are in one class from the start.
    labels = stored(met.select("unit").distinct().select("unit", (F.col("unit") - F.col("unit") % 2).alias("label")), "near-labels", small=True)
    open_buckets = stored(met.join(labels, "unit").select("key", "unit", "label"), "near-open")
    removed(met)
    for turn in range(rounds):
        # First one and the same pivot for many buckets, which spares comparisons; then another one in each bucket.
        order = F.xxhash64("unit", "key", F.lit(turn)) if turn else F.col("unit")
        pivots = stored(open_buckets.groupBy("key").agg(F.min_by("unit", order).alias("y"), F.min_by("label", order).alias("y_label")), "near-pivots", small=True)
        pairs = open_buckets.join(pivots, "key").where("label <> y_label").select(F.col("unit").alias("x"), "y", F.col("label").alias("x_label"), "y_label").distinct()
        pairs = pairs.join(of("x", ""), "x").join(of("y", "p_"), "y").where(alike).select(*pair)
        labels = classes_of(pairs, labels)
        named = open_buckets.select("key", "unit").join(labels, "unit")
        mixed_keys = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo <> hi AND n > 2").select("key")
        mixed_keys = stored(mixed_keys, "near-mixed", small=True)
        still = stored(named.join(mixed_keys, "key", "left_semi"), "near-open", small=True)
        removed(open_buckets, pivots, mixed_keys)
        open_buckets = still
    members = cells(open_buckets.join(sketched, "unit"), threshold)
    left = members.where("side <> 1").withColumnsRenamed({"unit": "x", "label": "x_label"})
    right = members.where("side <> 0").select("cell", F.col("unit").alias("y"), F.col("label").alias("y_label"), F.col("side").alias("y_side"), *[F.col(c).alias(f"p_{c}") for c in about])
    met_here = (F.col("side") == 0) & (F.col("y_side") == 1) | (F.col("side") == 2) & (F.col("y_side") == 2) & (F.col("x") < F.col("y"))
    pairs = left.join(right, "cell").where(met_here & (F.col("x_label") != F.col("y_label")) & alike)
    labels = classes_of(pairs.select(*pair), labels)
    labels = labels.where("unit % 2 = 0").select(F.floor(F.col("unit") / 2).cast("long").alias("l_node"), F.floor(F.col("label") / 2).cast("long").alias("label"))
    removed(*spent, open_buckets)
    classed = stored(nodes.join(labels, F.col("node") == F.col("l_node"), "left").select("d1", "d2", F.coalesce("label", "node").alias("label"), "copies", "best"), "near-classed")
    total = stored(classed.groupBy(F.col("label").alias("t_label")).agg(F.sum("copies").alias("class_size"), F.min("best").alias("first")), "near-totals")
    named = classed.join(total, F.col("label") == F.col("t_label")).select("d1", "d2", "class_size", F.col("first.doc_id").alias("class_id"), F.col("first")[ROW].alias("first_row"))
    out = signed.select(ROW, "doc_id", "d1", "d2").join(named, ["d1", "d2"])
    return out.select("doc_id", "class_id", "class_size", (F.col(ROW) == F.col("first_row")).alias("kept"), *carry)
