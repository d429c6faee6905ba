"""Toxicity by maximum-scoring segments.

Tokens are lower-case runs of letters and digits. A token's units are the token itself and its prefixes of several
lengths, which catch inflected forms. On labelled training documents each unit gets a log-odds between toxic and
other tokens under a Dirichlet prior, and a z-score over documents; a token scores as its most significant unit, and
all tokens without a significant one score REST, a little below 0. One linear pass per document
(Ruzzo and Tompa, 1999) finds all maximal segments of positive score, that is every toxic passage. The greatest
segment of a clean document of n tokens follows an extreme-value law with parameters lambda and K (Karlin and
Altschul, 1990), which gives each segment an expected number of equals by chance; significant segments add up, and a
logistic curve, fitted on the training documents, turns the sum into a probability.

The fit uses at most SAMPLE labelled documents, chosen by hash among those outside the held-out fifth, and keeps at
most UNITS units; both bounds are parameters. Scoring covers every document, its whole text, and nothing but its text.

Edge cases: null, empty and wordless texts get the score of a document without evidence; without toxic or without
other labelled documents all scores are the share of toxic ones (0.5 where there are no labels); rows with equal ids
are scored by their own texts; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored
from millrace.llm.wordbytes import mixed, run_hashes, steps, text_bytes

SAMPLE = 20_000
UNITS = 1 << 16
#: Bytes of a prefix unit.
PREFIXES = (4, 5, 6, 7, 8)
Z_LEAST = 3.5
PRIOR = 200.0
REST = -0.02
#: Expected number of equal segments by chance below which a segment is significant.
E_MOST = 0.05

Model = dict[str, np.ndarray | float]


def held_out(id_column: str = "doc_id") -> Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ranges of texts with their bytes in lower case, and starts, ends and counts of tokens."""
    raw, offsets = text_bytes(pc.utf8_lower(column.fill_null("")))
    for a, b in steps(offsets):
        cut = offsets[a : b + 1]
        base = int(cut[0])
        part = raw[base : int(cut[-1])]
        inside = np.zeros(len(part) + 2, bool)
        inside[1:-1] = (part >= 128) | ((part >= 97) & (part <= 122)) | ((part >= 48) & (part <= 57))
        starts_at, ends_at = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
        cuts = cut[1:-1] - base
        cuts = cuts[(cuts > 0) & (cuts < len(part))]
        joined = cuts[inside[cuts] & inside[cuts + 1]]
        starts_at[joined] = True
        ends_at[joined] = True
        starts, ends = np.flatnonzero(starts_at[:-1]), np.flatnonzero(ends_at)
        yield a, b, part, starts, ends, np.diff(np.searchsorted(starts, cut - base))


def _units(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of unit the tokens that have it, and its hashes."""
    out = [(np.arange(len(starts)), mixed(run_hashes(part, starts, ends) + np.uint64(99)))]
    for k in PREFIXES:
        at = np.flatnonzero(ends - starts > k)
        out.append((at, mixed(run_hashes(part, starts[at], starts[at] + k) + np.uint64(k))))
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """unit, toxic, tokens, docs: counts of one batch; unit 0 counts all tokens and documents."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for a, b, part, starts, ends, counts in _tokens(batch.column(0)):
            owner = np.repeat(np.arange(b - a), counts)
            label = toxic[a:b]
            rows = [(np.zeros(2, np.int64), np.arange(2), np.bincount(label, counts, 2).astype(np.int64), np.bincount(label, minlength=2))]
            for at, hashes in _units(part, starts, ends):
                order = np.lexsort((owner[at], hashes))
                h, o = hashes[order], owner[at][order]
                if not len(h):
                    continue
                new_pair = np.append(True, (h[1:] != h[:-1]) | (o[1:] != o[:-1]))
                first = np.flatnonzero(new_pair)
                n = np.diff(np.append(first, len(h)))
                key, lab = h[first], label[o[first]]
                order = np.lexsort((lab, key))
                key, lab, n = key[order], lab[order], n[order]
                group = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (lab[1:] != lab[:-1])))
                rows.append((key[group].view(np.int64), lab[group], np.add.reduceat(n, group), np.diff(np.append(group, len(key)))))
            yield pa.record_batch([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*rows)], names=["unit", "toxic", "tokens", "docs"])


def _word_scores(model: Model, part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    keys, scores, z = model["keys"], model["scores"], model["z"]
    out = np.full(len(starts), model["rest"])
    best = np.zeros(len(starts))
    if len(keys):
        for at, hashes in _units(part, starts, ends):
            h = hashes.view(np.int64)
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[place] == h
            at, place = at[hit], place[hit]
            more = np.abs(z[place]) > best[at]
            at, place = at[more], place[more]
            best[at] = np.abs(z[place])
            out[at] = scores[place]
    return out


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal segments of positive score as (start, end, score), in one pass over the positive entries."""
    sums = np.append(0.0, np.cumsum(scores))
    held: list[list[float]] = []  # start, end, sum before it, sum behind it
    for i in np.flatnonzero(scores > 0).tolist():
        lo, hi, a, b = i, i + 1, sums[i], sums[i + 1]
        while True:
            k = len(held) - 1
            while k >= 0 and held[k][2] >= a:
                k -= 1
            if k < 0 or held[k][3] >= b:
                held.append([lo, hi, a, b])
                break
            lo, a = held[k][0], held[k][2]
            del held[k:]
    return [(int(s), int(e), float(b - a)) for s, e, a, b in held]


def passages(model: Model, text: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, float]], np.ndarray, np.ndarray]]:
    """For each text: number of tokens, its maximal segments, and where its tokens start and end (bytes of the lower-case text)."""
    for a, b, part, starts, ends, counts in _tokens(text):
        scores = _word_scores(model, part, starts, ends)
        positive = np.append(0, np.cumsum(scores > 0))
        last = 0
        for n in counts.tolist():
            stop = last + n
            found = maximal_segments(scores[last:stop]) if positive[stop] > positive[last] else []
            yield n, found, starts[last:stop], ends[last:stop]
            last = stop


def evidence(model: Model, n: int, segments: list[tuple[int, int, float]]) -> tuple[float, int]:
    """What a document's segments say above chance, in nats, and how many are significant."""
    if not segments:
        return 0.0, 0
    chance = np.log(max(n, 2) * model["k"])
    nats = [model["lambda"] * s - chance for _, _, s in segments]
    strong = [x for x in nats if x > -np.log(E_MOST)]
    # Sums of several strong segments count each; one weak segment alone counts as its chance of being the greatest.
    return (float(sum(strong)), len(strong)) if strong else (float(np.log1p(np.exp(max(nats)))), 0)


def _scored(model: Model, fit: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n, segments, _, _ in passages(model, batch.column(1)):
                if fit:
                    rows.append((float(n), max((s for _, _, s in segments), default=0.0), 0, *evidence(model, n, segments)[:1]))
                else:
                    x, strong = evidence(model, n, segments)
                    p = 1 / (1 + np.exp(-(model["bias"] + model["slope"] * x)))
                    rows.append((p, x, strong, len(segments)))
            p, x, strong, count = (np.array(c, float) for c in zip(*rows)) if rows else (np.zeros(0),) * 4
            yield pa.record_batch([batch.column(0), pa.array(p), pa.array(x), pa.array(strong.astype(np.int64)), pa.array(count)], names=["key", "p", "x", "strong", "count"])

    return run


_OUT = "key long, p double, x double, strong long, count double"


def fit(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE, most: int = UNITS) -> Model:
    """Learns from at most `sample` labelled documents outside the held-out fifth."""
    known = labelled.select(F.col("doc_id").cast("long").alias("l_id"), F.col("toxic").cast("int").alias("toxic")).where("l_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.where(~held_out("l_id")).groupBy("l_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("l_id"), "l_id").limit(sample)
    # The join's small side has at most `sample` rows; of texts that share an id one is learned from, so the bound holds for rows.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    train = rows.join(F.broadcast(known), F.col("doc_id") == F.col("l_id")).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    train = stored(train.select("doc_id", "text", "toxic"), "toxic-train")
    counts = train.select("text", "toxic").mapInArrow(_counted, "unit long, toxic long, tokens long, docs long")
    units = counts.groupBy("unit").agg(*[F.sum(F.when(F.col("toxic") == t, F.col(c)).otherwise(0)).alias(f"{c}{t}") for t in (0, 1) for c in ("tokens", "docs")])
    units = stored(units, "toxic-units")
    total = units.where("unit = 0").collect()
    n0, n1, d0, d1 = (float(total[0][c]) for c in ("tokens0", "tokens1", "docs0", "docs1")) if total else (0.0,) * 4
    share = d1 / (d0 + d1) if d0 + d1 else 0.5
    plain: Model = {"keys": np.zeros(0, np.int64), "scores": np.zeros(0), "z": np.zeros(0), "rest": REST, "lambda": 1.0, "k": 1.0, "bias": float(np.log((share + 1e-6) / (1 - share + 1e-6))), "slope": 0.0}
    if not d0 or not d1 or not n0 or not n1:
        return plain
    # Dirichlet prior: PRIOR tokens (or documents) dealt out as in all training documents.
    a = F.lit(PRIOR) * (F.col("tokens0") + F.col("tokens1")) / F.lit(n0 + n1)
    score = F.log((F.col("tokens1") + a) / F.lit(n1 + PRIOR)) - F.log((F.col("tokens0") + a) / F.lit(n0 + PRIOR))
    # Over documents with Jeffreys' prior of a half, so that a unit never seen in clean documents keeps a finite error.
    odds = lambda y, d: F.log((y + 0.5) / (F.lit(d + 0.5) - y))
    z = (odds(F.col("docs1"), d1) - odds(F.col("docs0"), d0)) / F.sqrt(1 / (F.col("docs1") + 0.5) + 1 / (F.col("docs0") + 0.5))
    chosen = units.where("unit <> 0").select("unit", score.alias("s"), z.alias("z"), "tokens0", "tokens1", "docs1").where((F.abs("z") >= Z_LEAST) & (F.abs("s") >= 0.7) & (F.signum("s") == F.signum("z")))
    table = chosen.orderBy(F.abs("z").desc(), "unit").limit(most).toPandas().sort_values("unit")
    model = plain | {"keys": table["unit"].to_numpy(np.int64), "scores": table["s"].to_numpy(float), "z": table["z"].to_numpy(float)}
    # Extreme-value law of the greatest segment of clean training documents.
    weight = table["tokens0"].to_numpy(float)
    scores = model["scores"]
    other = max(n0 - weight.sum(), 1.0)
    lo, hi = 1e-3, 5.0
    for _ in range(60):
        mid = (lo + hi) / 2
        total_mass = (weight * np.exp(np.minimum(mid * scores, 60))).sum() + other * np.exp(mid * model["rest"])
        lo, hi = (mid, hi) if total_mass <= (other + weight.sum()) else (lo, mid)
    model["lambda"] = max(lo, 0.05)
    seen = train.select("doc_id", "text", "toxic")
    best = seen.select(F.col("doc_id"), "text").mapInArrow(_scored(model, True), _OUT).join(F.broadcast(known), F.col("key") == F.col("l_id")).select("p", "x", "toxic").toPandas()
    clean = best[(best["toxic"] == 0) & (best["p"] > 0)]
    shifted = model["lambda"] * clean["x"].to_numpy() - np.log(np.maximum(clean["p"].to_numpy(), 2))
    model["k"] = float(np.exp(np.clip(np.mean(shifted) - 0.5772, -12, 3))) if len(shifted) else 1.0
    x = seen.select(F.col("doc_id"), "text").mapInArrow(_scored(model | {"slope": 1.0}, False), _OUT).join(F.broadcast(known), F.col("key") == F.col("l_id")).select("x", "toxic").toPandas()
    model["bias"], model["slope"] = _logistic(x["x"].to_numpy(float), x["toxic"].to_numpy(float))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Bias and slope by Newton steps with a weak pull to 0."""
    w = np.zeros(2)
    a = np.stack([np.ones_like(x), np.minimum(x, 50.0)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + 1e-2 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0))


def toxicity(docs: DataFrame, labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages (significant ones): one row per row of docs."""
    model = fit(docs, labelled, sample)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_scored(model, False), _OUT)
    return scored.select(F.col("key").alias("doc_id"), F.coalesce(held_out("key"), F.lit(False)).alias("held_out"), F.col("p").alias("score"), (F.col("p") >= 0.5).cast("int").alias("predicted"), F.col("strong").alias("n_passages"))
