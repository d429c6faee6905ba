"""The training-data operators against brute-force versions, round trips and held-out accuracy, on small odd tables."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import automaton, common, exact_dedup, files, html_main, mixing, near_dup, packing, quality, queries, secrets, token_counts, toxicity, warc, wordbytes
from millrace.llm.htmlblocks import blocks
from tests.test_queries import same_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = [a + b for a in "ka le mi no pu ra se ti vo zu".split() for b in "na ro ti lu ke".split()]


#: Names that operators use inside.
CLASHING = "whole cut mix salt source_size target copies piece kept sha lead content bucket unit key keys a b d1 d2 x y p t_id q_text q_words at file ordinal toxic score part length".split()


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def odd_rows():
    """Nulls everywhere, empty and blank texts, ties, repeated rows and a very long text."""
    long = " ".join(VOCABULARY[i * i % 50] for i in range(30_000))
    plain = " ".join(VOCABULARY[i * 7 % 50] for i in range(80))
    return [(1, plain, "a"), (2, plain, None), (2, plain, None), (3, None, "a"), (4, "", "b"), (5, " \n\t ", "b"), (6, long, "c"), (None, "no id", "a"), (7, "é" * 10, None), (8, "one two", "b")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, odd_rows()).withColumns({"size": F.lit("x"), "label": F.lit(1), "node": F.lit(0), "rank": F.lit(None).cast("int"), **{c: F.lit(1) for c in CLASHING}})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (6, 1, 1), (None, 1, 1), (8, 0, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf_dir, name):
    same_rows(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name], sf_dir)


def apply_all(table, labels):
    return {
        "mix": mixing.mix(table), "mixed": mixing.mixed(table), "exact": exact_dedup.exact_groups(table), "near": near_dup.near_groups(table), "quality": quality.quality(table, labels),
        "pack": packing.pack(table), "secrets": secrets.secrets(table), "tokens": token_counts.document_tokens(table), "toxicity": toxicity.toxicity(table, labels),
    }


def test_odd_tables_keep_every_row(odd, labels):
    n = odd.count()
    for name, out in apply_all(odd, labels).items():
        got = out.collect()
        if name not in ("mixed", "pack"):
            assert len(got) == n, name


def test_empty_tables_give_empty_results(odd, labels):
    for name, out in apply_all(odd.limit(0), labels.limit(0)).items():
        assert out.count() == 0, name


# ---- exact duplicates ----


def test_exact_groups_cross_ranges(spark):
    rows = [(i, "hot" if i % 3 else f"text {i % 40}", "s") for i in range(600)] + [(1000, None, "s"), (1001, "", "s")]
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(docs(spark, rows).repartition(7), keep="largest").collect()}
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    for t, ids in groups.items():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(ids), len(ids), i == max(ids))
            assert got[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    smallest = exact_dedup.exact_groups(docs(spark, [(3, "A  b", "s"), (2, "a B ", "s")]), normalize="folded")
    assert {r["keep_id"] for r in smallest.collect()} == {2}


# ---- near duplicates ----


def jaccard_classes(rows, t=0.8):
    """Components of texts whose shingles are similar as sets or as counts."""
    bags = {}
    for i, text, _ in rows:
        w = WORDS.findall(text or "")
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter([()])
    parent = {i: i for i in bags}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def similar(x, y):
        plain = len(x.keys() & y.keys()) >= t * len(x.keys() | y.keys()) - 1e-9
        return plain or (x & y).total() >= t * (x | y).total() - 1e-9

    ids = sorted(bags)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if similar(bags[a], bags[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_near_groups_of_texts_that_repeat_themselves(spark):
    """Similar as sets only, as counts only, and as neither."""
    rng = random.Random(12)
    line = lambda: " ".join(rng.choice(VOCABULARY) + rng.choice(VOCABULARY) for _ in range(20))
    a, b = [line() for _ in range(6)], line()
    rows = [(1, " ".join(a), "s"), (2, " ".join(a + a[:1] * 9), "s"), (3, " ".join([b] * 40 + [line() for _ in range(3)]), "s"), (4, " ".join([b] * 40 + [line() for _ in range(3)]), "s"), (5, " ".join([b] * 5 + [line() for _ in range(5)]), "s")]
    expected = jaccard_classes(rows)
    assert expected == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    assert {r["doc_id"]: r["class_id"] for r in near_dup.near_groups(docs(spark, rows)).collect()} == expected


def test_cells_bring_all_members_of_like_size_and_other_label_together_once(spark):
    rng = random.Random(2)
    rows = [(7, u, rng.choice([0] * 8 + list(range(1, 30))), int(50 * 1.1 ** rng.randrange(20))) for u in range(300)] + [(8, u, u, 40) for u in range(3)]
    out = near_dup.cells(spark.createDataFrame(rows, "key long, unit long, label long, size long"), 0.8, per=16).collect()
    by_cell, met = {}, Counter()
    for r in out:
        by_cell.setdefault(r["cell"], []).append(r)
    assert max(map(len, by_cell.values())) < 6 * 16
    for members in by_cell.values():
        for x in members:
            for y in members:
                if x["side"] == 0 and y["side"] == 1 or x["side"] == y["side"] == 2 and x["unit"] < y["unit"]:
                    met[(x["key"], *sorted((x["unit"], y["unit"])))] += 1
    assert set(met.values()) == {1}
    for k, u, a, m in rows:
        for k2, v, b, m2 in rows:
            if k == k2 and u < v and a != b and min(m, m2) >= 0.8 * max(m, m2):
                assert met[(k, u, v)] == 1
            assert not (a == b == 0 and k == k2 == 7 and met[(k, u, v)])


def test_a_bucket_of_look_alikes_is_compared_whole(spark):
    """Texts that share most of their words without being similar, a few similar ones among them, in small cells."""
    rng = random.Random(14)
    base = [rng.choice(VOCABULARY) + rng.choice(VOCABULARY) for _ in range(120)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.choice([2, 3, 3])):
            words[rng.randrange(120)] = f"odd{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), "s"))
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_groups(docs(spark, rows), rounds=1).collect()}
    assert got == jaccard_classes(rows)


def test_near_groups_are_components_of_similar_texts(spark):
    rng = random.Random(4)
    rows = []
    for base in range(6):
        words = [rng.choice(VOCABULARY) for _ in range(120)]
        for k in range(25):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(VOCABULARY) + "x"
            rows.append((base * 100 + k, " ".join(copy), "s"))
    rows += [(9000, "", "s"), (9001, None, "s"), (9002, "a b", "s"), (9003, "a  b", "s")]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_groups(docs(spark, rows)).collect()}
    assert got == jaccard_classes(rows)


def test_near_groups_link_texts_without_ids_or_with_shared_ids(spark):
    rng = random.Random(6)
    words = lambda: [rng.choice(VOCABULARY) + rng.choice(VOCABULARY) for _ in range(120)]
    a, b, c, d = words(), words(), words(), words()
    near = lambda w: " ".join([*w[:-1], "else"])
    rows = [(None, " ".join(a), "a"), (None, near(a), "a"), (5, " ".join(b), "b"), (None, near(b), "b"), (7, " ".join(c), "c"), (7, " ".join(d), "d"), (8, near(c), "c"), (9, near(d), "d"), (3, "x y", "e"), (3, "x y", "e")]
    keyed = spark.createDataFrame([(k, i, t) for k, (i, t, _) in enumerate(rows)], f"{common.ROW} long, doc_id long, text string")
    got = {r[common.ROW]: (r["class_id"], r["class_size"], r["kept"]) for r in near_dup.near_groups(keyed.repartition(3)).collect()}
    assert len(got) == len(rows)
    assert [got[k][:2] for k in range(10)] == [(None, 2), (None, 2), (5, 2), (5, 2), (7, 2), (7, 2), (7, 2), (7, 2), (3, 2), (3, 2)]
    assert [k for k in range(10) if got[k][2]] == [0, 2, 4, 5, 8]


def test_dart_signatures_agree_as_weighted_jaccard():
    rng = np.random.default_rng(1)
    items = rng.integers(1, 2**63, 300).astype(np.uint64)
    w1, w2 = rng.uniform(0.2, 3, 300), rng.uniform(0.2, 3, 300)
    one = near_dup.dart_signatures(items, w1, np.array([300]), 2000)
    two = near_dup.dart_signatures(items, w2, np.array([300]), 2000)
    assert abs((one == two).mean() - np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()) < 0.04


def test_parity_sketches_never_part_similar_sets(spark):
    rng = np.random.default_rng(2)
    pairs = []
    for _ in range(50):
        a = np.unique(rng.integers(-(2**62), 2**62, 400))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(-(2**62), 2**62, 15)]))
        pairs.append((a, b))
    for a, b in pairs:
        both = len(np.intersect1d(a, b))
        differ = len(a) + len(b) - 2 * both
        flips = lambda x: np.bincount((wordbytes.mixed(x.view(np.uint64)) % np.uint64(near_dup.PARITY)).astype(int), minlength=near_dup.PARITY) & 1
        assert (flips(a) != flips(b)).sum() <= differ


# ---- mixing ----


def test_running_sums_go_over_ranges(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(50), rng.choice([None, "a", "b"])) for k in range(500)]
    table = spark.createDataFrame(rows, "k int, v int, s string").repartition(9)
    order = lambda r: (r[2] is None, r[2] or "", r[0])
    got = common.with_running_sums(table, [F.col("s").asc_nulls_last(), F.col("k").asc()], {"n": F.lit(1), "total": F.col("v")}, "sums").collect()
    total = 0
    for n, r in enumerate(sorted(rows, key=order)):
        assert (r[0], n, total) in {(g["k"], g["n"], g["total"]) for g in got if g["n"] == n}
        total += r[1]


def test_mix_of_many_sources_without_broadcasts(spark):
    rows = [(i, " ".join(["w"] * (i % 9)), f"s{0 if i % 3 == 0 else i % 700}") for i in range(4000)]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = mixing.mix(docs(spark, rows)).toPandas().sort_values("doc_id")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    again = mixing.mix(docs(spark, rows)).toPandas().sort_values("doc_id")
    assert got["taken"].tolist() == again["taken"].tolist() and got["target"].tolist() == again["target"].tolist()
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(sorted({r[2] for r in rows}))}
    size = got.groupby("source")["size"].sum().to_dict()
    left, budget, target = dict(size), 1.5 * sum(size.values()), {}
    while True:
        level = (budget - sum(target.values())) / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * level > 2 * size[s]]
        if not over:
            break
        target |= {s: 2.0 * left.pop(s) for s in over}
    target |= {s: weight[s] * level for s in left}
    assert all(abs(t - target[s]) < 1e-6 for s, t in zip(got["source"], got["target"]))


def test_mix_comes_near_its_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 37 % 90)), f"s{i % 5}" if i % 11 else None) for i in range(2000)]
    out = mixing.mix(docs(spark, rows)).toPandas()
    again = mixing.mix(docs(spark, rows).repartition(5)).toPandas()
    assert out.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()
    per = out.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert abs(per["target"].sum() - 1.5 * per["size"].sum()) < 1e-6 * per["size"].sum()
    assert (per["target"] <= 2 * per["size"] + 1e-6).all() and ((per["taken"] - per["target"]).abs() <= 90).all()
    assert (out["taken"] <= 2 * out["size"]).all()
    assert mixing.mixed(docs(spark, rows)).select(F.sum(F.regexp_count("text", F.lit("w")))).collect()[0][0] == out["taken"].sum()


# ---- quality ----


def brute_counts(text):
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1}
    inside = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_base_counts(spark, labels):
    rng = random.Random(7)
    texts = ["", " ", "a b", "a a a a", "a b c a b c\na b c\n\n  \na b c", "é# * x\x0b|y<z>\x0c"] + ["".join(rng.choice(["ka", "b", " ", " ", "\n", "#", "|", "é", "\t"]) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    got = {r["doc_id"]: r for r in quality.quality(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), labels).collect()}
    for i, t in enumerate(texts):
        r, expected = got[i], brute_counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == expected, repr(t)
        assert r["base_failed"] == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0]) and not (r["base_failed"] and r["kept"])


def test_ratio_keeps_clean_and_drops_junk(spark):
    rng = random.Random(3)
    clean = lambda: " ".join(rng.choice(VOCABULARY) + rng.choice(VOCABULARY[:9]) for _ in range(150))
    junk = lambda: " ".join(rng.choice(VOCABULARY) + rng.choice(["%%%", "###"]) for _ in range(150))
    rows = [(i, junk() if i % 5 == 0 else clean(), "s") for i in range(400)]
    marked = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(0, 400, 2)], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality(docs(spark, rows), marked).collect()}
    assert all(kept[i] == (i % 5 != 0) for i in kept)


def test_copies_of_a_clean_text_do_not_speak_against_it(spark):
    rng = random.Random(8)
    clean = lambda: " ".join(rng.choice(VOCABULARY) + rng.choice(VOCABULARY[:9]) for _ in range(150))
    copied = " ".join(rng.choice(VOCABULARY) + rng.choice(VOCABULARY) + "x" for _ in range(150))
    rows = [(i, clean(), "s") for i in range(300)] + [(1000 + i, copied, "s") for i in range(100)]
    marked = spark.createDataFrame([(i, 1) for i in range(0, 300, 2)], "doc_id long, quality int")
    assert all(r["kept"] for r in quality.quality(docs(spark, rows), marked).collect())


# ---- packing and tokens ----


def check_packing(lengths, capacity):
    counts = {}
    for n in lengths:
        counts[n] = counts.get(n, 0) + 1
    slots = packing.plan(counts, capacity)
    used, placed = {}, {}
    for length, first, n, sequence, offset in slots.tolist():
        placed.setdefault(length, []).extend(range(first, first + n))
        for k in range(n):
            used.setdefault(sequence + k, []).append((offset, length))
    assert all(sorted(placed[n]) == list(range(c)) for n, c in counts.items())
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 64, 300])
    lengths = [min(capacity, int(rng.paretovariate(0.8))) if rng.random() < 0.7 else rng.randint(1, capacity) for _ in range(rng.randint(0, 800))]
    n = check_packing(lengths, capacity)
    assert n <= 1.25 * sum(lengths) / capacity + 2 or any(3 * x > capacity for x in lengths)


def test_large_items_pair_at_most_twice():
    assert check_packing([60, 60, 40, 40, 35, 34], 100) == 3
    assert check_packing([34, 34, 34], 100) == 2


def test_sequences_have_no_gaps(spark, sf_dir):
    by = {}
    for r in packing.pack(common.documents(spark, sf_dir)).collect():
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    total = sum(n for parts in by.values() for _, n in parts)
    assert len(by) <= 1.1 * total / packing.CAPACITY + 2


def test_packed_pieces_hold_the_ids_of_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(1, "Über: don't stop! x́ ý 12,5", "s"), (2, None, "s"), (3, " ".join(VOCABULARY) * 8, "s"), (4, "á. b\x1cc", "s")]
    got = {}
    for r in packing.pack(docs(spark, rows), capacity=50).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for i, t, _ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        parts = sorted(got[i], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in parts] == [(a, len(ids[a : a + 50])) for a in range(0, len(ids), 50)]
        assert [r["ids_crc32"] for r in parts] == [zlib.crc32(np.array(ids[a : a + 50], "<u4").tobytes()) for a in range(0, len(ids), 50)]


def test_special_tokens_in_a_text_get_the_ids_of_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["end of text <|endoftext|> more", "a<|startoftext|>b<|endoftext|><|endoftext|>.", "<|ENDOFTEXT|> <|endoftext|", "plain"]
    table = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pack(table).collect()}
    counted = {r["doc_id"]: r["n_tokens"] for r in token_counts.document_tokens(table).collect()}
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    for i, t in enumerate(texts):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert counted[i] == len(plain.encode(t, add_special_tokens=False).ids)


def colliding_words():
    """A Thue-Morse word and its complement: a polynomial hash with an odd base modulo a power of two gives both the same value."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_with_equal_hashes_keep_their_own_ids(spark, monkeypatch):
    import public_tokenizers
    from millrace.llm import tokens
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rng = random.Random(9)
    texts = [*colliding_words(), "", None, *(" ".join(rng.choice(VOCABULARY) + rng.choice(VOCABULARY) for _ in range(rng.randint(1, 60))) for _ in range(50))]
    expected = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in tokens.ChunkTokenizer(path).encode(pa.array(texts))] == expected
    monkeypatch.setattr(tokens, "word_hashes", lambda *a: wordbytes.word_hashes(*a) % np.uint64(40))
    assert [x.tolist() for x in tokens.ChunkTokenizer(path).encode(pa.array(texts))] == expected


def test_colliding_words_are_different_texts(spark):
    a, b = colliding_words()
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_groups(docs(spark, [(1, a, "s"), (2, b, "s"), (3, a, "s")])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_document_tokens_are_those_of_the_tokenizer(spark, sf_dir, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for table in (common.documents(spark, sf_dir), odd):
        expected = sorted((r["doc_id"] or 0, len(plain.encode(r["text"] or "", add_special_tokens=False).ids)) for r in table.collect())
        assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in token_counts.document_tokens(table).collect()) == expected


def test_ids_that_do_not_fit_are_an_error(spark):
    with pytest.raises(Exception, match="does not fit"):
        token_counts.document_tokens(docs(spark, [(1, "some words", "s")]), end=200, width="<u1")


def test_parts_of_files_are_dealt_over_many_tasks(spark):
    parts = common.dealt(spark.range(64).select(F.lit("f").alias("file"), F.col("id").alias("block")), 64 << 22, "file", "block")
    assert parts.select(F.spark_partition_id().alias("p")).distinct().count() >= 6
    assert common.dealt(spark.range(10), 100 << 27, "id").rdd.getNumPartitions() == 100


def test_token_counts_across_blocks(spark, tmp_path):
    rng = random.Random(1)
    ids = [9 if rng.random() < 0.05 else rng.randint(10, 99) for _ in range(5000)] + [50, 51]
    where, path = files.opened(f"file://{tmp_path}")
    with where.open_output_stream(f"{path}/a.tokens") as out:
        out.write(np.array(ids, "<u2").tobytes())
    table = spark.createDataFrame([(f"file://{tmp_path}/a.tokens", 2 * len(ids))], "file string, bytes long")
    got = [(r["ordinal"], r["start"], r["n_tokens"], r["complete"]) for r in token_counts.count_tokens(table, end=9, block=64).orderBy("ordinal").collect()]
    expected, start = [], 0
    for k, x in enumerate(ids):
        if x == 9:
            expected.append((len(expected), start, k - start, True))
            start = k + 1
    assert got == [*expected, (len(expected), start, len(ids) - start, False)]


# ---- archives and pages ----


def test_archives_come_back(spark):
    html = ["<p>a</p>", None, "", "<p>é\r\n\r\nWARC/1.1</p>", "<p>a</p>", "x" * 200_000, "<p>a</p>"]
    pages = spark.createDataFrame([(10 + i, f"http://e.org/{i}" if i else None, h) for i, h in enumerate(html)], "page_id long, url string, html string")
    index = warc.write_warc(pages.repartition(3))
    got = {r["page_id"]: r for r in warc.read_warc(index).collect()}
    first = {}
    for i, h in enumerate(html):
        payload, r = (h or "").encode(), got[10 + i]
        at = first.setdefault(payload, 10 + i)
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if at == 10 + i else ("revisit", at))
        assert r["payload"] == (payload if at == 10 + i else None) and r["url"] == (f"http://e.org/{i}" if i else None)
    assert warc.read_warc(index, F.col("page_id") == 15).count() == 1
    assert warc.read_warc(warc.write_warc(pages.limit(0))).count() == 0


def test_archives_of_odd_tables(spark):
    """Null and equal ids, repeated rows, a digest that over a thousandth of the rows share, and columns with the names used inside."""
    rows = [(k, "u", "" if k % 3 else f"<p>{k % 50}") for k in range(1800)] + [(None, None, ""), (None, "u", "only"), (None, "v", "only"), (7, "u", "twice"), (7, "u", "twice"), (9, "w", "twice")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"sha": F.lit(1), "first": F.lit("x"), "n": F.lit(None).cast("int"), "key": F.lit(0)})
    got = sorted((r["page_id"] is None, r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in warc.read_warc(warc.write_warc(pages.repartition(4)), payloads=False).collect())
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h] = min(least.get(h, i), i)
    expected = sorted((i is None, i or 0, len(h), "response" if least.get(h) in (None, i) else "revisit", 0 if least.get(h) in (None, i) else least[h]) for i, _, h in rows)
    assert got == expected
    texts = html_main.main_text(pages.limit(5).union(pages.limit(5))).collect()
    assert len(texts) == 10 and html_main.main_text(pages.limit(0)).count() == 0


def test_requests_cover_near_ranges_together():
    assert list(warc.coalesced([(0, 10), (12, 5), (100, 5)], gap=5, most=1000)) == [(0, 17, [0, 1]), (100, 105, [2])]


def test_labeller_on_pages_it_has_not_seen():
    rng, w = random.Random(99), html_main.trained()
    right = total = 0
    for _ in range(60):
        page, marks = html_main.training_page(rng)
        right += int(((html_main.chances(w, blocks(page), [len(marks)]) >= 0.5) == np.array(marks)).sum())
        total += len(marks)
    assert right / total > 0.97


def test_long_pages_are_read_in_stretches(monkeypatch):
    rng, w = random.Random(5), html_main.trained()
    found = [b for _ in range(12) for b in blocks(html_main.training_page(rng)[0])]
    whole = html_main.chances(w, found, [len(found)])
    monkeypatch.setattr(html_main, "TOGETHER", 37)
    assert len(found) > 100 and np.allclose(html_main.chances(w, found, [len(found)]), whole, atol=1e-5)


ARTICLE = (
    "<h1>The long way home</h1><p>The reporter walked for nine days along the river, and wrote down what people said.</p>"
    "<p>Nobody in the valley remembered a summer this dry, and the wells had been empty since May.</p>"
    "<p class=lead'>It was the reporter's own story, told in full.</p><blockquote>We have waited for rain before, and it came.</blockquote>"
)
ARTICLE_TEXT = [
    "The long way home", "The reporter walked for nine days along the river, and wrote down what people said.", "Nobody in the valley remembered a summer this dry, and the wells had been empty since May.",
    "It was the reporter's own story, told in full.", "We have waited for rain before, and it came.",
]


@pytest.mark.parametrize(
    "page, more",
    [
        (f"<body><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav><article><noscript><iframe></iframe><p>Please enable JavaScript to read.</p></noscript>{ARTICLE}</article><footer>&copy; 2024 All rights reserved</footer>", []),
        (f"<table><tr><td class=menu><a href=/>Home</a><br><a href=/b>About</a></td><td class=content>{ARTICLE}</td></tr></table><div id=footer>Contact us</div>", []),
        (f"<div id=header><a href=/>Site</a></div><div class='cookie-banner'><p>We use cookies to improve your experience.</p><button>Accept</button></div><div id=main><div class=post-content>{ARTICLE}</div><div class=comments><h3>3 comments</h3><div class=comment><p>I loved this story, thank you so much.</p></div></div></div><div class=sidebar><h3>Related</h3><ul><li><a href=/x>Another story that may please you</a></ul></div>", []),
        (f"<body><header><h2>Daily News</h2></header><main>{ARTICLE}<form><label>Email</label><input><button>Subscribe</button></form></main><aside class=widget><p>Buy our new book about rivers and wells today.</p></aside></body>", []),
        (f"<body><div class=topbar>Mon 3 May</div><section class=story>{ARTICLE}<ul><li>First point about the river.</li><li>Second point about the well.</li></ul><div class=ad>Sponsored: cheap shoes</div></section><section class=newsletter><p>Subscribe to our newsletter for more.</p></section>", ["First point about the river.", "Second point about the well."]),
    ],
)
def test_main_text_of_hand_labelled_pages(page, more):
    found = blocks(page)
    keep = html_main.chances(html_main.trained(), found, [len(found)]) >= 0.5
    assert [t for (t, _, _), k in zip(found, keep) if k] == ARTICLE_TEXT + more


def test_blocks_of_broken_pages():
    assert [t for t, _, _ in blocks("<p>a &amp; b<br>c<p><b>d  e<script>x</script><!-- y --><li>f<p")] == ["a & b c", "d e", "f"]
    assert blocks("") == [] and [t for t, _, _ in blocks("plain < text")] == ["plain < text"]


def test_main_text_of_odd_pages(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title here</h1><p>Some longer text stands here, with several words.</p></article><footer>&copy; x</footer>")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_main.main_text(pages).collect()}
    assert got[1] == got[2] == ("", 0) and got[3][0] == "Title here\nSome longer text stands here, with several words."


# ---- secrets ----

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_BASE = [(_ASSIGN, lambda m: len(m[2]) >= 12), (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16)]


def test_secrets_are_those_of_the_expressions(spark):
    rng = random.Random(5)
    parts = ["password", "TOKEN", "secret", "api_key", "Passwd", "=", ":", '"', "'", " ", "AKIA", "abc", "0123", "deadbeefdeadbeef", "ABCDEFGHIJKLMN", "é", "\n", "xyz", ".", "=="]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    got = {r["doc_id"]: r for r in secrets.secrets(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        found = sorted((m.start(), k, m.end()) for k, (r, good) in enumerate(_BASE) for m in r.finditer(t) if good(m))
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in found)
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), repr(t)
        assert [got[i][f"n_{n}"] for n in ("assign", "access", "hex")] == [sum(k == j for _, k, _ in found) for j in range(3)]


@pytest.mark.parametrize("lane", [32, 512])
def test_automaton_finds_where_matches_begin(lane, monkeypatch):
    monkeypatch.setattr(automaton, "LANE", lane)
    rng = random.Random(2)
    for pattern in ("a(b|c)*d", "[^a]b{2,3}", "x?y+|z{2}", "(ab?){1,2}c", "a *d"):
        a = automaton.compile_rules([(pattern, False)], anywhere=True, backward=True)
        texts = ["".join(rng.choice("abcdxyz" + " " * rng.choice([0, 40])) for _ in range(rng.choice([0, 3, 12, 200]))) for _ in range(200)]
        raw, offsets = wordbytes.text_bytes(pa.array(texts))
        at, _ = automaton.starts(a, raw, offsets)
        assert at.tolist() == [offsets[k] + i for k, t in enumerate(texts) for i in range(len(t)) if re.compile(pattern).match(t, i)]


def test_secrets_of_long_texts_take_linear_time(spark):
    """Ten megabytes of one run each: the quadratic way takes days."""
    texts = ["0123456789abcdef" * 640 * 1024, "AKIA" * 2_500_000, "token=" + "x" * 10_000_000, "secret =" + " " * 1_000_000 + "abcdefghijkl", "token=abc " * 100_000]
    began = time.monotonic()
    got = [r["spans"] for r in secrets.secrets(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).orderBy("doc_id").collect()]
    assert got == [f"hex:0:{len(texts[0])}", f"access:0:{len(texts[1])}", f"assign:0:{len(texts[2])}", f"assign:0:{len(texts[3])}", ""]
    assert time.monotonic() - began < 60


# ---- toxicity ----


def brute_segments(scores):
    """All maximal segments by their definition: the best segment, then the same on both sides of it."""
    if not len(scores) or max(scores) <= 0:
        return []
    sums = np.append(0.0, np.cumsum(scores))
    best = max(((sums[j] - sums[i], -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)))
    i, j = -best[2], -best[2] - best[1]
    return [*brute_segments(scores[:i]), (i, j, best[0]), *[(a + j, b + j, s) for a, b, s in brute_segments(scores[j:])]]


def test_maximal_segments():
    rng = np.random.default_rng(3)
    for _ in range(200):
        scores = np.round(rng.normal(-0.2, 1, rng.integers(0, 14)), 3)
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(scores)] == [(a, b) for a, b, _ in brute_segments(scores)]


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(1500):
        words = [rng.choice(VOCABULARY) + rng.choice(VOCABULARY) for _ in range(80)]
        if i % 6 == 0:
            for _ in range(4):
                words[rng.randrange(80)] = rng.choice(["awful", "nasty", "vilely"])
        rows.append((i, " ".join(words), "s"))
        marks.append((i, int(i % 6 == 0)))
    out = toxicity.toxicity(docs(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")).toPandas().set_index("doc_id")
    held = out[out["held_out"]]
    assert list(held.index) == [i for i in held.index if zlib.crc32(str(i).encode()) % 5 == 0] and 200 < len(held) < 400
    assert (held["predicted"] == (held.index % 6 == 0)).mean() > 0.98 and out["score"].between(0, 1).all()


# ---- shared helpers ----


def test_words_of_many_texts():
    texts = ["a b", "", "c", "  d\te ", "f", None, "é g"]
    raw, offsets = wordbytes.text_bytes(pa.array(texts))
    starts, ends, counts = wordbytes.words(raw, offsets)
    assert counts.tolist() == [len(WORDS.findall(t or "")) for t in texts]
    assert [bytes(raw[s:e]).decode() for s, e in zip(starts, ends)] == [w for t in texts for w in WORDS.findall(t or "")]
    hashes = wordbytes.word_hashes(raw, offsets, starts, ends)
    assert len(set(hashes.tolist())) == len(hashes)


def test_shared_folder_is_that_of_the_session(spark):
    assert common.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.mark.parametrize(
    "page, texts",
    [
        ('<svg-icon name="x"></svg-icon><article><p>Main one.</p><p>Main two.</p></article>', ["Main one.", "Main two."]),
        ("<template-card><p>a</p></template-card><title-bar>b</title-bar><p>c</p><script>x</script><p>d", ["a", "b", "c", "d"]),
        ("<svg><p>a</p><object><p>b</p><template><p>c", ["a", "b", "c"]),
        ("<svg><p>a</p><svg><text>i</text></svg><p>b</p>", ["a", "b"]),
        ("<noscript><style>s</style>Enable JS</noscript><svg><title>i</title><text>label</text></svg><p>a</p>", ["a"]),
        ("<object><object>x</object>y</object><p>a</p><svg/><p>b</p><SVG>t</Svg >c", ["a", "b", "c"]),
        ("<script>if (a</style>) b</script ><p>a</p><textarea>t</p>", ["a"]),
        ("<p class=lead'>It was theirs.</p><p>b's</p>", ["It was theirs.", "b's"]),
        ("<p \"x>a</p><p class=\"y>b</p><p>c</p>", ["a", "b", "c"]),
        ("<p title='1 > 0' class=\"a'b\">a</p><img alt=\"<p>x\"><p data-x = y/>b", ["a", "b"]),
        ("<!-->a<!--->b<!-- x --!>c<!-- -- > d -->e", ["abce"]),
        ("&lt;p&gt; &am<b>p;</b> &ampx &copy 1</p>", ["<p> &amp; &x © 1"]),
        ("</><?php x ?><![CDATA[y]]>a</ p>b<xmp><p>x</p></xmp><title/>c", ["abc"]),
        ("<a-b c=d>a</a-b><p =x>b<p x==\">\">c", ["a", "b", '">c']),
    ],
)
def test_elements_without_page_text_hide_no_more_than_themselves(page, texts):
    assert [t for t, _, _ in blocks(page)] == texts


def test_a_worker_keeps_few_runs_of_letters(monkeypatch):
    """Memory of a worker that has seen many words: runs of letters are dropped, and the ids stay those of the library."""
    from millrace.llm import tokens as t
    import public_tokenizers

    monkeypatch.setattr(t, "LETTERS", 100, raising=False)
    tok = t.ChunkTokenizer(public_tokenizers.path(t.DEFAULT))
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + k)}{m}" for i in range(300)) for k in range(6) for m in ("", ".")]
    found = [list(map(int, ids)) for text in texts for ids in tok.encode(pa.array([text]))]
    assert found == tok._plain(texts)
    assert len(tok._letters) <= 100 + 300


def test_forms_of_a_word_are_encoded_once_and_by_the_model_alone():
    """CPU time of op10_best_fit_packing, op3_token_counts and pipeline: case, marks and digits make no new words."""
    from millrace.llm import tokens as t
    import public_tokenizers

    tok = t.ChunkTokenizer(public_tokenizers.path(t.DEFAULT))
    words = [f"{a}{b}{c}ß" for a in "abcdéfgh" for b in "klmnop" for c in "rstuvö"]
    texts = [" ".join(form(w) for w in words) for form in (str, str.capitalize, lambda w: w[:-1].upper(), "{}.".format, "{}$$$,".format, "({}-{}%)".format(7, "{}").format)]
    expected, through = tok._plain(texts), []
    plain = tok._plain
    tok._plain = lambda chunks: through.extend(chunks) or plain(chunks)
    assert [ids.tolist() for text in texts for ids in tok.encode(pa.array([text]))] == expected
    assert through == []
    assert len(tok._letters) <= 2 * len(words) + 10


@pytest.mark.parametrize("plain_marks", [False, True])
def test_pieces_have_the_ids_of_the_tokenizer(plain_marks):
    from millrace.llm import tokens as t
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(t.DEFAULT)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = plain_marks
    rng = random.Random(4)
    parts = ["ab", "The", "ß", "É", "ÿ", "×", "÷", "Þ", "Ñ", ".", ",", "$$", "'", "'s", "'LL", "7", "42", "½", "²", "µ", "ª", "_", "<", ">", "|", "<|endoftext|>", " ", " ", "\n", "\t", "\u0301", "W\u030a", "İ", "ı", "ſ", "Ж", "中", "e\u0308", "\u00a0", "\u00ad", "\x1c", "\x00", "\x7f", "😀", "ﬁ", "\u2028", "Å", "\u0085"]
    texts = ["".join(rng.choice(parts[: rng.choice([16, 26, len(parts)])]) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + [None, "É" * 5000, "$" * 9000, "7" * 5000, "aB" * 6000]
    expected = [e.ids for e in library.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    tok = t.ChunkTokenizer(path, plain_marks)
    assert [ids.tolist() for ids in tok.encode(pa.array(texts))] == expected
    assert [ids.tolist() for ids in tok.encode(pa.array(texts).slice(7))] == expected[7:]
    tok._cuts, tok._letters = False, t._Store()
    assert [ids.tolist() for ids in tok.encode(pa.array(texts))] == expected
