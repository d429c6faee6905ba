import random

import corpus_pipeline as pipeline
from millrace.llm import near_dup, packing, quality
from millrace.llm.common import documents
from tests.llm.test_operators import VOCABULARY, brute_counts, jaccard_classes


def test_stages_hand_documents_on(spark, sf_dir):
    docs = documents(spark, sf_dir)
    columns, seen = docs.columns, [docs.count()]
    frames = [docs]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, sf_dir).checkpoint()
        frames.append(docs)
        seen.append(docs.count())
        if k < 4:
            assert docs.columns == columns
    assert seen[0] > seen[1] >= seen[2] >= seen[3]
    assert frames[2].select("text").distinct().count() == seen[2]
    near = near_dup.near_groups(frames[3]).collect()
    assert all(r["kept"] for r in near)
    mixed = frames[4].groupBy("doc_id").count()
    assert mixed.where("count > 2").count() == 0
    assert {r["doc_id"] for r in frames[5].select("doc_id").collect()} == {r["doc_id"] for r in frames[4].select("doc_id").collect()}
    used = frames[5].groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert all(r["sum(length)"] <= packing.CAPACITY for r in used)


def test_run_gives_the_last_stage(spark, sf_dir):
    assert pipeline.run(spark, sf_dir).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_verdicts_take_effect_on_rows_and_not_on_ids(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice("kalemi nopura seti vozu mira tolu") + rng.choice("abcdefgh") for _ in range(80))
    schema = "doc_id long, text string, source string"
    labels = "doc_id long, quality int, toxic int"
    clean, other, third = text(), text(), text()
    rows = [(1, clean, "a"), (1, clean, "a"), (None, other, "a"), (None, other, "a"), (None, "too short", "a"), (7, third, "a"), (7, "short too", "a")]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    kept = quality.kept_documents(docs, spark.createDataFrame([], labels))
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == sorted([(1, clean), (1, clean), (0, other), (0, other), (7, third)])
    exact = pipeline.exact_duplicates(spark, kept.checkpoint(), "")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in exact.collect()) == sorted([(1, clean), (0, other), (7, third)])
    words = other.split()
    twin = " ".join([*words[:-1], "else"])
    near = pipeline.near_duplicates(spark, spark.createDataFrame([(1, clean, "a"), (1, clean, "a"), (None, other, "a"), (None, twin, "a"), (7, third, "a"), (7, "short", "a")], schema), "")
    got = near.collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 1, 7, 7] and {"short", third, clean} <= {r["text"] for r in got}


def test_stages_keep_what_a_brute_force_version_keeps(spark, tmp_path):
    """Base rules, one row of each exact text, one of each class, water-filled targets and whole documents in sequences, worked out in plain Python."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(21)
    text = lambda n: " ".join(rng.choice(VOCABULARY) + rng.choice(VOCABULARY) for _ in range(n))
    texts = [text(rng.randint(40, 140)) for _ in range(30)]
    for k in range(12):
        words = texts[k].split()
        words[rng.randrange(len(words))] = "other"
        texts.append(" ".join(words))
    texts += texts[:8] + ["", None, "ka le mi " * 40]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    expected = {i: t for i, t, *_ in rows if brute_counts(t or "")[0] >= 50 and 100 * brute_counts(t or "")[4] <= 50 * brute_counts(t or "")[0]}
    stages, docs, kept = dict(pipeline.STAGES), documents(spark, str(tmp_path)), []
    for name in ("quality_rules", "exact_duplicates", "near_duplicates", "source_mix"):
        docs = stages[name](spark, docs, str(tmp_path)).checkpoint()
        kept.append(sorted(r["doc_id"] for r in docs.collect()))
    assert kept[0] == sorted(expected)
    first = {}
    for i, t in sorted(expected.items()):
        first.setdefault(t, i)
    assert kept[1] == sorted(first.values())
    classes = jaccard_classes([(i, expected[i], "s") for i in kept[1]])
    assert kept[2] == sorted(set(classes.values()))
    size = {i: len(expected[i].split()) for i in kept[2]}
    sources = {s: [i for i in kept[2] if i % 3 == s] for s in range(3)}
    left, budget, target = dict(enumerate((3.0, 1.0, 2.0))), 1.5 * sum(size.values()), {}
    while True:
        level = (budget - sum(target.values())) / sum(left.values())
        over = [s for s in left if left[s] * level > 2 * sum(size[i] for i in sources[s])]
        if not over:
            break
        for s in over:
            del left[s]
            target[s] = 2 * sum(size[i] for i in sources[s])
    target |= {s: w * level for s, w in left.items()}
    for s in range(3):
        taken = sum(size[i] for i in kept[3] if i % 3 == s)
        assert abs(taken - target[s]) <= max(size.values())
    assert max(kept[3].count(i) for i in kept[3]) <= 2
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = stages["best_fit_packing"](spark, docs, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["length"]) for r in pieces) == sorted((i, len(tok.encode(expected[i], add_special_tokens=False).ids) + 1) for i in kept[3])
