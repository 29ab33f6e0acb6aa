"""Cases that earlier versions of the operators got wrong: doubled caches, clashing names, pieces that no sequence has room for."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockroom.llm import packing, quality_model, quality_rules, queries, range_join, simhash, token_counts
from stockroom.llm.scratch import new_path, stored


def test_a_doubled_cache_counts_once(spark):
    docs, path = spark.createDataFrame([(1, "one two"), (2, "three"), (3, "one two")], "doc_id long, text string"), new_path(spark, "cache")
    want = sorted(map(tuple, token_counts.count_tokens(docs, queries.tokenizer_path(), path).collect()))
    held = stored(spark.read.schema(token_counts.CACHE_SCHEMA).parquet(path), "held")
    held.write.partitionBy("tokenizer").mode("append").parquet(path)  # as if two calls had appended at once
    assert spark.read.parquet(path).count() == 4
    assert sorted(map(tuple, token_counts.count_tokens(docs, queries.tokenizer_path(), path).collect())) == want and len(want) == 3
    assert spark.read.parquet(path).count() == 4  # nothing was missing


def test_kept_columns_may_not_name_results(spark):
    docs = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, score long").withColumn("n_tokens", F.lit(1))
    with pytest.raises(ValueError, match="keep"):
        token_counts.count_tokens(docs, queries.tokenizer_path(), new_path(spark, "c"), keep=("doc_id", "n_tokens"))
    with pytest.raises(ValueError, match="keep"):
        quality_model.scores(docs, None, keep=("doc_id", "score"))


def test_one_of_each_keeps_a_caller_column(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (None, "z", "w")], "doc_id long, text string, _text_key string")
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns and Counter(map(tuple, got.collect())) == {(1, "a b c d e f", "x"): 1, (None, "z", "w"): 1}


def test_pieces_over_the_attention_capacity_are_alone(spark):
    rows = [(i, 0, 0, n) for i, n in enumerate([2048, 100, 90, 50, 40, 30, 20, 10, 10, 5])]
    cut = stored(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long").withColumn("ids_crc32", F.lit(0).cast("long")), "cut")
    got = packing.pack(cut, attention=60.0**2, oversize="alone").collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    assert len(got) == len(rows)
    for own in by.values():
        assert len(own) == 1 or sum(r.length**2 for r in own) <= 3600
        assert sorted(r.offset for r in own) == list(np.cumsum([0, *(r.length for r in sorted(own, key=lambda r: r.offset))])[:-1])
    assert {tuple(r.length for r in own) for own in by.values()} >= {(2048,), (100,), (90,)}


def test_rules_are_timed_in_the_task_and_an_order_can_be_repeated(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, " ".join(rng.choices("ab", k=3000))) for i in range(120)], "id int, text string")
    dear = quality_rules.Rule(("n_repeat_words",), lambda m: m["n_repeat_words"] >= 0)
    cheap = quality_rules.Rule(("n_symbols",), lambda m: m["n_symbols"] >= 0)
    got = df.select(quality_rules._timed({"dear": dear, "cheap": cheap}, "text", 2).alias("r")).agg(F.sum(F.col("r.seconds")[0]), F.sum(F.col("r.seconds")[1]), F.min(F.col("r.hits")[0])).first()
    assert got[0] > 2 * got[1] > 0 and got[2]
    for names in (["shouting", "short", "few words", "symbols", "long words", "repeated lines", "repeated words"], list(quality_rules.standard_rules())):
        told = quality_rules.judged(df, order=names)
        assert {r.failed_rule for r in told.collect()} == {next(n for n in names if n in ("few words", "repeated words"))}
    assert quality_rules.order_rules(df, {}) == []


@pytest.mark.parametrize("dim", [1, 3, 64])
def test_partial_products_lose_no_pair(dim):
    rng = np.random.default_rng(dim)
    base = rng.normal(size=(40, dim))
    x = np.concatenate([base + 0.25 * rng.normal(size=base.shape) for _ in range(12)] + [rng.normal(size=(300, dim)), base[:5], -base[:5]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x[::3]
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(x @ y.T >= 0.9))))
    got = [(int(i), int(j)) for a, b in range_join.candidates(x, y, 0.9) for i, j in zip(a, b)]
    near = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.abs(x @ y.T - 0.9) < 1e-12))}
    assert len(got) == len(set(got)) and set(got) - near == want - near and want


def test_few_vectors_are_several_tasks(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(2100, 8)))], "vec_id long, embedding array<double>")
    seen = []
    before = range_join.cheapest
    range_join.cheapest = lambda *a: seen.append(a[-1]) or before(*a)
    try:
        range_join.range_links(rows).count()
    finally:
        range_join.cheapest = before
    assert seen == [525]


def _likeness(a: str, b: str, shingle: int) -> float:
    x, y = ({tuple(t.split()[i : i + shingle]) for i in range(len(t.split()) - shingle + 1)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_links_by_whole_fingerprints_alone_against_brute_force(spark):
    """Without views, what is found are texts whose fingerprints are equal or a few bits apart, and alike."""
    rng = random.Random(3)
    texts = []
    for _ in range(6):
        words = [f"w{rng.randrange(900)}" for _ in range(300)]
        for _ in range(8):
            again = list(words)
            for at in rng.sample(range(300), rng.randrange(4)):
                again[at] = f"x{rng.randrange(900)}"
            texts.append(" ".join(again))
    marks = [simhash.simhash(t, 5) & (1 << 64) - 1 for t in texts]
    root = list(range(len(texts)))
    for _ in texts:  # the smallest that links lead to
        for i in range(len(texts)):
            for j in range(i):
                if (marks[i] ^ marks[j]).bit_count() <= 3 and _likeness(texts[i], texts[j], 5) >= 0.8:
                    root[i] = root[j] = min(root[i], root[j])
    assert 6 < len(set(root)) < len(texts)
    got = simhash.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), views=0, block_rows=3)
    assert dict(got.collect()) == dict(enumerate(root))


def test_a_dense_family_is_joined_before_its_pairs_of_fingerprints(spark, monkeypatch):
    """Copies that views have joined make no bucket for each pair of close fingerprints; a very long text takes part."""
    words = [f"w{i * 7919 % 4001}" for i in range(4000)]
    texts = [" ".join([*words[:at], "other", *words[at + 1 :]]) for at in range(0, 4000, 100)]
    long = " ".join(f"v{i}" for i in range(300_000))
    rows = list(enumerate([*texts, long, long + " end", None, ""]))
    passes, inside = [], simhash.linked_in_buckets
    monkeypatch.setattr(simhash, "linked_in_buckets", lambda *a, **k: passes.append(k.get("known")) or inside(*a, **k))
    got = dict(simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {i: 0 if i < 40 else 40 if i < 42 else 42 for i in range(44)}
    assert passes == [None]
