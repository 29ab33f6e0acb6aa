"""The ten operators against brute force, round trips and held-out labels, with odd rows in every table."""

import math
import random
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stockroom.llm import components, encoding, languages, mixing, packing, quality_model, quality_rules, queries, range_join, sharding, simhash, token_counts, url_lists
from stockroom.llm.scratch import new_path, stored

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, vec string, _row string, group_no string, probability string"
ODD = [None, "", " \t\n", "one", "<|endoftext|> x", "a  b\n\n c ", "é日 x", "spam " * 3000, "a b c d e f g h i\na b c d e f g h i\n", "a b c d e f g h i\na b c d e f g h i\n"]


@pytest.fixture(scope="module")
def docs(spark):
    """Odd texts, repeated rows, null ids and clashing columns, with some documents of the small table."""
    real = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    texts = ODD + real + real[:3]
    given = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else "s1", None) for i, t in enumerate(texts)] + [(3, "one", "en", "s1", 3), (None, "no id", "en", "s1", 5), (None, "no id", "en", "s1", 5), (None, None, None, None, None)]
    return stored(spark.createDataFrame([(*g, "s", "v", "r", "g", "p") for g in given], DOCS), "odd")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def tokens(text):
    return encoding.encoder(queries.tokenizer_path()).library.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library_on_every_code_point():
    e = encoding.encoder(queries.tokenizer_path())
    assert e.fast is not None
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF][::7]
    texts = [f"a{chr(c)} {chr(c)}1{chr(c)}{chr(c)} .{chr(c)}\n" for c in points] + [t or "" for t in ODD]
    told = e.library.encode_batch(texts, add_special_tokens=False)
    assert [np.asarray(x.ids, "<u4").tobytes() for x in told] == e.ids(texts)


def test_other_tokenizers_go_to_the_library():
    import public_tokenizers

    e = encoding.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert e.fast is None and len(e.ids(["Some words", None])[0]) > 0


def test_token_counts_use_the_cache(spark, docs, empty):
    path = new_path(spark, "cache")
    got = token_counts.count_tokens(docs, queries.tokenizer_path(), path, keep=("doc_id", "text")).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), len(tokens(r.text)), len(tokens(r.text)) > 512)
    held = spark.read.parquet(path)
    assert held.count() == held.select("content").distinct().count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    held.withColumn("n_tokens", F.lit(7).cast("long")).write.partitionBy("tokenizer").parquet(path + "-old")
    again = token_counts.count_tokens(docs.unionByName(docs.limit(1).withColumn("text", F.lit("quite new"))), queries.tokenizer_path(), path + "-old").collect()
    assert Counter(r.n_tokens for r in again) == {7: docs.count(), len(tokens("quite new")): 1}
    assert token_counts.count_tokens(empty, queries.tokenizer_path(), new_path(spark, "c")).count() == 0


def test_quality_rules(docs, empty):
    got = {}
    for r in quality_rules.judged(docs).collect():
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in r.text or "").split(" ") if w]
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        repeated = len({j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)})
        lines = [x for x in (r.text or "").split("\n") if x.strip(" \t\x0b\x0c\r")]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(words), sum(map(len, words)), repeated, len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in r.text or "") and r.base_failed == (len(words) < 20 or 100 * repeated > 30 * len(words))
        assert r.kept == (r.failed_rule is None) and not (r.kept and r.base_failed)
        got[r.doc_id] = r.kept
    assert got and quality_rules.judged(empty).count() == 0


def test_cascade_order_changes_no_verdict(docs, empty):
    rules = quality_rules.standard_rules()
    verdict = lambda names: Counter(docs.select("doc_id", "text", quality_rules.cascade(names, rules, quality_rules.body_of("text")).isNull().alias("k")).collect())
    want = verdict(list(rules))
    assert want == verdict(list(rules)[::-1]) == Counter(quality_rules.judged(docs).select("doc_id", "text", F.col("kept").alias("k")).collect())
    assert Counter(r.doc_id for r in quality_rules.passed(docs).collect()) == Counter(r.doc_id for r in want.elements() if r.k)
    assert quality_rules.order_rules(empty, rules) == list(rules) and quality_rules.passed(empty).count() == 0


def test_length_alone_rejects_no_text(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    long = " ".join(rng.choices(vocabulary, weights=[1 / (i + 9) for i in range(3000)], k=40_000))
    poor = " ".join(rng.choices(vocabulary[:150], k=40_000))
    near = lambda t: sum(len(set(t.split()[i : i + quality_rules.STRETCH])) for i in range(0, len(t.split()), quality_rules.STRETCH))
    df = spark.createDataFrame([(i, t) for i, t in enumerate([long, poor, long + " end", "one two three", "", None])], "id int, text string")
    with_near = quality_rules.with_measures(["n_distinct_near"], quality_rules.body_of("text"), lambda m: m["n_distinct_near"])
    assert [r.n for r in df.orderBy("id").select(with_near.alias("n")).collect()] == [near(r.text or "") for r in df.orderBy("id").collect()]
    assert {r.id for r in quality_rules.passed(df, min_words=1).collect()} == {0, 2, 3}
    assert {r.id for r in quality_rules.judged(df, min_words=1).where("kept").collect()} == {3}


def test_rules_are_ordered_by_rejection_per_cost_from_the_raw_text(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(" ".join(rng.choices("abcdefgh", k=4000)),) for _ in range(200)], "text string")
    dear = quality_rules.Rule(("n_repeat_words",), lambda m: m["n_repeat_words"] >= 0)
    cheap = quality_rules.Rule(("n_symbols",), lambda m: m["n_symbols"] >= 0)
    never = quality_rules.Rule(("n_lines",), lambda m: m["n_lines"] < 0)
    assert quality_rules.order_rules(df, {"never": never, "dear": dear, "cheap": cheap}) == ["cheap", "dear", "never"]


def test_a_rejected_row_reaches_no_later_measure(spark, monkeypatch):
    monkeypatch.setitem(quality_rules.MEASURES, "broken", (("text",), lambda m: F.raise_error(F.lit("reached")).cast("int")))
    rules = {"short": quality_rules.base_rules()["short"], "broken": quality_rules.Rule(("broken",), lambda m: m["broken"] > 0)}
    run = lambda names, text: spark.createDataFrame([(text,)], "text string").select(quality_rules.cascade(names, rules, quality_rules.body_of("text"))).first()[0]
    assert run(["short", "broken"], "few words") == "short"
    for names, text in ((["broken", "short"], "few words"), (["short", "broken"], "many words " * 20)):
        with pytest.raises(Exception, match="reached"):
            run(names, text)


def test_minimax_cuts_against_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        sizes, k = [rng.randint(0, 20) for _ in range(rng.randint(1, 9))], rng.randint(1, 4)
        best = {(0, 0): 0}
        for parts in range(1, k + 1):
            for end in range(len(sizes) + 1):
                best[parts, end] = min((max(best.get((parts - 1, s), math.inf), sum(sizes[s:end])) for s in range(end + 1)), default=math.inf)
        assert sharding.minimax_cuts(np.array(sizes), k)[0] == best[k, len(sizes)]


def test_sharding(docs, empty):
    for atoms in (8, 1 << 17):
        got = sharding.shard_documents(docs, shards=5, atoms=atoms, lane_rows=3).collect()
        assert len(got) == docs.count()
        slots = {s: sorted(r.slot for r in got if r.shard == s) for s in {r.shard for r in got}}
        assert all(v == list(range(len(v))) for v in slots.values()) and all(0 <= s < 5 for s in slots)
        where = {}
        for r in got:
            where.setdefault((r.size, r.text_crc32), set()).add(r.shard)
        assert all(len(v) == 1 for v in where.values())
    assert Counter((r.size, r.text_crc32) for r in got) == Counter((len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sharding.shard_documents(empty).count() == 0


def test_packing_round_trip(docs, empty):
    got = packing.pack_documents(docs, queries.tokenizer_path(), group=16).collect()
    for r in docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect():
        ids = [*tokens(r.text), 0]
        parts = sorted({(p.piece, p.start, p.length, p.ids_crc32) for p in got if p.doc_id == r.doc_id})
        assert [p[0] for p in parts] == list(range(len(parts))) and sum(p[2] for p in parts) == len(ids)
        assert all(n == 2048 for _, _, n, _ in parts[1:]) and all(zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) == c for _, s, n, c in parts)
    seqs = {}
    for p in got:
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for v in seqs.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(seqs) <= 1.5 * sum(p.length for p in got) / 2048 + 8
    assert packing.pack_documents(empty, queries.tokenizer_path()).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_keeps_every_capacity(spark, rule):
    lengths = np.random.default_rng(3).integers(1, 100, 400)
    bins, at = packing.best_fit(lengths, 200, 5, 12_000.0, (1.0, 0.5, 0.5), rule)
    for b in set(bins):
        own = lengths[bins == b]
        assert own.sum() <= 200 and len(own) <= 5 and (own.astype(float) ** 2).sum() <= 12_000 + 1e-6
    free, _ = packing.best_fit(lengths, 200, 400, 200.0**2, (1.0, 0.5, 0.5), rule)
    few, _ = packing.best_fit(lengths, 200, 3, 200.0**2, (1.0, 0.5, 0.5), rule)
    assert len(set(free)) < len(set(bins)) and len(set(free)) < len(set(few)) and max(Counter(free).values()) > 5
    one, other = (packing.best_fit(lengths, 200, 5, 12_000.0, w, rule)[0] for w in ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0)))
    assert (one != other).any()
    df = stored(spark.createDataFrame([(i, 0, 0, int(n), 1) for i, n in enumerate(lengths)], packing.PIECES), "pieces")
    got = packing.pack(df, capacity=200, documents=5, attention=12_000.0, rule=rule).toPandas()
    for _, g in got.groupby("sequence_id"):
        assert g.length.sum() <= 200 and len(g) <= 5 and (g.length**2).sum() <= 12_000
    with pytest.raises(ValueError):
        packing.pack(df, capacity=200, attention=9000.0)


def test_very_long_white_space_is_encoded_by_the_library():
    e = encoding.encoder(queries.tokenizer_path())
    for text in (" " * 2_000_000 + "x", "\n" * 1_500_000):
        assert len(e.ids([text])[0]) == 4 * len(e.library.encode(text, add_special_tokens=False).ids)


def test_raking(spark, docs, empty):
    cells = stored(spark.createDataFrame([(s, lang, t, n) for n, (s, lang, t) in enumerate(((s, lang, t) for s in "abc" for lang in "xy" for t in "pq"), 1)], "source string, lang string, topic string, tokens long"), "cells")
    want = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"x": 0.6, "y": 0.4}, "topic": {"p": 0.9, "q": 0.1}}
    targets = spark.createDataFrame([(d, v, s) for d, m in want.items() for v, s in m.items()], "dimension string, value string, share double")
    got = mixing.rake(cells, targets).toPandas()
    for d, m in want.items():
        assert np.allclose(got.groupby(d).weight.sum()[list(m)], list(m.values()), atol=1e-9)
    drawn = mixing.mixed(docs)
    assert drawn.count() == docs.count() and drawn.agg(F.max("probability"), F.min("probability")).first()[0] == 1.0
    assert drawn.columns.count("probability") == 1 and mixing.mixed(empty).count() == 0


def test_documents_without_tokens_are_not_drawn(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "en"), (1, "a b", "s", "en"), (None, None, None, None)], "doc_id long, text string, source string, lang string")
    none = mixing.mixed(docs, budget=0.5, tokens=F.lit(0).cast("long")).select("copies", "probability").collect()
    assert [tuple(r) for r in none] == [(0, 0.0)] * 3 and mixing.mixed(docs.limit(0), budget=0.5).count() == 0


def test_mixing_budget_is_not_set_by_one_rare_cell(spark):
    rng = random.Random(6)
    rows = [(i, "word " * rng.randint(50, 150), f"s{i % 3}", "en" if i % 4 else "de") for i in range(3000)]
    schema = "doc_id long, text string, source string, lang string, copies string"
    budget = lambda given: mixing.mixed(spark.createDataFrame([(*r, "c") for r in given], schema), budget=0.5).toPandas()
    plain, stray = budget(rows), budget([*rows, (9999, "x " * 120, None, None)])
    for got in (plain, stray):
        assert abs((got.probability * got.tokens).sum() / got.tokens.sum() - 0.5) < 1e-3 and abs((got.copies * got.tokens).sum() / got.tokens.sum() - 0.5) < 0.04
        assert (got.copies - got.probability).abs().max() < 1 and (got.sampled == (got.copies > 0)).all()
    assert abs(plain.sampled.mean() - stray[stray.doc_id != 9999].sampled.mean()) < 0.02
    assert stray[stray.doc_id == 9999].probability.item() > 1 and stray[stray.doc_id == 9999].copies.item() >= 1


def brute_components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 30)] + [(40, i) for i in range(41, 80)] + [(rng.randint(80, 160), rng.randint(80, 160)) for _ in range(50)]
    want = brute_components(161, pairs)
    given = spark.createDataFrame([*pairs, *((b, a) for a, b in pairs[:5]), (None, 3), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(given).collect()}
    assert all(want[x] == y for x, y in got.items()) and set(got) == {x for p in pairs if p[0] != p[1] for x in p}
    assert components.components(given.limit(0)).count() == 0


@pytest.mark.parametrize("block", [16_384, 8])
def test_range_join(spark, block):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 8))
    made = [list(map(float, b + rng.normal(size=8) * s)) for b in base for s in (0, 0.1, 0.3)] + [list(map(float, base[0]))] * 5
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [1.0, None] + [0.0] * 6, [float("inf")] + [0.0] * 7, made[0] + [0.0], made[0][:7]]
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(made + odd)], "vec_id long, embedding array<float>, key string")
    x = np.array([np.float32(v) for v in made], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    want = brute_components(len(made), [(i, j) for i in range(len(made)) for j in range(i) if near[i, j]])
    got = {r.vec_id: r for r in range_join.range_links(df, block_rows=block).collect()}
    assert [got[i].n_links for i in range(len(made))] == list(near.sum(axis=1) - 1) and [got[i].component_id for i in range(len(made))] == want
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(len(made), len(made) + len(odd)))
    assert range_join.range_links(df.limit(0)).count() == 0


def clusters(rng, n, dims=16, groups=40):
    centres = rng.normal(size=(groups, dims))
    x = centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dims)) * 0.08
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_cells_of_clustered_vectors_send_few_rows_and_lose_no_pair():
    rng, radius = np.random.default_rng(12), math.sqrt(0.2)
    sent = []
    for n in (2000, 10_000):
        x = clusters(np.random.default_rng(12), n)
        pivots = range_join.cheapest(range_join.spread_pivots(x[:1000], 1024, radius), x[:1000], n, radius, 256)
        own, guest = range_join.dealt(range_join.distances(x, pivots), range_join.distances(pivots, pivots), None, radius)
        assert len(pivots) >= 16
        sent.append(1 + guest.sum() / n)
    assert sent[1] < 1.3 * sent[0] < 4
    x = np.vstack([clusters(rng, 600), rng.normal(size=(200, 16))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pivots = range_join.spread_pivots(x[:300], 32, radius)
    own, guest = range_join.dealt(range_join.distances(x, pivots), range_join.distances(pivots, pivots), None, radius)
    i, j = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    apart = own[i] != own[j]
    low, high = np.where(own[i] < own[j], i, j), np.where(own[i] < own[j], j, i)
    assert apart.any() and guest[high[apart], own[low[apart]]].all()


@pytest.mark.parametrize("block", [16_384, 50])
def test_range_join_of_clusters_against_brute_force(spark, block):
    x = np.float32(clusters(np.random.default_rng(3), 900, groups=12)).astype(float)
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T >= 0.9
    want = brute_components(len(x), [(i, j) for i, j in zip(*np.nonzero(np.tril(near, -1)))])
    got = sorted(range_join.range_links(df, block_rows=block).collect())
    assert [r.n_links for r in got] == list(near.sum(axis=1) - 1) and [r.component_id for r in got] == want


HUGE = [2**53 + 1, 2**63 - 1, 2**62 + 5, -(2**63), -7, None]


def test_ids_of_any_size_beside_a_null(spark):
    texts = [f"some text of its own, number {i}, with words that no other has {i * i}" for i in range(4)] + ["the same words twice"] * 2
    df = spark.createDataFrame([*zip(HUGE, texts)], "doc_id long, text string").coalesce(1)
    want = Counter(HUGE)
    assert Counter(r.doc_id for r in packing.pack_documents(df, queries.tokenizer_path()).collect()) == want
    got = simhash.near_duplicates(df).collect()
    assert Counter(r.doc_id for r in got) == want and Counter(r.component_id for r in got) == Counter([*HUGE[:4], -7, -7])
    assert Counter(r.component_id for r in simhash.similar_documents(df).collect()) == Counter([*HUGE[:4], -7, -7])
    assert Counter(r.doc_id for r in simhash.one_of_each(df).collect()) == Counter(HUGE[:5])
    vecs = spark.createDataFrame([(v, [1.0, 0.1] if i > 3 else [-float(i), i * i - 3.0]) for i, v in enumerate(HUGE)], "vec_id long, embedding array<float>").coalesce(1)
    got = {r.vec_id: r.component_id for r in range_join.range_links(vecs).collect()}
    assert set(got) == set(HUGE) and got[None] == got[-7] == -7
    pages = spark.createDataFrame([(v, "http://a.org/", "<p>some words") for v in HUGE], "page_id long, url string, html string").coalesce(1)
    known = spark.createDataFrame([("some words of this", "en"), ("quelques mots", "fr")], "text string, lang string")
    assert Counter(r.page_id for r in languages.identify(pages, known).collect()) == want


def test_fingerprints_and_links(docs, empty, spark):
    from xxhash import xxh64_intdigest

    def plain(text):
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        h = [xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    ids = {r.doc_id: r.text for r in docs.where("doc_id IS NOT NULL").collect()}
    fps = {d: plain(t) for d, t in ids.items()}
    order = sorted(ids)
    want = brute_components(len(order), [(i, j) for i in range(len(order)) for j in range(i) if (fps[order[i]] ^ fps[order[j]]).bit_count() <= 3])
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", order[want[order.index(r.doc_id)]])
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("k", [1, 3, 5])
def test_pigeonhole_loses_no_link(spark, k):
    rng = random.Random(k)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(5):
            fps.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, k + 1)))
    signed = {x - (1 << 64) if x >> 63 else x: x for x in fps}
    df = stored(spark.createDataFrame([(s, i) for i, s in enumerate(signed)], "fp long, node long"), "fps")
    values = list(signed.values())
    want = {tuple(sorted((i, j))) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= k}
    assert {tuple(sorted((r.a, r.b))) for r in simhash.links(df, k=k).collect()} == want


def test_thresholds_are_allocated_at_least_cost():
    assert simhash.allocate([[0, 1, 9], [0, 1, 9], [0, 5, 5]], 3)[0] == 6.0 and sum(t + 1 for t in simhash.allocate([[0, 1, 2, 3, 4]] * 3, 4)[1]) == 4


def test_similar_documents(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    base = [[word() for _ in range(200)] for _ in range(6)]
    texts = [" ".join(b) for b in base] + [base[0][0].upper() + "  " + " ".join(base[0][1:])]
    texts += [" ".join([*b[:50], word(), *b[51:]]) for b in base]  # one word of 200: similarity 0.95
    texts += [" ".join([*base[0][:60], *(word() for _ in range(140))]), "", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "x"), (None, "x"), (5, texts[5])], "doc_id long, text string")
    kept = Counter(r.doc_id for r in simhash.one_of_each(df).collect())
    assert kept == Counter([*range(6), 13, 14, None])
    got = simhash.similar_documents(df).collect()
    assert len(got) == df.count() and {r.component_id for r in got if r.doc_id == 7} == {0}
    assert simhash.one_of_each(df.limit(0)).count() == 0


@pytest.mark.parametrize("block_rows", [512, 16])
def test_copies_around_a_hub_that_is_not_the_smallest(spark, block_rows):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    hub = [word() for _ in range(200)]
    copies = []
    for _ in range(100):  # each at 0.8 or more to the hub, at about 0.67 to the others
        at = set(rng.sample(range(200), 4))
        copies.append(" ".join(word() if i in at else w for i, w in enumerate(hub)))
    df = spark.createDataFrame([*enumerate(copies), (70_000, " ".join(hub))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(df, block_rows=block_rows).collect()}
    assert len(got) == 101 and set(got.values()) == {0}


def test_recall_at_the_threshold_beside_a_bucket_of_hundreds(spark):
    """Of pairs with a similarity of 0.80 to 0.85 at least 0.9 are joined; texts that share a long passage but are not alike stay apart."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts, pairs = [], []
    for _ in range(120):
        base = [word() for _ in range(200)]
        at = set(rng.sample(range(5, 195), 4))
        pairs.append((len(texts), len(texts) + 1))
        texts += [base, [word() if i in at else w for i, w in enumerate(base)]]
    shared = [word() for _ in range(120)]
    first = len(texts)
    texts += [[word() for _ in range(20)] + shared + [word() for _ in range(20)] for _ in range(300)]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    pairs = [p for p in pairs if 0.8 <= alike(*p) <= 0.85]
    assert len(pairs) > 60 and all(alike(first, j) < 0.8 for j in range(first + 1, len(texts)))
    got = dict(simhash.similar_documents(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect())
    assert np.mean([got[i] == got[j] for i, j in pairs]) >= 0.9
    assert all(got[j] == j for j in range(first, len(texts)))


def test_blocks_against_brute_force():
    rng = np.random.default_rng(8)
    base = [rng.choice(2000, 40, replace=False) for _ in range(6)]
    sets = [np.unique(np.append(rng.permutation(base[i % 6])[: rng.integers(30, 41)], rng.integers(0, 2000, 2))).astype(np.int32) for i in range(60)] + [np.zeros(0, np.int32)]
    alike = lambda x, y: len(set(x) & set(y)) >= 0.7 * len(set(x) | set(y)) > 0
    for left in (61, 20):
        want = brute_components(61, [(i, j) for i in range(left) for j in range(0 if left == 61 else left, 61) if i != j and alike(sets[i], sets[j])])
        assert simhash.block_roots(sets, left, 0.7).tolist() == want


def test_isotonic_and_held_out_accuracy(spark):
    x, y = quality_model.isotonic(np.arange(5.0), np.array([0, 0.6, 0.4, 1, 0.9]), np.ones(5))
    assert np.all(np.diff(y) >= 0) and np.interp(1.5, x, y) == 0.5
    d, labels = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    got = quality_model.scores(d, quality_model.fit(d, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all() and (got.predicted == got.quality).mean() > 0.9


def test_features_and_ridge_against_plain_numpy(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["a", "bb", "ccc", "d!", "E", "#"], rng.integers(1, 60))) + ("\n" if i % 3 else "") for i in range(300)] + ["", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(rng.integers(0, 2))) for i in range(302)], "doc_id long, quality int")
    model = quality_model.fit(df, labels, waves=32)
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i in range(302)}
    y = {r.doc_id: r.quality for r in labels.collect()}
    x = {}
    for i, t in enumerate(texts):
        t = t or ""
        words, lines, n = t.split(), t.split("\n"), max(len(t), 1)
        k = max(len(words), 1)
        share = lambda signs: sum(c in signs for c in t) / n
        x[i] = [math.log1p(len(t)), share("#*$%&|<>"), sum(c.isupper() for c in t) / n, share("0123456789"), share("!?"), share(".,;:"), share(" \t\n"), share("@/_=(){}[]\\"),
                math.log1p(len(words)), len(set(words)) / k, sum(a == b for a, b in zip(words, words[1:])) / k, math.log1p(len(lines)), len(set(lines)) / len(lines)]
    train = np.array([x[i] for i in x if fold[i] != 0])
    assert np.allclose(model.mean, train.mean(axis=0)) and np.allclose(model.scale, np.maximum(train.std(axis=0), 1e-9))
    z = np.array([[math.sqrt(2 / 32) * math.cos(np.clip((np.array(x[i]) - model.mean) / model.scale, -8, 8) @ model.turn[:, w] + model.phase[w]) for w in range(32)] + [1.0] for i in x if fold[i] > 1])
    want = np.array([y[i] for i in x if fold[i] > 1], float)
    penalty = np.diag([1e-3 * len(train) / 32] * 32 + [1e-9])
    assert np.allclose(model.beta, np.linalg.inv(z.T @ z + penalty) @ z.T @ want, atol=1e-6)
    near, far = np.zeros((1, 13)), np.full((1, 13), 0.5)
    big = quality_model.Model(np.zeros(13), np.ones(13), np.random.default_rng(0).normal(0, math.sqrt(2 * 0.05), (13, 20_000)), np.random.default_rng(1).uniform(0, 2 * math.pi, 20_000), None, None, None)
    kernel = (big.features(near)[:, :-1] @ big.features(far)[:, :-1].T).item()
    assert abs(kernel - math.exp(-0.05 * 13 * 0.25)) < 0.02  # the Gaussian kernel that the cosines approximate


def test_quality_scores_of_odd_rows(docs, empty, spark):
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(40)] + [(None, 1, 0, "x"), (1, None, 0, "x")], "doc_id long, quality int, toxic int, fold string")
    model = quality_model.fit(docs, labels)
    got = quality_model.scores(docs, model, keep=("doc_id", "text")).collect()
    assert len(got) == docs.count() and all(r.held_out is None if r.doc_id is None else r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert quality_model.fit(docs, labels.limit(0)) is None and quality_model.scores(docs, None).count() == docs.count()
    assert quality_model.scores(empty, model).count() == 0


def test_temporal_lists(spark):
    ts = lambda d: f"2024-01-{d:02d} 00:00:00"
    log = [("l", "deny", "bad.com", "add", ts(2)), ("l", "deny", "bad.com", "remove", ts(4)), ("l", "deny", "bad.com", "add", ts(6)), ("t", "allow", "ok.bad.com", "add", ts(7)), ("l", "deny", "x.org/a", "add", ts(1)), ("l", "deny", "tie.com", "add", ts(3)), ("l", "deny", "tie.com", "remove", ts(3)), ("l", "deny", None, "add", ts(1))]
    entries = spark.createDataFrame(log, "list string, verdict string, key string, action string, dated string").withColumn("dated", F.to_timestamp("dated"))
    seen = [("http://www.Bad.com/p", 1, 0, None), ("http://bad.com:80/", 2, 1, "bad.com"), ("http://bad.com", 4, 0, None), ("http://u@ok.bad.com./q", 6, 1, "bad.com"), ("https://ok.bad.com/q", 8, 2, "ok.bad.com"), ("http://x.org/a/b", 5, 1, "x.org/a"), ("http://x.org/b", 5, 0, None), ("http://tie.com", 9, 0, None), (None, 5, 0, None), ("nonsense", 5, 0, None), ("http://bad.com", None, 0, None)]
    caps = spark.createDataFrame([(i, u, ts(d) if d else None, "h") for i, (u, d, _, _) in enumerate(seen)] * 2, "page_id long, url string, fetched_at string, host string").withColumn("fetched_at", F.to_timestamp("fetched_at"))
    got = sorted((r.page_id, r.n_active, r.decided_by, r.blocked) for r in url_lists.filter_urls(caps, entries).collect())
    assert got == sorted([(i, n, k, k not in (None, "ok.bad.com")) for i, (_, _, n, k) in enumerate(seen)] * 2, key=lambda r: (r[0],))
    assert url_lists.filter_urls(caps, entries.limit(0)).where("blocked").count() == 0 and url_lists.filter_urls(caps.limit(0), entries).count() == 0


def test_languages(spark):
    pages = queries.table(spark, SF, "pages").withColumn("text", F.lit("clash"))
    odd = spark.createDataFrame([(-1, None, None, "c"), (-2, "http://a.fr/", "", "c")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in languages.identify(pages.unionByName(odd), queries.table(spark, SF, "documents")).collect()}
    assert len(got) == pages.count() + 2 and got[-1].lang in ("de", "en", "es", "fr")
    agree = [r.lang == r.declared for r in got.values() if r.declared]
    assert np.mean(agree) > 0.95
    assert languages.identify(pages.limit(0), queries.table(spark, SF, "documents")).count() == 0
    assert languages.identify(odd, queries.table(spark, SF, "documents").limit(0)).where("lang IS NULL").count() == 2


def test_page_texts_are_read_in_linear_time(spark):
    odd = ["<" * 2_000_000, "<script " * 300_000, "<html lang " * 200_000, "&a" * 1_000_000, "<style>" * 300_000 + "x"]
    df = spark.createDataFrame([(i, "http://h" + "." * 100_000 + "x/", t) for i, t in enumerate(odd)] + [(9, "http://a.org/", "<p>ab<b>cd</b> é<script>var x</script>&amp;f < g")], "page_id long, url string, html string")
    began = time.perf_counter()
    got = {r.page_id: r for r in languages.page_evidence(df, (["en"], np.zeros((1, languages.BUCKETS)))).collect()}
    assert time.perf_counter() - began < 60 and len(got) == 6 and got[0].host == ""
    assert df.where("page_id = 9").select(languages.letters_of(F.col("html"))).first()[0].split() == ["ab", "cd", "é", "f", "g"]


def test_fusion_against_plain_python(spark):
    docs = [("the cat and the dog were here in the house", "en"), ("le chat et le chien dans la maison", "fr"), ("die katze und der hund im haus", "de"), ("the other house was there", "en")]
    pages = [
        (1, "http://a.one.co.uk/", "<html lang=en><p>the house and the dog"), (2, "http://b.one.co.uk/fr/", "<p>le chien"), (3, "http://b.one.co.uk/", ""), (4, "http://x.two.fr/", "<html lang='fr'>la maison la maison"),
        (5, "http://x.two.fr/q", "1 2"), (6, None, "der hund"), (7, "http://10.0.0.1/de", "<html lang=de>im haus"), (8, "http://three.fr/", None), (1, "http://a.one.co.uk/", "<html lang=en><p>the house and the dog"),
    ]
    facts = {1: ("a.one.co.uk", "one.co.uk", "co.uk", "en", "uk"), 2: ("b.one.co.uk", "one.co.uk", "co.uk", "", "fr"), 3: ("b.one.co.uk", "one.co.uk", "co.uk", "", "uk"), 4: ("x.two.fr", "two.fr", "fr", "fr", "fr"),
             5: ("x.two.fr", "two.fr", "fr", "", "fr"), 6: ("", "", "", "", ""), 7: ("10.0.0.1", "10.0.0.1", "0.0.1", "de", "de"), 8: ("three.fr", "three.fr", "fr", "", "fr")}
    words = {1: "the house and the dog", 2: "le chien", 3: "", 4: "la maison la maison", 5: " ", 6: "der hund", 7: "im haus", 8: ""}
    bucket = lambda a, b, c: (((a * 0x1F123BB5 + b * 0x9E3779B1 + c * 0x85EBCA6B) & 0xFFFFFFFF) * 0x9E3779B97F4A7C15 % 2**64) >> 50
    grams = lambda t: Counter(bucket(*map(ord, t[i : i + 3])) for i in range(len(t) - 2))
    langs = ["de", "en", "fr"]
    counts = {x: np.full(languages.BUCKETS, 0.5) for x in langs}
    for text, lang in docs:
        g = grams(text)
        for k, n in g.items():
            counts[lang][k] += n / sum(g.values()) ** 0.5
    shown = spark.createDataFrame([(w,) for w in words.values()], "w string").select(languages.letters_of(F.col("w"))).collect()
    assert [r[0] for r in shown] == list(words.values())
    text_of = {}
    for i in words:
        # what stands before the words of a page are tags, each one space
        letters = " " * {1: 2, 2: 1, 4: 1, 7: 1}.get(i, 0) + words[i]
        g = grams(" ".join(["", letters.strip()]) if letters.startswith(" ") else letters)
        text_of[i] = [sum(n * math.log(counts[x][k] / counts[x].sum()) for k, n in g.items()) / max(sum(g.values()), 1) ** 0.5 for x in langs]
    normal = lambda logs: [math.exp(x - max(logs)) / sum(math.exp(y - max(logs)) for y in logs) for x in logs]
    rows = [p[0] for p in pages]
    p = {i: normal(text_of[i]) for i in rows}
    by = [{v: [sum(p[i][x] for i in rows if facts[i][at] == v) for x in range(3)] for v in {f[at] for f in facts.values()}} for at in range(5)]
    total = [sum(p[i][x] for i in rows) + 0.5 for x in range(3)]
    want = {}
    for i in set(rows):
        logs = []
        for x in range(3):
            prior = total[x] / sum(total)
            for at in (2, 1, 0):
                n = by[at][facts[i][at]]
                prior = (max(n[x] - p[i][x], 0) + 2 * prior) / (sum(n) - 1 + 2)
            told = [math.log((max(by[at][facts[i][at]][x] - p[i][x], 0) + 0.5) / total[x]) for at in (3, 4)]
            logs.append(text_of[i][x] + math.log(prior) + sum(told))
        q = normal(logs)
        want[i] = (langs[q.index(max(q))], max(q), None if not any(text_of[i]) else langs[text_of[i].index(max(text_of[i]))], *facts[i][3:])
    got = languages.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(docs, "text string, lang string")).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.lang, r.text_lang, r.declared, r.hint) == (want[r.page_id][0], *want[r.page_id][2:]) and abs(r.confidence - want[r.page_id][1]) < 1e-5
    # hosts of one domain pool: the empty page of b.one.co.uk leans on its neighbours
    assert want[3][2] is None


def test_languages_of_held_out_documents(spark):
    d = queries.table(spark, SF, "documents").where("length(text) > 200").withColumn("part", F.pmod(F.xxhash64("text"), F.lit(2)))
    pages = d.where("part = 0").select(F.col("doc_id").alias("page_id"), F.lit("http://a.org/").alias("url"), F.col("text").alias("html"))
    got = languages.identify(pages, d.where("part = 1")).join(d.where("part = 0").select(F.col("doc_id").alias("page_id"), F.col("lang").alias("want")), "page_id").where("want IS NOT NULL").toPandas()
    assert len(got) > 30 and (got.text_lang == got.want).mean() > 0.95


def test_registered_domains_and_hosts(spark):
    given = [("http://a.b.co.uk/x", "b.co.uk"), ("https://u:p@WWW.Shop.ORG.:80/", "shop.org"), ("http://co.uk/", None), ("http://1.2.3.4:8/", "1.2.3.4"), ("http://[2001:db8::1]:80/", "[2001:db8::1]"), ("http://localhost/", None), ("http://" + "a." * 200 + "com/", None), (None, None)]
    host = url_lists.host_of(F.col("u"))
    got = spark.createDataFrame(given, "u string, want string").select("want", url_lists.registered_domain(host).alias("got"), url_lists.keys_of(F.col("u")).alias("keys")).collect()
    assert all(r.want == r.got for r in got)
    assert got[0]["keys"] == ["a.b.co.uk/x", "a.b.co.uk", "b.co.uk", "co.uk"] and got[3]["keys"] == ["1.2.3.4"] and got[4]["keys"] == ["[2001:db8::1]"] and got[6]["keys"] is None
    caps = spark.createDataFrame([("http://a.com/", "h", "2024-01-01")], "url string, host string, fetched_at string")
    assert url_lists.filter_urls(caps, spark.createDataFrame([], "list string, verdict string, key string, action string, dated string"), keep=("host",)).columns == ["host", "n_active", "decided_by", "blocked"]


def test_rare_languages_are_kept_and_copies_do_not_fill_the_sample(spark):
    rows = [(f"the plain words number {i} of this", "en") for i in range(1500)] + [("always the same words", "en")] * 1500 + [(f"mots rares {i}", "fr") for i in range(3)] + [("1 2 3", "xx"), (None, "yy"), ("x", None)]
    langs, table = languages.fit_text_model(spark.createDataFrame(rows, "text string, lang string"), train_rows=50, least_rows=5)
    assert langs == ["en", "fr", "xx"] and table.shape == (3, languages.BUCKETS)
    seen = languages.trigram_counts("always")
    assert table[1, languages.trigram_counts("mots rares ").nonzero()[0]].min() > table[1].min() == table[1, seen.nonzero()[0]].min()
    pages = spark.createDataFrame([(1, "http://a.org/", "<html lang='fr'>mots rares mots rares mots rares</html>")], "page_id long, url string, html string")
    assert languages.identify(pages, spark.createDataFrame(rows, "text string, lang string"), train_rows=50).first().lang == "fr"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    names = sorted(want.columns)
    assert sorted(map(repr, map(tuple, queries.QUERIES[name](spark, SF).select(*names).collect()))) == sorted(map(repr, want.select(*names).fetchall()))


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_duplicates", "mixing", "packing"]
    docs = queries.table(spark, SF, "documents")
    given = before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), name)
        after = {r.doc_id for r in docs.collect()}
        assert docs.columns == list(corpus_pipeline.COLUMNS) and after <= before and docs.count() == len(after)
        before = after
    assert before < given
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.collect()} == before
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
