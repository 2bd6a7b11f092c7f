import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.llm import pitman_yor
from assaykit.llm.queries import op3_pitman_yor


def brute(docs):
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in docs.items()}
    train = [i for i in docs if zlib.crc32(str(i).encode()) % 10]
    count = Counter(w for i in train for w in tokens[i])
    n, v = sum(count.values()), len(count)
    return {i: (i not in set(train), len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in tokens.items()}


def test_query_counts_and_held_out_gain(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in op3_pitman_yor(spark, sf).collect()}
    want = brute(docs)
    assert len(rows) == len(docs)
    for i, r in rows.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[i][:4]
        assert r.base_score == pytest.approx(want[i][4], rel=1e-9)
    held = [r for r in rows.values() if r.held_out]
    tokens = sum(r.n_tokens for r in held)
    base, own = sum(r.base_score for r in held) / tokens, sum(r.score for r in held) / tokens
    better = sum(r.score > r.base_score for r in held) / len(held)
    print("held-out log10 per token", base, own, "better", better)
    assert own > base


def test_probabilities_sum_to_one(spark):
    train = [(n, f"a b{n % 3} c d{n % 5} a") for n in range(40)]
    vocabulary = ["a", "c", "never", *[f"b{n}" for n in range(3)], *[f"d{n}" for n in range(5)]]
    asked = [(100 + n, f"a {w}") for n, w in enumerate(vocabulary)] + [(99, "a")]
    df = spark.createDataFrame(train + asked, "doc_id long, text string").repartition(3)
    s = pitman_yor.Settings(hot_share=0.2)
    # p(w | a) = p(a w end) / (p(a) p(end | w)); the sum over all words and the end is one for each context, so compare
    # the same context's words against the end through texts of one word more
    rows = {r.doc_id: r for r in pitman_yor.perplexity_scores(df, F.col("doc_id") < 99, settings=s).collect()}
    asked_alone = spark.createDataFrame(train + [(200 + n, w) for n, w in enumerate(vocabulary)] + [(300, "")], "doc_id long, text string")
    alone = {r.doc_id: r.score for r in pitman_yor.perplexity_scores(asked_alone, F.col("doc_id") < 99, settings=s).collect()}
    assert all(r.score <= 0 for r in rows.values())
    # p(w after begin) <= p(text w); summing p(w end) + p(end) over all words stays below one
    assert sum(10 ** alone[200 + n] for n in range(len(vocabulary))) + 10 ** alone[300] <= 1.0


def test_seating_matches_one_by_one():
    rng = np.random.default_rng(3)
    for c, prior, others in ((5, 0.1, 50), (300, 0.05, 10), (2000, 0.001, 900)):
        slow = []
        for _ in range(400):
            t = 1
            for i in range(1, c):
                new = (2.0 + 0.5 * (others + t)) * prior
                t += rng.random() * (new + i - 0.5 * t) < new
            slow.append(t)
        n = 4000
        fast = pitman_yor.seat(np.full(n, c), np.full(n, prior), np.full(n, others), 0.5, 2.0, rng)
        assert abs(fast.mean() - np.mean(slow)) < 4 * np.std(slow) / 20 + 0.05 * np.mean(slow)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "x X x", 1), (3, "x X x", 1), (None, "x y", 1), (7, "z " * 5000, 1)], "doc_id long, text string, score int")
    rows = pitman_yor.perplexity_scores(df, F.col("doc_id") < 4).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known) for r in rows) == [(0, 3, 2), (1, 1, 1), (2, 1, 1), (3, 4, 4), (3, 4, 4), (7, 5001, 1)]
    none = pitman_yor.perplexity_scores(df, F.lit(False)).collect()
    assert {r.train_tokens for r in none} == {0} and all(abs(r.score) < 1e-9 for r in none)
    assert pitman_yor.perplexity_scores(df.limit(0), F.lit(True)).count() == 0


def test_each_preceding_word_has_its_restaurant(spark):
    # two words that fall in one of 16,384 classes by hash, yet are followed by different words
    seen = {}
    for n in range(10_000):
        c = (((pitman_yor._HASHES[b"w%d" % n] * int(pitman_yor._MIX)) % (1 << 64)) >> 40) % (1 << 14)
        if c in seen:
            break
        seen[c] = n
    x, y = f"w{seen[c]}", f"w{n}"
    train = [(i, f"{x} a" if i % 2 else f"{y} b") for i in range(200)]
    df = spark.createDataFrame([*train, (900, f"{x} a"), (901, f"{x} b"), (902, f"{y} b")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in pitman_yor.perplexity_scores(df, F.col("doc_id") < 900).collect()}
    assert got[900] > got[901] + 0.3 and got[902] > got[901] + 0.3


def test_hot_words_of_later_documents(spark):
    docs = [("a" + " ".join(f"{n} {n}b{i}" for i in range(8)),) for n in range(2_000)] + [("late " * 40,)] * 500
    rows = spark.createDataFrame(spark.sparkContext.parallelize(docs, 1), "__text string")
    hot = pitman_yor._hot_words(rows, pitman_yor.Settings(hot_share=0.1))
    assert hot == sorted({pitman_yor._HASHES[b"late"], pitman_yor.END})


def test_results_do_not_depend_on_buckets_or_chunks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = []
    for bucket_tokens, chunk_tokens in ((10**9, 10**9), (9_000, 40_000)):
        s = pitman_yor.Settings(bucket_tokens=bucket_tokens, chunk_tokens=chunk_tokens)
        found.append({r.doc_id: (r.score, r.base_score) for r in pitman_yor.perplexity_scores(docs, F.crc32(F.col("doc_id").cast("string")) % 10 != 0, settings=s).collect()})
    assert found[0] == found[1]


def test_predictions_by_hand(spark):
    """With every type and word seen once, no seating is left to chance."""
    df = spark.createDataFrame([(1, "a b c"), (2, "a x")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in pitman_yor.perplexity_scores(df, F.col("doc_id") == 1).collect()}
    rest = (10 + 0.6 * 4) / 5
    known, unknown = (1 - 0.6 + rest) / 14, rest / 14
    seen = lambda p: (1 - 0.75 + 20.75 * p) / 21
    assert got[1] == pytest.approx(4 * math.log10(seen(known)), rel=1e-6)
    assert got[2] == pytest.approx(math.log10(seen(known)) + math.log10(20.75 * unknown / 21) + math.log10(known), rel=1e-6)


def exact_tables(c, prior, others, d, strength):
    """Probabilities of 1 to c tables of a dish given the rest of its restaurant."""
    s = {(1, 1): 1.0}
    for n in range(2, c + 1):
        for t in range(1, n + 1):
            s[n, t] = s.get((n - 1, t - 1), 0.0) + (n - 1 - d * t) * s.get((n - 1, t), 0.0)
    w = [s[c, t] * math.prod((strength + d * (others + j)) * prior for j in range(t)) for t in range(1, c + 1)]
    return np.array(w) / sum(w)


def test_reseating_keeps_the_exact_distribution():
    n, d, strength = 20_000, 0.75, 20.0
    for c, prior, others in ((2, 0.05, 3), (5, 0.2, 0), (9, 0.01, 40)):
        place, tables = np.arange(n), np.ones(n, np.int64)
        totals = np.full(n, others + 1)
        for turn in range(12):
            draws = pitman_yor.Draws(np.arange(n).astype(np.uint64), 5, turn)
            pitman_yor.reseat(np.full(n, c), tables, np.full(n, prior), place, totals, np.zeros(n, bool), d, strength, 4, draws)
        assert (totals == others + tables).all()
        found = np.bincount(tables, minlength=c + 1)[1:] / n
        assert np.abs(found - exact_tables(c, prior, others, d, strength)).max() < 0.015, (c, found)


def test_alone_goes_on_past_the_table():
    for d in (0.75, 0.6):
        big = pitman_yor.alone(np.array([6000, 6000, 6000]), np.array([1, 600, 3000]), d)
        assert big[0] == 0 and abs(big[1] / (d * 0.1) - 1) < 0.05 and 0.3 < big[2] < 0.4


def test_binomial_moments():
    u = (np.arange(100_000) + 0.5) / 100_000
    for n, p in ((3, 0.3), (40, 0.05), (5000, 0.2)):
        x = pitman_yor._binomial(np.full(len(u), n), np.full(len(u), p), u)
        assert abs(x.mean() - n * p) < 0.02 * n * p + 0.05 and abs(x.std() - math.sqrt(n * p * (1 - p))) < 0.1 * math.sqrt(n * p * (1 - p)) + 0.05
        assert x.min() >= 0 and x.max() <= n
