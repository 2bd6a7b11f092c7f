import random
from collections import Counter

from assaykit.llm import substring_dedup


def brute(texts, span):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + span]) for w in words for i in range(len(w) - span + 1))
    out = []
    for w in words:
        gone = {p for i in range(len(w) - span + 1) if seen[tuple(w[i : i + span])] > 1 for p in range(i, i + span)}
        out.append((len(w), len(gone), b" ".join(x for n, x in enumerate(w) if n not in gone).decode()))
    return out


def check(spark, texts, span, k):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.dedup_substrings(df, span=span, k=k).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, span)


def test_against_brute_force(spark):
    rng = random.Random(1)
    texts = []
    for vocab in (2, 3, 8, 500):
        names = [f"w{vocab}_{i}" for i in range(vocab)]
        passages = [[rng.choice(names) for _ in range(rng.randint(5, 60))] for _ in range(6)]
        for _ in range(40):
            w = []
            for _ in range(rng.randint(0, 5)):
                w += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(names) for _ in range(rng.randint(0, 30))]
            texts.append(" ".join(w))
    check(spark, texts, 12, 4)


def test_odd_texts(spark):
    copy = " ".join(f"x{i}" for i in range(80))
    check(spark, [None, "", "a " * 34, "b " * 35, "c " * 36, copy, copy, "pre\x0b" + copy.replace(" ", "\n\t"), "é " * 40, copy[:-3], "z " + copy + " z"], 35, 8)


def test_clashing_names_repeats_and_empty(spark):
    copy = " ".join(f"x{i}" for i in range(40))
    df = spark.createDataFrame([(None, copy, "p"), (1, copy, "q"), (1, copy, "q"), (1, "short", "r")], "doc_id long, text string, n_words string")
    rows = sorted((r.n_words, r.n_removed, r.text) for r in substring_dedup.dedup_substrings(df).collect())
    assert rows == [(1, 0, "short"), (40, 40, ""), (40, 40, ""), (40, 40, "")]
    assert substring_dedup.dedup_substrings(df.limit(0)).count() == 0
