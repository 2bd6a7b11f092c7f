import random

import numpy as np

from assaykit.llm import jaccard_join as jj


def brute(texts, n, percent):
    def shingles(t):
        low = (t or "").encode().lower().split()
        return {tuple(low[i : i + n]) for i in range(len(low) - n + 1)} if len(low) >= n else {tuple(low)} if low else set()

    sets = [shingles(t) for t in texts]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j]:
                both = len(s & sets[j])
                if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                    a, b = sorted((root(i), root(j)))
                    up[b] = a
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def made(seed):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(400)]
    texts = [None, "", " \t", "one", "One", "one two", "ONE two", "one two three", "Ünï ünï"]
    for _ in range(14):
        base = [rng.choice(words) for _ in range(rng.choice([8, 12, 20, 60, 150, 400]))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 14)):
            w = list(rng.choice([base, base, texts[-1].split()]))
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w[: len(w) - rng.randint(0, 2)]))
    return texts


def run(spark, texts, n, percent):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["__id"]: (r.n_shingles, r.component) for r in jj.near_duplicates(df, n=n, percent=percent).collect()}
    return [got[i] for i in range(len(texts))]


def test_against_brute_force(spark):
    for seed, n, percent in ((1, 3, 90), (2, 5, 80)):
        texts = made(seed)
        want = brute(texts, n, percent)
        assert len({c for _, c in want}) < len(texts) - 20
        assert run(spark, texts, n, percent) == want


def test_widened_segments_find_all(spark, monkeypatch):
    def half(costs, bands, sets_in):
        given, wide = set(), set()
        for g in sets_in:
            codes = [bands.code(g) + i for i in range(bands.segments(g))]
            given |= set(codes[: len(codes) // 2])
            wide |= set(codes[len(codes) - len(codes) // 2 :])
        return frozenset(given), frozenset(wide)

    monkeypatch.setattr(jj, "allocate", half)
    texts = made(3)
    assert run(spark, texts, 3, 90) == brute(texts, 3, 90)


def test_allocation_trades_dear_for_cheap_segments():
    bands = jj.Bands(90)
    g = bands.band(100)
    codes = [bands.code(g) + i for i in range(bands.segments(g))]
    given, wide = jj.allocate({codes[2]: 10**9, codes[0]: 5}, bands, {g: 50})
    assert given == {codes[2]} and len(wide) == 1 and codes[2] not in wide
    assert jj.allocate({c: 100 for c in codes}, bands, {g: 50}) == (frozenset(), frozenset())


def test_pigeonhole_on_random_sets():
    rng = np.random.default_rng(5)
    for percent in (80, 90):
        bands = jj.Bands(percent)
        for _ in range(300):
            s = np.unique(rng.integers(0, 2**63, rng.integers(9, 300)).astype(np.uint64))
            t = s.copy()
            for _ in range(rng.integers(0, max(2, len(s) * (100 - percent) // 100))):
                t = np.unique(np.concatenate([np.delete(t, rng.integers(len(t))), rng.integers(0, 2**63, rng.integers(0, 2)).astype(np.uint64)]))
            both = len(np.intersect1d(s, t))
            if len(t) and 100 * both >= percent * (len(s) + len(t) - both) and both < max(len(s), len(t)):
                assert len(np.intersect1d(jj.signatures(s, bands), jj.signatures(t, bands)))


def test_clashing_names_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d", 1), (5, "a b c d", 2), (5, "a b c d", 2)], "doc_id long, text string, node int")
    rows = jj.near_duplicates(df).collect()
    assert [r.component for r in rows] == [5, 5, 5]
    assert jj.near_duplicates(df.limit(0)).count() == 0


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for percent in (80, 90):
        bands = jj.Bands(percent)
        for _ in range(400):
            size = int(rng.integers(10, 400))
            both = rng.integers(0, 2**63, size, dtype=np.uint64)
            other = int(rng.integers(0, size * (100 - percent) // percent + 1))
            mine = int(rng.integers(0, other + 1))
            extra = rng.integers(0, 2**63, other, dtype=np.uint64)
            u, v = np.unique(np.concatenate([both, extra[:mine]])), np.unique(np.concatenate([both, extra[mine:]]))
            assert 100 * size >= percent * (size + other)
            if size + other > size:
                assert np.intersect1d(jj.signatures(u, bands), jj.signatures(v, bands)).size


def test_links_and_counts_against_brute_force(spark):
    def sets_of(texts, n):
        out = []
        for t in texts:
            low = (t or "").encode().lower().split()
            out.append({tuple(low[i : i + n]) for i in range(len(low) - n + 1)} if len(low) >= n else {tuple(low)} if low else set())
        return out

    for seed, n, percent in ((1, 3, 90), (2, 5, 80)):
        texts = made(seed)
        texts += [texts[20], texts[30], texts[30]]
        sets = sets_of(texts, n)
        linked = [{j for j, t in enumerate(sets) if i != j and s and t and 100 * len(s & t) >= percent * len(s | t)} for i, s in enumerate(sets)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        got = {r["__id"]: (r.n_shingles, r.component, r.n_links) for r in jj.link_counts(df, n=n, percent=percent).collect()}
        assert [got[i] for i in range(len(texts))] == [(*w, len(m)) for w, m in zip(brute(texts, n, percent), linked, strict=True)]
        x = jj.indexed(df, "doc_id", "text", n, percent, 1000)
        of = {r["__id"]: r.node for r in x.rows.collect()}
        pairs = {(r.a, r.b): (r.common, r.either) for r in jj.links(x, n=n, percent=percent).collect()}
        want = {tuple(sorted((of[i], of[j]))): (len(sets[i] & sets[j]), len(sets[i] | sets[j])) for i, m in enumerate(linked) for j in m if of[i] != of[j]}
        assert pairs == want
    assert jj.link_counts(df.limit(0)).count() == 0
