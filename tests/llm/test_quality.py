from assaykit.llm import quality
from assaykit.llm.queries import op10_quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op10_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == 1000
    held = [(labels[i], r) for i, r in rows.items() if r.held_out and i in labels]
    right = sum(r.predicted == y for y, r in held)
    print(len(held), right, sorted((y, round(r.score, 2)) for y, r in held if r.predicted != y))
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert right >= 0.9 * len(held)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, None, 0.5), (2, "", 0.1), (2, "good words here", 0.2), (None, "x " * 20000, 0.3)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    one = spark.createDataFrame([(1, 1), (2, 1), (9, None), (3, 7)], "doc_id long, quality int")
    both = spark.createDataFrame([(1, 0), (2, 1), (2, 1)], "doc_id long, quality int")
    unknown = spark.createDataFrame([(77, 0), (78, 1)], "doc_id long, quality int")
    for labels in (none, one, both, unknown):
        rows = quality.score(df, quality.fit(df, labels)).collect()
        assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.score(df, quality.fit(df, none)).collect()} == {0.5}
    assert quality.score(df.limit(0), quality.fit(df, both)).count() == 0


def plain_grams(text):
    """N-grams as tuples, by the module's description alone."""
    words = (text or "").split()

    def shape(i):
        s = words[i]
        letters = [c for c in s if c.isalpha()]
        case = "none" if not letters else "low" if s.islower() else "up" if s.isupper() and len(letters) > 1 else "title" if s[0].isupper() and s[1:].islower() or len(s) == 1 else "mixed"
        end = "word" if s[-1].isalnum() else "stop" if s[-1] in ".?" else "pause" if s[-1] in ",;:" else "!" if s[-1] == "!" else "double" if len(s) > 1 and s[-2] == s[-1] else "other"
        return case, end, min(3, len(s) // 4), i > 0 and words[i - 1].lower() == s.lower() and shape_only(i - 1) == shape_only(i)

    def shape_only(i):
        s = words[i]
        return s.islower(), s.isupper(), s[-1], len(s) // 4

    shapes = [shape(i) for i in range(len(words))]
    low = [w.lower() for w in words]
    return {("s", *shapes[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)} | {("w", *low[i : i + n]) for n in (1, 2) for i in range(len(words) - n + 1)}


def test_against_brute_force(spark):
    import math
    import random
    from collections import Counter

    import xxhash

    rng = random.Random(4)
    good, bad = ["clear", "useful", "River.", "Old", "stone,", "why?"], ["BUY", "now!!", "cheap", "click", "stone,", "xx"]
    docs, marks = [], {}
    for i in range(60):
        marks[i] = i % 2
        pool = good + bad[3:] if i % 2 else bad + good[3:]
        docs.append((i, " ".join(rng.choice(pool) for _ in range(rng.randint(3, 14)))))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame(list(marks.items()), "doc_id long, quality int")
    epochs = 300
    model = quality.fit(df, labels, max_rows=1000, min_rows=2, epochs=epochs)

    sets = {i: plain_grams(t) for i, t in docs}
    often = Counter(g for s in sets.values() for g in s)
    known = sorted((g for g, n in often.items() if n >= 2), key=repr)
    assert len(model.keys) == len(known)
    count = {y: {g: 1 + sum(g in sets[i] for i in sets if marks[i] == y) for g in known} for y in (0, 1)}
    total = {y: sum(count[y].values()) for y in (0, 1)}
    ratio = {g: math.log(count[1][g] / total[1] / (count[0][g] / total[0])) for g in known}
    assert sorted(round(float(x), 4) for x in model.scale) == sorted(round(x, 4) for x in ratio.values())
    x = {i: {g: ratio[g] for g in s if g in ratio} for i, s in sets.items()}
    x = {i: {g: v / math.sqrt(sum(u * u for u in f.values())) for g, v in f.items()} for i, f in x.items()}
    order = sorted(sets, key=lambda i: xxhash.xxh64_intdigest(str(i)))
    used = [i for n, i in enumerate(order) if n % 5]
    y = {i: 1 if marks[i] else -1 for i in used}
    upper = {i: len(used) / (2 * sum(y[j] == y[i] for j in used)) for i in used}
    w, bias, alpha = Counter(), 0.0, dict.fromkeys(used, 0.0)
    for _ in range(epochs):
        for i in used:
            q = sum(v * v for v in x[i].values()) + 1
            new = min(max(alpha[i] - (y[i] * (sum(w[g] * v for g, v in x[i].items()) + bias) - 1) / q, 0), upper[i])
            step, alpha[i] = (new - alpha[i]) * y[i], new
            for g, v in x[i].items():
                w[g] += step * v
            bias += step
    numbers = quality.Vocabulary(model.keys)
    for i, t in docs:
        want = sum(w[g] * v for g, v in x[i].items()) + bias
        assert abs(model.margin(numbers(quality.grams(t.encode()))) - want) < 0.01, (i, t)
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert all(abs(got[i] - 1 / (1 + math.exp(-(model.a * model.margin(numbers(quality.grams(t.encode()))) + model.b)))) < 1e-9 for i, t in docs)


def test_long_texts_do_not_run_full(spark):
    texts = [(i, ("fine words here . " if i % 2 else "BAD !! junk $$ ") * 5) for i in range(40)]
    long = [(100, "fine words here . " * 3 + " ".join(f"u{n}" for n in range(200_000))), (101, "BAD !! junk $$ " * 3 + " ".join(f"v{n}" for n in range(200_000)))]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, quality int")
    df = spark.createDataFrame(texts + long, "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(df, quality.fit(df, labels)).collect()}
    assert got[100] > 0.5 > got[101]
