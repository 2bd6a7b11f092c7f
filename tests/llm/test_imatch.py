import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from assaykit.llm import imatch
from assaykit.llm.queries import op8_imatch


def test_query(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    rows = {r.doc_id: r for r in op8_imatch(spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    by_text = {}
    for n, (i, text) in enumerate(docs):
        after = docs[(n + 1) % len(docs)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert rows[i].n_chars == len(text)
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        by_text.setdefault(text, set()).add(rows[i].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())
    wins = sum(r.near_edited > r.near_next for r in rows.values())
    losses = sum(r.near_edited < r.near_next for r in rows.values())
    assert wins > 0.7 * len(rows) and losses < 0.05 * len(rows), (wins, losses)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (2, "one two three", "z"), (2, "one two three", "z"), (None, "alone", "w")], "doc_id long, text string, h string")
    lex = imatch.lexicon(df, "text", least_share=0, most_share=1)
    rows = imatch.fingerprints(imatch.half_replaced(df), {"text": "f", "edited": "g"}, lex).collect()
    assert len(rows) == 3  # whole repeats, and null beside empty, count once
    assert imatch.fingerprints(imatch.half_replaced(df.limit(0)), {"text": "f", "edited": "g"}, lex).count() == 0


def test_likeness_by_brute_force(spark):
    rng = random.Random(3)
    n, sub, none = imatch.RATES * imatch.SUBSETS, imatch.SUBSETS, imatch.EMPTY

    def brute(a, b):
        if a is None or b is None or all(x == none for x in a + b):
            return 0.0
        if a == b:
            return 1.0
        rates = []
        for r in range(imatch.RATES):
            pairs = [(x, y) for x, y in zip(a[r * sub : r * sub + sub], b[r * sub : r * sub + sub], strict=True) if (x, y) != (none, none)]
            rates.append((sum(x == y for x, y in pairs), len(pairs)))
        counted = [x for x in rates if x[1] <= imatch.TOLD_APART]
        counted = counted if any(m for _, m in counted) else rates[-1:]
        equal, used = map(sum, zip(*counted, strict=True))
        return equal / used if used else 0.0

    empty = [none] * n
    rows = [(empty, empty), (empty, None), ([1] * n, [1] * n), ([1] * n, [2] * n), (empty, [5, *empty[1:]])]
    for _ in range(60):
        a = [rng.choice([none, none, none, 1, 2, 3]) if rng.random() < 0.8 else 7 for _ in range(n)]
        rows.append((a, [x if rng.random() < 0.7 else rng.choice([none, 1, 9]) for x in a]))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, x array<smallint>, y array<smallint>")
    got = {r.i: r.v for r in df.select("i", imatch.likeness(F.col("x"), F.col("y")).alias("v")).collect()}
    assert got == {i: pytest.approx(brute(a, b)) for i, (a, b) in enumerate(rows)}


def test_fingerprints_by_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", "Zeta", *(" ".join(rng.choice(["Alpha", "beta,", "g4mma", "délta", "the"]) + str(rng.randrange(60)) for _ in range(rng.choice([3, 40, 900]))) for _ in range(12))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lex = imatch.lexicon(df, "text", least_share=0.2, most_share=0.6)
    bits, size = imatch.lexicon_bits(lex)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    hashed = lambda w: xxhash.xxh64_intdigest(w.encode(), 42)
    of = lambda t: {hashed(w.lower()) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())}
    df_of = Counter(h for t in texts for h in of(t))
    assert {r.h for r in lex.collect()} == {signed(h) for h, n in df_of.items() if max(2, 0.2 * len(texts)) <= n <= max(2, 0.6 * len(texts))}
    slots = {(r.h % (1 << 64)) >> (64 - size) for r in lex.collect()}

    def brute(t):
        out = []
        known = [h for h in of(t) if h >> (64 - size) in slots]
        for rate in range(imatch.RATES):
            for subset in range(imatch.SUBSETS):
                mine = sorted((h % 32) << 58 | h >> 6 for h in known if h % 32 == subset and (h >> 6) % 4**rate == 0)
                seed = 42
                for x in mine:
                    seed = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed)
                out.append(signed(seed) % 65535 - 32767 if mine else imatch.EMPTY)
        return out

    got = {r.doc_id: r.f for r in df.select("doc_id", imatch.fingerprint(F.col("text"), bits, size).alias("f")).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    assert sum(x != imatch.EMPTY for x in got[len(texts) - 1]) > 5


def test_half_edited_texts_stay_near(spark):
    rows = op8_imatch(spark, "/root/testdata/sf0.01").collect()
    assert sum(r.near_edited > 0 for r in rows) >= 0.95 * len(rows)
    assert sum(r.near_edited for r in rows) > 20 * sum(r.near_next for r in rows)


def test_repeated_rows_and_texts_without_terms(spark, tmp_path):
    shown = [(1, "the same old words again"), (1, "the same old words again"), (2, "the same old words again"), (3, None), (4, "unheard"), (4, "unheard"), (None, "")]
    spark.createDataFrame(shown, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = op8_imatch(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id or 0 for r in rows) == [0, 1, 1, 2, 3, 4, 4]
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 2)}) == 1
    assert all(r.near_edited == 0 for r in rows if r.doc_id in (3, None))
