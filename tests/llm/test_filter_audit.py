"""The audit against every order applied to every document in turn."""

import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from assaykit.llm import filter_audit
from assaykit.llm.queries import op12_filter_audit


def test_intervals_are_the_orders_that_begin_so():
    for n in (1, 2, 3, 5):
        orders = list(permutations(range(n)))
        for length in range(n + 1):
            for beginning in permutations(range(n), length):
                first, end = filter_audit.interval(beginning, n)
                assert [i for i, o in enumerate(orders) if o[:length] == beginning] == list(range(first, end))


def plain(rows, flags, checks, letters):
    """rows: (id, text, part); every order, document by document."""
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    docs = []
    for i, text, part in rows:
        text = text or ""
        failed = [c(text) for c in checks] + [i is not None and i > first.get(text, i)]
        docs.append((part or "", failed, flags.get(i, (False, False))))
    out = {}
    shapley = Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in permutations(range(len(letters))):
            left, name = own, "".join(letters[f] for f in order)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                shapley[part, f] += len(gone)
                all_failing = sum(d[1][f] for d in own)
                out[part, name, step] = [len(left), len(gone), all_failing - len(gone), sum(d[1][f] and sum(d[1]) == 1 for d in own), sum(d[2][0] for d in gone), sum(d[2][1] for d in gone)]
    return {k: [*v, shapley[k[0], letters.index(k[1][k[2] - 1])]] for k, v in out.items()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


CHECKS = [
    lambda t: len(words(t)) < 50,
    lambda t: 100 * len(set(words(t))) < 65 * len(words(t)),
    lambda t: 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
    lambda t: bool(re.search("[#$%&*|]", t)),
]


def as_dict(rows):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}


def test_query_equals_plain_orders(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    flags = {r.doc_id: (r.quality == 1, r.toxic == 1) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = op12_filter_audit(spark, sf_dir).collect()
    got = as_dict(rows)
    assert len(rows) == len(got) and got == plain(docs, flags, CHECKS, "ABCDE")


def test_odd_rows(spark):
    fine = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, None, None), (1, "", ""), (2, "", "a"), (3, fine, "a"), (3, fine, "a"), (4, fine, "b"), (None, fine, "b"), (None, "X" * 500_000, "b"),
        (5, "é" * 99 + "ABCDE", "b"), (6, "word " * 200_000, "a"), (7, fine + " #", "c"), (-1, fine, "d"),
    ]
    docs = spark.createDataFrame([(*r, 1, True) for r in rows], "doc_id long, text string, source string, mask int, good boolean")
    marks = [(1, True, False), (1, False, None), (3, True, True), (4, None, True), (99, True, True), (None, True, True)]
    flags = spark.createDataFrame(marks, "doc_id long, good boolean, toxic boolean")
    known = {1: (True, False), 3: (True, True), 4: (False, True)}
    want = plain(rows, known, CHECKS, "ABCDE")
    checks = filter_audit.text_checks(F.col("text"))
    for flag_rows in (0, 1_000_000):
        counts = filter_audit.masks(docs, checks, flags, flag_rows=flag_rows)
        assert as_dict(filter_audit.audit(counts, "ABCDE", ["good", "toxic"]).collect()) == want
    assert filter_audit.audit(filter_audit.masks(docs.limit(0), checks, flags), "ABCDE", ["good", "toxic"]).count() == 0
    two = filter_audit.masks(docs, {"A": checks["A"]}, flags.limit(0))
    got = as_dict(filter_audit.audit(two, "AE", ["good", "toxic"]).collect())
    assert got == plain(rows, {}, CHECKS[:1], "AE")
    with pytest.raises(ValueError, match="filters"):
        filter_audit.audit(counts, "ABCDEFG", [])
