import re

import public_tokenizers
from test_jaccard_join import brute as groups_of
from test_packing import brute as pieces_of
from test_packing import placed_well

import corpus_pipeline

SPACE = " \t\n\x0b\f\r"


def lowered(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def words(s):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(s or ""))


def without_common_lines(docs):
    keys = {i: [lowered(x.strip(SPACE)) for x in t.split("\n")] for i, t in docs.items()}
    holders = {}
    for i, ks in keys.items():
        for k in ks:
            if len(k) >= 20:
                holders.setdefault(k, set()).add(i)
    gone = lambda i, k: len(holders.get(k, ())) >= 3 and i != max(holders[k])
    return {i: "\n".join(x for x, k in zip(t.split("\n"), keys[i], strict=True) if not gone(i, k)) for i, t in docs.items()}


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.dtypes
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf), "test")
        after[name] = docs.collect()
        if name != "packing":
            assert docs.dtypes == columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id: r.text for r in after["quality"]}
    assert sum(i in kept for i, q in labels.items() if q == 1) >= 0.98 * sum(q == 1 for q in labels.values())
    assert sum(i in kept for i, q in labels.items() if q == 0) <= 0.2 * sum(q == 0 for q in labels.values())

    lines = {r.doc_id: r.text for r in after["line_dedup"]}
    assert lines == without_common_lines(kept)
    assert all(r.n_chars == len(r.text) for r in after["line_dedup"])

    ids = sorted(lines)
    found = groups_of([lines[i] for i in ids], 5, 80)
    one = {i: lines[i] for n, i in enumerate(ids) if found[n][1] == n}
    assert {r.doc_id: r.text for r in after["near_duplicates"]} == one

    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    clean = {}
    for i, t in one.items():
        w = words(t)
        if not any(tuple(w[p : p + 10]) in windows for p in range(len(w) - 9)):
            clean[i] = t
    assert len(clean) < len(one)
    assert {r.doc_id: r.text for r in after["decontamination"]} == clean

    ids = sorted(clean)
    want = [(ids[n], *rest) for n, *rest in pieces_of([clean[i] for i in ids])]
    packed = after["packing"]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    assert placed_well(packed) <= -(-sum(r.length for r in packed) // 4096) + 2
    assert public_tokenizers


def test_repeated_rows_and_null_ids_leave_one(spark):
    first, second, third = (" ".join(f"{c}{n}" for n in range(40)) for c in "abc")
    rows = [(7, first)] * 4 + [(9, first)] + [(None, second)] * 3 + [(None, second + " more")] * 2 + [(5, third), (None, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = [(r.doc_id, (r.text or "")[:1]) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()]
    assert sorted(left, key=str) == [(5, "c"), (7, "a"), (None, ""), (None, ""), (None, "b")]
