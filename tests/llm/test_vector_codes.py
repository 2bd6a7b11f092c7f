"""Exact products, and the whole rounds against plain whole numbers."""

import hashlib
import math
import random
import struct

import numpy as np
import pytest

from assaykit.llm import vector_codes
from assaykit.llm.queries import op13_vector_codes


@pytest.mark.parametrize("bits", [3, 10, 24, 25, 27])
def test_limb_products_are_exact(bits):
    rng = np.random.default_rng(bits)
    for terms in (1, 2, 16, 17):
        a, b = (rng.integers(-(1 << bits), (1 << bits) + 1, (n, terms)) for n in (9, 7))
        a[0], b[0], b[1] = 1 << bits, 1 << bits, -(1 << bits)
        want = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b] for r in a]
        assert vector_codes.exact_dots(a, b).tolist() == want
        at, d = vector_codes.nearest(a, b)
        for r, i, e in zip(a.tolist(), at, d, strict=True):
            all_d = [sum((x - y) ** 2 for x, y in zip(r, s, strict=True)) for s in b.tolist()]
            assert (i, e) == (all_d.index(min(all_d)), min(all_d))


def plain(rows, parts, entries, rounds):
    """rows: (id, vector, label) as Python numbers; codes by the description alone."""
    kept = [(i, [math.floor(1024 * x) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def best(v, book):
        d = [sum((x - c) ** 2 for x, c in zip(v, e, strict=True)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, v, _ in kept:
                members.setdefault(best(cut(v, p), books[p])[0], []).append(cut(v, p))
            for k, vs in members.items():
                books[p][k] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    out, sums = [], {}
    for i, v, y in kept:
        found = [best(cut(v, p), books[p]) for p in range(parts)]
        e = sum(d for _, d in found)
        sums[y] = sums.get(y, 0) + e
        out.append([i, "".join(f"{k:02x}" for k, _ in found), e, y])
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, sums[y], digest) for i, c, e, y in out), key=repr)


def single(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def test_small_table_with_odd_rows(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(90), [single(rnd.uniform(-1, 1)) for _ in range(8)], rnd.choice([0, 1, None])) for _ in range(60)]
    rows += [rows[0], rows[0], (3, [single(0.1)] * 8, 7), (4, [single(0.1)] * 8, 7), (None, [-0.0009765625] * 8, None), (5, [131071.0] * 8, 1)]
    unsound = [(1, None, 0), (2, [0.5] * 7 + [None], 0), (6, [0.5] * 7 + [math.nan], 0), (7, [math.inf] + [0.5] * 7, 0), (8, [-math.inf] * 8, None)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows + unsound], "vec_id long, embedding array<float>, label int, part string, q int").repartition(5)
    for entries, label_rows in ((256, 1_000), (7, 0)):
        got = vector_codes.quantise(df, entries=entries, label_rows=label_rows)
        assert sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()), key=repr) == plain(rows, 4, entries, 4)
    for none in (df.limit(0), df.where("vec_id IN (1, 2)").where("embedding IS NULL")):
        assert vector_codes.quantise(none).count() == 0


def test_refused_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.quantise(spark.createDataFrame([(1, [1.0] * 6, 0)], schema))
    with pytest.raises(Exception, match="number of components"):
        vector_codes.quantise(spark.createDataFrame([(1, [1.0] * 4, 0), (2, [1.0] * 8, 0)], schema))
    with pytest.raises(Exception, match="leaves"):
        vector_codes.quantise(spark.createDataFrame([(1, [1e30] * 4, 0)], schema))
    assert [r.code for r in vector_codes.quantise(spark.createDataFrame([(1, [], 0)], schema)).collect()] == ["00000000"]


def test_query_equals_plain_rounds(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    got = sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in op13_vector_codes(spark, sf_dir).collect()), key=repr)
    assert len(got) == len(kept)
    x = np.array([[math.floor(1024 * c) for c in v] for _, v, _ in sorted(kept)], np.int64)
    books = [x[:256, p * 16 : p * 16 + 16] for p in range(4)]
    near = lambda p: ((x[:, None, p * 16 : p * 16 + 16] - books[p][None]) ** 2).sum(2)
    for _ in range(4):
        for p in range(4):
            at = near(p).argmin(1)
            books[p] = np.array([x[at == k, p * 16 : p * 16 + 16].sum(0) // (at == k).sum() if (at == k).any() else books[p][k] for k in range(len(books[p]))])
    codes = ["".join(f"{k:02x}" for k in r) for r in np.array([near(p).argmin(1) for p in range(4)]).T]
    assert {r[0]: r[1] for r in got} == dict(zip([i for i, _, _ in sorted(kept)], codes, strict=True))
    assert {r[4] for r in got} == {hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()}
