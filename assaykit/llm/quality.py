"""Quality classifier: naive Bayes support vectors over n-gram indicators.

1. The vocabulary is every n-gram that occurs in ``min_rows`` of the fitting sample, told apart by 64-bit hash: at most
   ``max_rows`` of the labelled training rows, those with the smallest hash of their id. Its size follows from that bound.
2. Every labelled training row gives counts of these indicators per class; Spark sums them, and each n-gram's log-count
   ratio scales its indicator.
3. A linear hinge-loss model is fitted by dual coordinate descent on the sample; the fifth of it left out of the fit
   sets a sigmoid that turns margins into probabilities. Only this sample meets in one task.
4. Scoring is a map over the documents; the model is broadcast. N-grams beyond the vocabulary add nothing, so that very
   long texts do not run full.

N-grams are taken over the whole text: of words (1, 2), and of word shapes (1, 2, 3), a shape being letter case, last
character's kind, length class and whether the word repeats the one before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import broadcast_within, slices, stored

_MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2^64 divided by the golden ratio


class _Words(dict):
    """A word's 64-bit hash with its shape in the low 8 bits; emptied when full, long words are not remembered."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        s = word.decode("utf-8", "replace")
        letters = [c for c in s if c.isalpha()]
        case = 0 if not letters else 1 if s.islower() else 3 if s.isupper() and len(letters) > 1 else 2 if s[0].isupper() and s[1:].islower() or len(s) == 1 else 4
        last = s[-1]
        end = 0 if last.isalnum() else 1 if last in ".?" else 2 if last in ",;:" else 3 if last == "!" else 4 if len(s) > 1 and s[-2] == last else 5
        value = xxhash.xxh64_intdigest(word.lower()) & ~0xFF | case << 5 | end << 2 | min(3, len(s) // 4)
        if len(self) >= self.LIMIT:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


_WORDS = _Words()


def grams(text: bytes | None) -> np.ndarray:
    """Hashes of a text's n-grams, with repeats."""
    runs = (text or b"").split()
    w = np.fromiter(map(_WORDS.__getitem__, runs), np.uint64, len(runs))
    same = np.zeros(len(w), np.uint64)
    same[1:] = w[1:] == w[:-1]
    shape = ((w & np.uint64(0xFF)) << np.uint64(1) | same) + np.uint64(1)
    two = shape[:-1] << np.uint64(10) | shape[1:]
    three = two[:-1] << np.uint64(10) | shape[2:]
    word = w >> np.uint64(8)
    x = np.concatenate([g ^ np.uint64((n + 1) << 56) for n, g in enumerate((shape, two, three, word, (word[:-1] * np.uint64(31) + word[1:]) & np.uint64((1 << 56) - 1)))])
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


class Vocabulary:
    """Ascending hashes with a table of where each leading bit pattern begins."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(1, len(keys).bit_length()))
        self.start = np.searchsorted(keys, np.arange(1 << int(64 - self.shift), dtype=np.uint64) << self.shift).astype(np.int32)
        self.start = np.append(self.start, np.int32(len(keys)))
        self.stamp = np.zeros(max(1, len(keys)), np.int32)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the distinct known hashes, ascending."""
        slot = (hashes >> self.shift).astype(np.int64)
        at, end = self.start[slot], self.start[slot + 1]
        out = []
        live = np.flatnonzero(at < end)
        while len(live):
            key, want = self.keys[at[live]], hashes[live]
            out.append(at[live[key == want]])
            live = live[key < want]
            at[live] += 1
            live = live[at[live] < end[live]]
        found = np.concatenate([np.zeros(0, np.int32), *out])
        order = np.arange(len(found), dtype=np.int32)
        self.stamp[found] = order  # the last of equal ones stays
        return np.sort(found[self.stamp[found] == order])


def _labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, broadcast_rows: int) -> DataFrame:
    ids = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    return ids.join(broadcast_within(labels, broadcast_rows), "__id").select("__id", F.col("__text"), "__label")


@dataclass(frozen=True)
class Model:
    """``scale``: log-count ratio per n-gram of ``keys``; ``weight``: of the scaled indicator; score = sigmoid(a * margin + b)."""

    keys: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    a: float
    b: float

    def margin(self, idx: np.ndarray) -> float:
        r = self.scale[idx]
        return float(self.weight[idx] @ r) / max(float(np.sqrt(r @ r)), 1e-9) + self.bias


def constant(share: float) -> Model:
    """The model that gives every text the same score."""
    return Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), 0.0, 0.0, float(np.log(share / (1 - share))))


def _descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, epochs: int, c: float) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss, classes weighted to equal cost."""
    rng = np.random.default_rng(7)
    w, bias = np.zeros(len(scale)), 0.0
    xs = [scale[i] / max(float(np.sqrt(scale[i] @ scale[i])), 1e-9) for i in rows]
    q = np.array([x @ x + 1.0 for x in xs])
    share = max(1, int((y > 0).sum())), max(1, int((y < 0).sum()))
    upper = np.where(y > 0, c * len(y) / (2 * share[0]), c * len(y) / (2 * share[1]))
    alpha = np.zeros(len(y))
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            idx, x = rows[i], xs[i]
            gradient = y[i] * (w[idx] @ x + bias) - 1.0
            new = min(max(alpha[i] - gradient / q[i], 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[idx] += step * x
                bias += step
                alpha[i] = new
    return w, bias


def _sigmoid_fit(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Two-parameter logistic fit by damped Newton steps, targets smoothed by the class sizes."""
    n1, n0 = int((y > 0).sum()), int((y < 0).sum())
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g, s = p - t, np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(s * m * m).sum() + 1e-3, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [(g * m).sum(), g.sum()])
        size = max(1.0, abs(da), abs(db))
        a, b = a - da / size, b - db / size
    return a, b


def fit(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", label_id: str = "doc_id",
    max_rows: int = 10_000, min_rows: int = 2, epochs: int = 8, c: float = 1.0, broadcast_rows: int = 1_000_000,
) -> Model:
    """Learns from the documents that ``labels`` marks 0 or 1; other labels, nulls and unknown ids are left out.

    Repeated label rows count repeatedly. With no labelled rows the score is 0.5 everywhere; with one class only it is
    that class's smoothed share. Null text is empty.
    """
    marked = stored(labels.where(F.col(label).isin(0, 1)).select(F.col(label_id).alias("__id"), F.col(label).cast("int").alias("__label")), "labels")
    n = {r[0]: r[1] for r in marked.groupBy("__label").count().collect()}
    if len(n) < 2:
        return constant((n.get(1, 0) + 1) / (sum(n.values()) + 2))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 2_000_000):
                rows = [np.unique(grams(t)).view(np.int64) for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(rows, pa.list_(pa.int64()))], ["id", "y", "grams"])

    id_type = docs.schema[doc_id].dataType.simpleString()
    sample = F.broadcast(marked.orderBy(F.xxhash64("__id"), "__id", "__label").limit(max_rows))
    chosen = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(sample, "__id")
    described_rows = stored(chosen.mapInArrow(described, f"id {id_type}, y int, grams array<long>"), "sample")
    often = described_rows.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= min_rows)
    keys = np.sort(often.select("g").toArrow().column("g").to_numpy().view(np.uint64))  # of at most max_rows rows

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, sums = Vocabulary(shared.value), np.zeros((2, len(shared.value)), np.int64)
        for batch in batches:
            for t, y in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                sums[y, numbers(grams(t))] += 1
        used = np.flatnonzero(sums.any(0))
        for i in range(0, len(used), 100_000):
            u = used[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int32()), pa.array(sums[0, u]), pa.array(sums[1, u])], ["number", "n0", "n1"])

    shared = docs.sparkSession.sparkContext.broadcast(keys)
    counts = _labelled(docs, marked, doc_id, text, broadcast_rows).mapInArrow(counted, "number int, n0 long, n1 long").groupBy("number").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    got = counts.toArrow()  # at most one row per key
    p = np.ones((2, len(keys)))
    for y in (0, 1):
        p[y, got.column("number").to_numpy()] += got.column(f"n{y}").to_numpy()
    p /= p.sum(1, keepdims=True)
    scale = np.log(p[1] / p[0])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Vocabulary(shared.value)
        rows, labelled, ids = [], [], []
        for batch in batches:
            lists = batch.column(2)
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            rows += [numbers(values[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            labelled += batch.column(1).to_pylist()
            ids += batch.column(0).to_pylist()
        if not rows:
            return
        marks = np.array(labelled)
        order = np.lexsort((marks, np.array([xxhash.xxh64_intdigest(str(i)) for i in ids], np.uint64)))
        rows, y = [rows[i] for i in order], np.where(marks[order] == 1, 1.0, -1.0)
        held = np.arange(len(y)) % 5 == 0
        if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
            held[:] = False
        w, bias = _descend([r for r, h in zip(rows, held, strict=True) if not h], y[~held], scale, epochs, c)
        model = Model(shared.value, scale, w, bias, 1.0, 0.0)
        for_fit = held if held.any() else ~held
        a, b = _sigmoid_fit(np.array([model.margin(r) for r, h in zip(rows, for_fit, strict=True) if h]), y[for_fit])
        yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float64())), pa.array([bias]), pa.array([a]), pa.array([b])], ["w", "bias", "a", "b"])

    done = described_rows.repartition(1).mapInArrow(fitted, "w array<double>, bias double, a double, b double").toArrow()
    if not done.num_rows:  # no labelled id has a document
        return constant(0.5)
    row = done.slice(0, 1)
    w = row.column("w").combine_chunks().flatten().to_numpy()
    return Model(keys, scale.astype(np.float32), w.astype(np.float32), *(row.column(x)[0].as_py() for x in ("bias", "a", "b")))


def score(docs: DataFrame, model: Model, *, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` plus ``to``: the probability of label 1, for null and empty texts too. A column of that name is replaced.

    Repeated rows, null ids and other columns pass through; an empty table stays empty.
    """
    rest = [c for c in docs.columns if c != to]
    schema = docs.select(*rest).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # three numbers per n-gram of the fitting sample
    at = rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        numbers = Vocabulary(m.keys)
        for batch in batches:
            for part in slices(batch, at, 4_000_000):
                margins = np.array([m.margin(numbers(grams(t))) for t in part.column(at).cast(pa.binary()).to_pylist()])
                scores = 1 / (1 + np.exp(-np.clip(m.a * margins + m.b, -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], [*part.schema.names, to])

    return docs.select(*rest).mapInArrow(run, schema.add(to, "double"))
