"""Long repeated word spans by a sparse de Bruijn graph: k-mer edges, compacted nonbranching paths, checked by coordinates.

Every run of ``span`` words holds at least one anchor: its smallest k-mer by hash. Anchors (about 1 in 15 words) are
the graph's nodes; the words from one anchor to the next are an edge, labelled by their hash. Anchors that occur once
lie in no repeated span and drop out. A node whose occurrences all go on alike on a side does not branch there, so two
joined nodes compact into a path without looking at the words between again: a Spark join gives every occurrence
its node's degrees, and as each occurrence of a nonbranching path runs through all of it, the path is there in
each document as a run of such edges. Windows inside a path are repeated. Those around a repeated anchor that
cross a branch or an end are compared by their own hash, at their coordinates in each source.

Shuffled: a narrow row per anchor and one per window at a branch, twice each; and the texts, once. The spans go back to
the texts by a broadcast after they are counted, beyond ``broadcast_rows`` by a shuffle. Counts combine before the shuffle; joins on hot k-mers are inner equi-joins that adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import WordHashes, drop_stored, row_keys, same_row, stored

_HASHES = WordHashes()
_BASE = 0xD1342543DE82EF95  # fixed value: an odd 64-bit multiplier
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse, modulo 2^64, as many as the longest text so far has words."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 15)
            one = np.ones(1, np.uint64)
            self.up = np.cumprod(np.concatenate([one, np.full(size - 1, _BASE, np.uint64)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([one, np.full(size - 1, _INVERSE, np.uint64)]), dtype=np.uint64)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spelled:
    """A text's words as hashes, with the hash of any run of them in constant time."""

    def __init__(self, text: bytes | None):
        runs = (text or b"").split()
        self.n = len(runs)
        h = np.fromiter(map(_HASHES.__getitem__, runs), np.uint64, self.n)
        up, self.down = _POWERS.upto(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(h * up[:-1], out=self.sums[1:])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words from start to before end; equal runs have equal hashes wherever they are."""
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def smallest(self, span: int, k: int) -> np.ndarray:
        """For each window of ``span`` words the position of its smallest k-mer, the first of equals."""
        if self.n < span:
            return np.zeros(0, np.int64)
        at = np.arange(self.n - k + 1)
        grams = self.runs(at, at + k)
        width = span - k + 1
        first = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(1)
        return first + np.arange(len(first))


def _int64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchor_rows(texts: DataFrame, span: int, k: int) -> DataFrame:
    """One row per anchor: its text's key, pos, node (k-mer hash), before and after (labels of its two edges; 0: none)."""
    id_type = texts.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                rows, pos, node, before, after = [], [], [], [], []
                for row, text in enumerate(part.column(2).cast(pa.binary()).to_pylist()):
                    s = Spelled(text)
                    p = np.unique(s.smallest(span, k))
                    if not len(p):
                        continue
                    label = s.runs(p[:-1], p[1:] + k) | np.uint64(1)
                    end = np.zeros(1, np.uint64)
                    rows.append(np.full(len(p), row))
                    pos.append(p)
                    node.append(s.runs(p, p + k))
                    before.append(np.concatenate([end, label]))
                    after.append(np.concatenate([label, end]))
                if rows:
                    at = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(at), part.column(1).take(at), pa.array(np.concatenate(pos).astype(np.int32)), *[_int64(np.concatenate(x)) for x in (node, before, after)]],
                        ["__id", "__text_hash", "pos", "node", "before", "after"],
                    )

    return texts.mapInArrow(run, f"__id {id_type}, __text_hash long, pos int, node long, before long, after long")


def covered_spans(text: bytes | None, nodes: list[dict], span: int, k: int) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Word spans inside compacted paths, and the starts and hashes of the windows left to compare.

    ``nodes``: the text's repeated anchors, each with pos, ``left`` and ``right`` (it does not branch on that side).
    """
    s = Spelled(text)
    own = s.smallest(span, k)
    p = np.unique(own)
    repeated, left, right = (np.zeros(len(p), bool) for _ in range(3))
    at = np.searchsorted(p, [x["pos"] for x in nodes])
    repeated[at], left[at], right[at] = True, [x["left"] for x in nodes], [x["right"] for x in nodes]
    joined = repeated[:-1] & repeated[1:] & right[:-1] & left[1:]
    start = np.arange(s.n - span + 1)
    possible = repeated[np.searchsorted(p, own)]  # other anchors in the window may be due to words outside it
    # the path's nodes at or before the window's start and at or after its end
    a, b = np.searchsorted(p, start, "right") - 1, np.searchsorted(p, start + span - k)
    broken = np.concatenate([[0], np.cumsum(~joined)])
    inside = (a >= 0) & (b < len(p))
    inside[inside] = broken[b[inside]] == broken[a[inside]]
    inside &= possible
    rest = start[possible & ~inside]
    return merged(start[inside], span), rest, s.runs(rest, rest + span)


def merged(starts: np.ndarray, span: int) -> list[tuple[int, int]]:
    """Disjoint spans, in order, that the windows at these ascending starts cover together."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.diff(starts) > span) + 1
    firsts = starts[np.concatenate([[0], new])]
    lasts = starts[np.concatenate([new - 1, [len(starts) - 1]])] + span
    return list(zip(firsts.tolist(), lasts.tolist(), strict=True))


def repeated_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", span: int = 35, k: int = 8) -> DataFrame:
    """__id, __text_hash, spans (array<struct<start, end>>, word positions) of the texts that hold a window of ``span``
    words which starts anywhere else too, in the same text or another. Texts without one are left out."""
    texts = docs.select(*[c.alias(n) for n, c in row_keys(doc_id, text).items()], F.col(text).alias("__text"))
    id_type = texts.schema["__id"].dataType.simpleString()
    anchors = stored(anchor_rows(texts, span, k), "anchors")
    ends = [f(c).alias(f"{c}_{f.__name__}") for c in ("before", "after") for f in (F.min, F.max)]
    nodes = anchors.groupBy("node").agg(F.count("*").alias("n"), *ends).where("n > 1")
    nodes = nodes.select("node", *[((F.col(f"{c}_min") == F.col(f"{c}_max")) & (F.col(f"{c}_min") != 0)).alias(side) for c, side in (("before", "left"), ("after", "right"))])
    per_text = anchors.select("__id", "__text_hash", "pos", "node").join(nodes, "node").groupBy("__id", "__text_hash").agg(F.sort_array(F.collect_set(F.struct("pos", "left", "right"))).alias("nodes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                spans, starts, hashes = [], [], []
                for t, found in zip(part.column(2).cast(pa.binary()).to_pylist(), part.column(3).to_pylist(), strict=True):
                    inside, rest, h = covered_spans(t, found, span, k)
                    spans.append([{"start": a, "end": b} for a, b in inside])
                    starts.append(rest)
                    hashes.append(h.view(np.int64))
                pairs = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(spans, pairs), pa.array(starts, pa.list_(pa.int32())), pa.array(hashes, pa.list_(pa.int64()))],
                    ["__id", "__text_hash", "spans", "starts", "hashes"],
                )

    with_nodes = texts.join(per_text.hint("shuffle_hash"), same_row(texts, per_text)).select(texts["*"], "nodes")
    compacted = stored(with_nodes.mapInArrow(run, f"__id {id_type}, __text_hash long, spans array<struct<start:int,end:int>>, starts array<int>, hashes array<long>"), "compacted")
    open_windows = compacted.select("__id", "__text_hash", F.inline(F.arrays_zip("starts", "hashes")).alias("start", "h"))
    drop_stored(anchors)
    again = open_windows.select("h").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    window_spans = open_windows.join(again, "h").select("__id", "__text_hash", F.struct("start", (F.col("start") + span).alias("end")).alias("s"))
    path_spans = compacted.select("__id", "__text_hash", F.explode("spans").alias("s"))
    found = path_spans.unionByName(window_spans).groupBy("__id", "__text_hash").agg(F.sort_array(F.collect_set("s")).alias("spans"))

    def joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for listed in batch.column(2).to_pylist():
                own = listed[:1]
                for x in listed[1:]:
                    if x["start"] <= own[-1]["end"]:
                        own[-1]["end"] = max(own[-1]["end"], x["end"])
                    else:
                        own.append(x)
                spans.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, batch.column(2).type)], ["__id", "__text_hash", "spans"])

    return found.mapInArrow(joined_up, found.schema)


def dedup_substrings(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", span: int = 35, k: int = 8, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``docs`` with each word removed from ``text`` that a window of ``span`` words covers whose word sequence also
    starts anywhere else (every copy goes), and n_words, n_removed. Kept words are joined by one space.

    Words are runs of anything but ASCII white space, unchanged. Windows are judged on the input. Null and empty texts
    have no words and become ''; texts shorter than ``span`` words keep all. Rows are told apart by id and text; a
    repeated row repeats all its windows, so a long one loses all its words in both. Columns named n_words or
    n_removed are replaced, others pass through; an empty table stays empty. Sequences are compared by 64-bit hashes.
    """
    spans = stored(repeated_spans(docs, doc_id=doc_id, text=text, span=span, k=k), "spans")
    if (spans.agg(F.sum(F.size("spans") + 2)).first()[0] or 0) <= broadcast_rows:  # a span or a key is 16 bytes
        spans = F.broadcast(spans)
    rest = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    base = docs.select(*rest).withColumns(row_keys(doc_id, text))
    joined = base.join(spans, same_row(base, spans), "left").select(*[base[c] for c in rest], F.col("spans").alias("__spans"))
    at = rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                out, words, removed = [], [], []
                for t, found in zip(part.column(at).cast(pa.binary()).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True):
                    runs = (t or b"").split()
                    words.append(len(runs))
                    kept, done, gone = [], 0, 0
                    for s in found or ():
                        if s["start"] > done:
                            kept += runs[done : s["start"]]
                        gone += max(0, s["end"] - max(done, s["start"]))
                        done = max(done, s["end"])
                    removed.append(gone)
                    out.append(b" ".join(kept + runs[done:]))
                cols = list(part.columns[:-1])
                cols[at] = pa.array(out, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(words, pa.int64()), pa.array(removed, pa.int64())], [*rest, "n_words", "n_removed"])

    return joined.mapInArrow(run, docs.select(*rest).schema.add("n_words", "long").add("n_removed", "long"))
