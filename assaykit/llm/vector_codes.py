"""Product quantisation in whole numbers: codebooks by rounds of nearest entries, and a code for each vector.

Distances are exact. Components become integers; a block's integers are broken into limbs so narrow that a float64 matrix
product of limbs stays below 2**53 and is therefore exact in BLAS; the products are put together in 64-bit integers. The
first of the least distances decides, so ties go to the lower entry, and no result depends on how rows are dealt to tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import broadcast_within, stored

BLOCK = 4096  # rows of one matrix product


def _log2(n: int) -> int:
    """The least power of two that is at least ``n``, as its exponent."""
    return max(0, n - 1).bit_length()


def limbs(x: np.ndarray, width: int) -> list[np.ndarray]:
    """``x`` (int64) as float64 arrays, lowest first: the sum of limb i times 2**(i * width); the last bears the sign."""
    found, rest = [], x
    while rest.size and max(int(rest.max()), -int(rest.min()) - 1) >> width:
        found.append((rest & ((1 << width) - 1)).astype(np.float64))
        rest = rest >> width
    return [*found, rest.astype(np.float64)]


def exact_dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of int64 matrices by float64 products, each exact: of limbs w bits wide, 2 * w + log2(terms) <= 53."""
    width = (53 - _log2(a.shape[1])) // 2
    out = np.zeros((len(a), len(b)), np.int64)
    right = limbs(b, width)
    for i, x in enumerate(limbs(a, width)):
        for j, y in enumerate(right):
            out += (x @ y.T).astype(np.int64) << (width * (i + j))
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (the first of equals) and the squared distance, for each row of ``x``."""
    score = (book * book).sum(1)[None, :] - 2 * exact_dots(x, book)
    at = score.argmin(1)
    return at, score[np.arange(len(x)), at] + (x * x).sum(1)


@dataclass(frozen=True)
class Codebooks:
    """``books``: parts x entries x components, int64. Of fixed size, whatever the number of vectors."""

    books: np.ndarray

    def digest(self) -> str:
        """Of all components as decimal integers, comma-joined, by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def whole_numbers(vectors: DataFrame, *, vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """``vectors`` without rows whose vector is null or has a null or non-finite component, and ``q``: floor(scale * x)."""
    c = vectors[vector]
    sound = c.isNotNull() & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(sound).withColumn("q", F.transform(c, lambda x: F.floor(x.cast("double") * scale)))


def checked(q: Column, parts: int, width: int) -> Column:
    """``q``; the query ends with an error where its length is another, or a component is so large that distances could
    leave 64 bits: past +- 2**27 for parts of 16 components, 2**24 for 1,024."""
    bound = 1 << ((61 - _log2(width) - _log2(parts)) // 2 if width else 0)
    length = F.concat(F.lit(f"vectors of {parts * width} and of "), F.size(q).cast("string"), F.lit(" components"))
    right = F.when(F.size(q) != parts * width, F.raise_error(length))
    return right.when(F.exists(q, lambda x: (x > bound) | (x < -bound)), F.raise_error(F.lit(f"a component leaves +- {bound}"))).otherwise(q)


def _blocks(batches: Iterator[pa.RecordBatch], column: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, width)


def fit(vectors: DataFrame, *, vec_id: str = "vec_id", parts: int = 4, entries: int = 256, rounds: int = 4) -> Codebooks:
    """Codebooks that begin as the vectors of the smallest ids and follow their members' floored means, ``rounds`` times.

    ``vectors`` as ``whole_numbers`` gives them, all of one length, which ``parts`` divides. Ids that repeat stand next to
    each other, in the order of their components; rows without an id come last. Fewer rows give fewer entries, an empty
    table none; an entry without members stays. A task sends the driver's sum one row of each entry it met: work is
    linear in the rows, what is gathered has parts * entries rows.
    """
    first = vectors.select("q").orderBy(F.col(vec_id).asc_nulls_last(), "q").limit(entries)
    seeds = [r.q for r in first.collect()]  # at most ``entries`` rows
    if not seeds:
        return Codebooks(np.zeros((parts, 0, 0), np.int64))
    length = len(seeds[0])
    if any(len(q) != length for q in seeds):
        raise ValueError("vectors differ in their number of components")
    if length % parts:
        raise ValueError(f"vectors of {length} components can't be cut into {parts} equal parts")
    width = length // parts
    books = np.array(seeds, np.int64).reshape(len(seeds), parts, width).swapaxes(0, 1)
    sound = vectors.select(checked(F.col("q"), parts, width).alias("q"))
    sums = [f"s{i}" for i in range(width)]
    schema = "part int, entry int, n long, " + ", ".join(f"{s} long" for s in sums)
    for _ in range(rounds if width else 0):
        partial = sound.mapInArrow(_member_sums(books), schema)
        got = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums]).collect()
        books = books.copy()
        for r in got:
            books[r.part, r.entry] = np.array([r[s] for s in sums], np.int64) // r.n
    return Codebooks(books)


def _member_sums(books: np.ndarray):
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for _, x in _blocks(batches, 0, parts * width):
            for p in range(parts):
                piece = x[:, p * width : (p + 1) * width]
                at = nearest(piece, books[p])[0] + p * entries
                n += np.bincount(at, minlength=len(n))
                order = at.argsort(kind="stable")
                begins = np.flatnonzero(np.diff(at[order], prepend=-1))
                sums[at[order[begins]]] += np.add.reduceat(piece[order], begins)
        met = np.flatnonzero(n)
        columns = [met // entries, met % entries, n[met], *sums[met].T]
        names = ["part", "entry", "n", *[f"s{i}" for i in range(width)]]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, [np.int32] * 2 + [np.int64] * (1 + width), strict=True)], names)

    return run


def encode(vectors: DataFrame, codebooks: Codebooks, *, vec_id: str = "vec_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """vec_id, the columns ``keep``, code (two hex digits of the nearest entry for each part, in order) and error (long)."""
    books = codebooks.books
    parts, entries, width = books.shape
    if entries > 256:
        raise ValueError("a code has two hex digits: at most 256 entries")
    rows = vectors.select(vec_id, *keep, (checked(F.col("q"), parts, width) if entries else F.col("q")).alias("q"))
    schema = rows.drop("q").schema.add("code", "string").add("error", "long")
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, len(names) - 2, parts * width):
            at, error = np.zeros((part.num_rows, parts), np.uint8), np.zeros(part.num_rows, np.int64)
            for p in range(parts if width else 0):
                found, distance = nearest(x[:, p * width : (p + 1) * width], books[p])
                at[:, p] = found
                error += distance
            text = at.tobytes().hex()
            codes = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(codes, pa.string()), pa.array(error)], names)

    return rows.mapInArrow(run, schema)


def quantise(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4, label_rows: int = 1_000_000) -> DataFrame:
    """vec_id, label, code, error, label_error (the sum over rows of an equal label, null among them) and codebooks_sha256.

    Unsound vectors have no row (``whole_numbers``); repeated and null ids and labels are rows like others; other columns
    aren't read. Codes are stored once, since both the rows and the sums by label read them.
    """
    sound = whole_numbers(vectors.select(vec_id, vector, label), vector=vector, scale=scale)
    books = fit(sound, vec_id=vec_id, parts=parts, entries=entries, rounds=rounds)
    coded = stored(encode(sound, books, vec_id=vec_id, keep=(label,)), "vector-codes")
    sums = coded.groupBy(F.col(label).alias("__label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(broadcast_within(sums, label_rows), F.col(label).eqNullSafe(F.col("__label")))
    return joined.drop("__label").withColumn("codebooks_sha256", F.lit(books.digest()))
