"""Benchmark decontamination by winnowing: minimum k-gram hash per sliding window, fingerprint join, extension of hits.

Both sides keep the smallest hash of each run of ``span - k + 1`` consecutive k-grams, so any shared run of ``span``
words leaves at least one common fingerprint. Documents that share a fingerprint are extended: every window of
``span`` words is compared with the items' windows, by position. Only DataFrame functions: hashes are arrays inside
the row, exploded straight into a join with the benchmark's side. That side is broadcast only after its rows are
counted; beyond ``broadcast_rows`` the same joins shuffle. No document text is shuffled unless there are more
candidate documents than ``broadcast_rows``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import alnum_words, broadcast_within, let, row_keys, same_row, stored


def _pairs(grams: Column, apart: int) -> Column:
    """Hashes of the grams that start ``apart`` words after one another; runs past the end are the caller's to cut."""
    return F.transform(grams, lambda g, i: F.xxhash64(g, F.get(grams, i + apart)))


def word_hashes(text: Column) -> Column:
    return F.transform(alnum_words(text), lambda w: F.xxhash64(w))


def ngram_hashes(hashes: Column, n: int) -> Column:
    """The 64-bit hashes of all runs of n words, from the word hashes; doubling keeps each step short."""

    def widened(grams: Column, width: int) -> Column:
        if width == n:
            return F.slice(grams, F.lit(1), F.greatest(F.size(hashes) - (n - 1), F.lit(0)))
        apart = width if width * 2 <= n else n - width  # at last two overlapping runs cover the n words
        return let(_pairs(grams, apart), lambda g: widened(g, width + apart))

    return widened(hashes, 1)


def _grams_of(n: int) -> Callable[[Column], Column]:
    return lambda w: ngram_hashes(w, n)


def winnow(hashes: Column, span: int, k: int) -> Column:
    """The distinct minima over all windows of ``span - k + 1`` consecutive k-gram hashes."""
    width = span - k + 1

    def minima(grams: Column) -> Column:
        least = F.transform(grams, lambda g, i: F.least(g, *[F.get(grams, i + j) for j in range(1, width)]) if width > 1 else g)
        return F.array_distinct(F.slice(least, F.lit(1), F.greatest(F.size(grams) - (width - 1), F.lit(0))))

    return let(ngram_hashes(hashes, k), minima)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    span: int = 10, k: int = 8, unnamed: bool = False, broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """``docs`` plus n_words, n_hit (words inside any occurrence of an item's window), hit_starts (word positions and
    lengths of those occurrences), items (sorted array of the item ids that occur, as strings), n_items (their number, and
    one more if items without an id occur and count).

    A window is ``span`` consecutive words of an item; an item of fewer words, but not none, is one window, searched
    by its whole hash. Null and empty texts have no words: no hits, no windows. Items without an id are left out,
    or with ``unnamed`` hit like others, in all columns but items; repeated items and items that share windows all
    count. Rows of docs are told apart by id and text, so repeated
    rows get equal results; null ids work. Columns of docs with the added names are replaced; an empty benchmark
    leaves every document clean. Windows are compared by 64-bit hashes.
    """
    named = benchmark.where(F.col(item_id).isNotNull() | F.lit(unnamed)).select(F.col(item_id).cast("string").alias("item"), word_hashes(F.col(item_text)).alias("w"))
    items = stored(named.where(F.size("w") > 0).distinct(), "items")
    short = [r[0] for r in items.where(F.size("w") < span).select(F.size("w")).distinct().collect()]  # fewer than span values
    windows = {n: items.where(F.size("w") >= n if n == span else F.size("w") == n).select("item", F.explode(ngram_hashes(F.col("w"), n)).alias("h")).distinct() for n in [*short, span]}
    marks = broadcast_within(items.where(F.size("w") >= span).select(F.explode(winnow(F.col("w"), span, k)).alias("h")).distinct(), broadcast_rows)

    base = docs.withColumns(row_keys(doc_id, text))
    rows = base.select("__id", "__text_hash", F.col(text).alias("__text"))
    shared = rows.select("__id", "__text_hash", F.explode(let(word_hashes(F.col("__text")), lambda w: winnow(w, span, k))).alias("h")).join(marks, "h", "left_semi")
    found = broadcast_within(stored(shared.select("__id", "__text_hash").distinct(), "candidates"), broadcast_rows)

    hits = None
    for n, win in windows.items():
        # the long windows are looked up in the documents that share a fingerprint, the short items everywhere
        of = rows.join(found, same_row(rows, found), "left_semi") if n == span else rows
        at = of.select("__id", "__text_hash", F.posexplode(let(word_hashes(F.col("__text")), _grams_of(n))).alias("pos", "h"))
        part = at.join(broadcast_within(win, broadcast_rows), "h").select("__id", "__text_hash", "item", F.struct("pos", F.lit(n).alias("n")).alias("at"))
        hits = part if hits is None else hits.unionByName(part)
    per_doc = hits.groupBy("__id", "__text_hash").agg(F.array_sort(F.collect_set("at")).alias("hit_starts"), F.array_sort(F.collect_set("item")).alias("items"), F.max(F.col("item").isNull().cast("long")).alias("__unnamed")).hint("shuffle_hash")

    covered = F.size(F.array_distinct(F.flatten(F.transform("hit_starts", lambda s: F.sequence(s["pos"], s["pos"] + s["n"] - 1)))))
    joined = base.drop("hit_starts", "items", "n_items", "n_words", "n_hit").join(per_doc, same_row(base, per_doc), "left").drop(per_doc["__id"], per_doc["__text_hash"])
    return joined.withColumns(
        {
            "n_words": F.size(alnum_words(F.col(text))).cast("long"),
            "n_hit": F.when(F.col("hit_starts").isNull(), F.lit(0)).otherwise(covered).cast("long"),
            "n_items": F.coalesce(F.size("items") + F.col("__unnamed"), F.lit(0)).cast("long"),
            "items": F.coalesce("items", F.array().cast("array<string>")),
            "hit_starts": F.coalesce("hit_starts", F.array().cast("array<struct<pos:int,n:int>>")),
        }
    ).drop("__id", "__text_hash", "__unnamed")
