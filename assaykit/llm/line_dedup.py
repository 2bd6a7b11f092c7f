"""Line deduplication: explode normalised lines, hash them, count distinct documents, drop, reassemble by position.

Only DataFrame functions. Texts never leave their row until the end: what is shuffled for the counts is one narrow
row (two hashes, id, position) per line, combined before the shuffle, so a line that a third of all documents hold
is a single key with one partial count per task. The join back to the lines is an inner equi-join whose skewed
partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import SPACE, ascii_lower, row_keys, same_row


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with repeated lines removed from ``text``, and columns n_lines (before) and n_dropped.

    A line's key is the line stripped of ASCII white space at both ends, A-Z lower-cased. A key of at least
    ``min_chars`` code points that at least ``min_docs`` distinct ids hold stays only in the largest of those ids.

    Null text counts as empty and an empty text is one empty line; the text returned is then ''. Ids are compared,
    not rows: repeated rows count once and keep or lose lines alike. Rows without an id do not count towards
    ``min_docs`` and lose the lines that others repeat. Columns of ``docs`` named n_lines or n_dropped are replaced;
    all others pass through. An empty table gives an empty table.
    """
    base = docs.withColumns(row_keys(doc_id, text))
    keys = F.transform(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), "\n"), lambda line: F.btrim(line, F.lit(SPACE)))
    hashes = F.transform(keys, lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("a"), F.hash(k).alias("b"))))
    lines = (
        base.select("__id", "__text_hash", F.posexplode(hashes).alias("__pos", "__h"))
        .where("__h is not null")
        .select("__id", "__text_hash", "__pos", "__h.a", "__h.b")
    )
    common = (
        lines.groupBy("a", "b")
        .agg(F.count_distinct("__id").alias("__n"), F.max("__id").alias("__keeper"))
        .where(F.col("__n") >= min_docs)
        .drop("__n")
    )
    dropped = (
        lines.join(common, ["a", "b"])
        .where(~F.col("__id").eqNullSafe(F.col("__keeper")))
        .groupBy("__id", "__text_hash")
        .agg(F.collect_set("__pos").alias("__dropped"))
    )
    kept_pos = F.array_except(F.sequence(F.lit(0), F.col("n_lines") - 1), F.col("__dropped"))
    whole = F.coalesce(F.col(text), F.lit(""))
    found = F.split(whole, "\n")
    right = dropped.hint("shuffle_hash")
    joined = base.join(right, same_row(base, right), "left").drop(right["__id"], right["__text_hash"])
    return (
        joined.withColumn("n_lines", F.size(found))
        .withColumn("n_dropped", F.coalesce(F.size("__dropped"), F.lit(0)))
        .withColumn(
            text,
            F.when(F.col("__dropped").isNull(), whole).otherwise(F.array_join(F.transform(kept_pos, lambda p: F.get(found, p)), "\n")),
        )
        .drop("__id", "__text_hash", "__dropped")
    )
