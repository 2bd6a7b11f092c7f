"""A corpus pipeline of five of the operators: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.llm import decontaminate, jaccard_join, line_dedup, packing, quality
from assaykit.llm.common import broadcast_within, row_keys, same_row, stored, table
from assaykit.llm.queries import held_out_fold, word_bpe

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more."""
    labels = table(spark, sf_dir, "labels").where(~held_out_fold("doc_id", 5))
    scored = quality.score(docs, quality.fit(docs, labels), to="__score")
    return scored.where(F.col("__score") >= 0.3).drop("__score")


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that three or more documents share; n_chars follows the text."""
    done = line_dedup.dedup_lines(docs, min_chars=20, min_docs=3)
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8) the document with the smallest id; one without an id comes
    first, and of repeats of one id and text one row stays. Texts without words all stay."""
    groups = stored(jaccard_join.near_duplicates(docs, n=5, percent=80), "groups")
    named = groups.where("n_shingles > 0")
    kept = named.groupBy("group").agg(F.min(F.struct("__id", "__text_hash")).alias("kept"))
    gone = named.join(kept, "group").where(F.struct("__id", "__text_hash") != F.col("kept"))
    gone = broadcast_within(stored(gone.select("__id", "__text_hash").distinct(), "gone"), 1_000_000)
    again = broadcast_within(stored(named.groupBy("__id", "__text_hash").count().where("count > 1").drop("count"), "again"), 1_000_000)
    base = docs.withColumns(row_keys("doc_id", "text"))
    left = base.join(gone, same_row(base, gone), "left_anti")
    once = left.join(again, same_row(left, again), "left_semi").dropDuplicates(["__id", "__text_hash"])
    return left.join(again, same_row(left, again), "left_anti").unionByName(once).drop("__id", "__text_hash")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window of ten words."""
    done = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), span=10, unnamed=True)
    return done.where("n_hit = 0").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Placement of every document's pieces in sequences of 4096 tokens."""
    return packing.pack_documents(docs, word_bpe(), size=4096, end_id=1, cache_runs=400_000)  # Python workers serve all stages


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("line_dedup", drop_common_lines),
    ("near_duplicates", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can't train the classifier or tokenise; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
