"""Helpers that several operators share: words, keys, stored tables, size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space and the ASCII letters.
SPACE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is far faster than ``translate`` and equal to it when no other capital occurs."""
    ascii_only = F.octet_length(c) == F.char_length(c)
    other_capital = c.rlike(r"[\p{Lu}\p{Lt}\p{Nl}\p{So}\p{Cn}&&[^A-Z]]")
    return F.when(ascii_only | ~other_capital, F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it: the optimizer would else repeat it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def alnum_words(c: Column) -> Column:
    """Array of the maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased; null has none."""
    found = F.split(ascii_lower(F.coalesce(c, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(found, lambda w: w != "")


def row_keys(doc_id: str, text: str) -> dict[str, Column]:
    """Columns that tell rows apart, rows of one id with other texts included; whole repeats of a row share a key."""
    return {"__id": F.col(doc_id), "__text_hash": F.xxhash64(F.coalesce(F.col(text), F.lit("")))}


def same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["__id"].eqNullSafe(right["__id"]) & (left["__text_hash"] == right["__text_hash"])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one only where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """``stored`` as a table bucketed by ``key``: later groupings by it read the rows where they are, without a shuffle."""
    spark = df.sparkSession
    made = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{made}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(made)
    out = spark.table(made)
    out.stored_path = path
    return out


def drop_stored(df: DataFrame) -> None:
    """Delete a stored table that no later step reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_within(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def slices(batch: pa.RecordBatch, column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose values in a string column come to about ``most_bytes``; a longer row is alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


class WordHashes(dict):
    """64-bit hash of a word's UTF-8 bytes, remembered; emptied when full so that memory stays bounded."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found
