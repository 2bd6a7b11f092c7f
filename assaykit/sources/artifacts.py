"""A content-addressed store of blobs: each under the SHA-256 of its bytes, as ``aa/bb/<hash>`` below a shared folder.

Tasks write in place. A blob is written beside its place and then moved there, so that a reader never sees a part of one and
a task that runs again, or two with equal content, leave one file. Blobs are never changed; reading checks their bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HASH = "[0-9a-f]{64}"
EMPTY = hashlib.sha256(b"").hexdigest()


class ArtifactError(ValueError):
    """A blob whose bytes aren't those of its address."""


def relative_path(digest: str) -> str:
    return f"{digest[:2]}/{digest[2:4]}/{digest}"


def put(blobs: DataFrame, root: str, content: str = "content") -> DataFrame:
    """``blobs`` with content_hash, size_bytes and relative_path in place of ``content`` (binary or string); written when the
    result is computed. ``root`` is a path or URI that every executor reaches. Null content has null columns and no file. A file
    of another size at a blob's address is an error, never overwritten. One blob at a time is held besides its batch.
    """
    kept = [c for c in blobs.columns if c != content]
    rows = blobs.select(*kept, F.col(content).cast("binary").alias("__content"))
    schema = blobs.select(*kept).schema.add("content_hash", "string").add("size_bytes", "long").add("relative_path", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)

        def write(data: bytes | None) -> tuple:
            if data is None:
                return None, None, None
            digest = hashlib.sha256(data).hexdigest()
            place = f"{base}/{relative_path(digest)}"
            found = store.get_file_info(place)
            if found.type == fs.FileType.NotFound:
                store.create_dir(place.rsplit("/", 1)[0])
                store.create_dir(f"{base}/tmp")
                part = f"{base}/tmp/{digest}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write(data)
                store.move(part, place)
            elif found.size != len(data):
                raise ArtifactError(f"{digest}: a file of {found.size} bytes is there; refusing to overwrite it")
            return digest, len(data), relative_path(digest)

        for batch in batches:
            done = [write(x.as_py()) for x in batch.column(len(kept))]
            made = [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], schema.fieldNames())

    return rows.mapInArrow(run, schema)


def stored(spark: SparkSession, root: str, *, contents: bool = True) -> DataFrame:
    """What the store holds: content_hash, size_bytes and, unless not asked for, content and ``sound`` (the bytes are those of the
    address). Unfinished parts are passed over, and so is the empty blob, since Spark lists no empty files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9a-f]*").option("recursiveFileLookup", "true").load(root)
    digest = F.regexp_extract("path", f"/({HASH})$", 1)
    named = files.select(digest.alias("content_hash"), F.col("length").alias("size_bytes"), *(["content"] if contents else [])).where("content_hash <> ''")
    return named.withColumn("sound", F.sha2("content", 256) == F.col("content_hash")) if contents else named


def read(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (with content_hash) and the content of each; the query ends with an error where bytes don't fit their
    address, and content is null where there is no such file."""
    nothing = F.when(F.col("content_hash") == EMPTY, F.lit("").cast("binary"))
    checked = F.when(F.col("sound"), F.col("content")).otherwise(F.raise_error(F.concat(F.col("content_hash"), F.lit(" failed hash verification"))))
    return wanted.join(stored(spark, root).withColumn("content", checked).select("content_hash", "content"), "content_hash", "left").withColumn("content", F.coalesce("content", nothing))
