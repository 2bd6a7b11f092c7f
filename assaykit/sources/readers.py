"""Strict files as a Spark data source, for batches and streams: ``spark.read.format("strict_rows").load(folder)``.

One row per record of the JSON, JSON Lines and YAML files below a folder: path, ordinal (place in the file), record (canonical
JSON) and error; a file that is refused is one row with an error. Files are dealt to tasks by their sizes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from assaykit.functions.udfs import canonical
from assaykit.sources.strict import MAX_BYTES, parse_document

KINDS = {"json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "yaml": "yaml", "yml": "yaml"}
SCHEMA = "path string, ordinal int, record string, error string"


@dataclass
class Files(InputPartition):
    paths: list[str]


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _listed(options: dict) -> list[tuple[str, int, int]]:
    """(path, size, time in nanoseconds) of the files below the folder that have a known suffix, by path."""
    from pyarrow import fs

    store, base = _store(options["path"])
    found = store.get_file_info(base)
    infos = [found] if found.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
    return sorted((i.path, i.size, i.mtime_ns or 0) for i in infos if i.type == fs.FileType.File and i.extension.lower() in KINDS)


def _dealt(files: list[tuple[str, int, int]], options: dict) -> list[Files]:
    """Files in order, as many to a task as come to ``partitionBytes`` (64 MB; options come in lower case); a larger one is alone."""
    most, out, held = int(options.get("partitionbytes", 64 << 20)), [], 0
    for path, size, _ in files:
        if not out or held + size > most:
            out.append(Files([]))
            held = 0
        out[-1].paths.append(path)
        held += size
    return out


def _rows(options: dict, part: Files) -> Iterator[tuple]:
    store, _ = _store(options["path"])
    for path in part.paths:
        with store.open_input_stream(path) as f:
            content = f.read(MAX_BYTES + 1)
        got, error = parse_document(content, KINDS[path.rsplit(".", 1)[-1].lower()])
        if error:
            yield path, None, None, error
        else:
            yield from ((path, n, canonical(x), None) for n, x in enumerate(got))


class StrictReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Files]:
        return _dealt(_listed(self.options), self.options) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.options, partition)


class StrictStream(DataSourceStreamReader):
    """New files by their time: each is read once, in the batch after it was written. Files must be moved in whole, and none may
    come with a time before that of a batch already read."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"time": -1}

    def latestOffset(self) -> dict:
        return {"time": max((t for _, _, t in _listed(self.options)), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return _dealt([f for f in _listed(self.options) if start["time"] < f[2] <= end["time"]], self.options)

    def read(self, partition: Files) -> Iterator[tuple]:
        return _rows(self.options, partition)

    def commit(self, end: dict) -> None:
        pass


class StrictRows(DataSource):
    """Options: the path, and partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "strict_rows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return StrictReader({**self.options})

    def streamReader(self, schema) -> DataSourceStreamReader:
        return StrictStream({**self.options})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StrictRows)


def fixture_cases(spark: SparkSession, folder: str, include: list[str] | None = None) -> DataFrame:
    """Cases of a fixture folder: place (in their order), external_id, record, path and error.

    Those listed in ``scenario.yaml`` come first, then those of the files under ``cases``, by name. With ``include`` only those, in
    the order asked for; an id that isn't there is a ``KeyError``. Refused files are rows with an error and no id.
    """
    register(spark)
    rows = spark.read.format("strict_rows").load(folder)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    own = rows.where(name.rlike("^scenario[.]ya?ml$") & F.col("error").isNull())
    listed = F.from_json(F.get_json_object("record", "$.dataset.cases"), "array<variant>")
    first = own.select("path", F.posexplode(listed).alias("ordinal", "v")).select(F.lit("").alias("file"), "path", "ordinal", F.to_json("v").alias("record"), F.lit(None).cast("string").alias("error"))
    others = rows.where(F.col("path").rlike("/cases/[^/]*[.]ya?ml$") | (name.rlike("^scenario[.]ya?ml$") & F.col("error").isNotNull()))
    cases = first.unionByName(others.select(name.alias("file"), "path", "ordinal", "record", "error"))
    cases = cases.withColumn("external_id", F.get_json_object("record", "$.external_id"))
    if include is None:
        return cases.select(F.struct("file", "ordinal").alias("place"), "external_id", "record", "path", "error").orderBy("place")
    wanted = spark.createDataFrame(list(enumerate(include)), "place int, external_id string")
    missing = [r[0] for r in wanted.join(cases, "external_id", "left_anti").orderBy("place").select("external_id").collect()]
    if missing:
        raise KeyError(f"cases {missing} not found in {folder}")
    last = cases.groupBy("external_id").agg(F.max_by(F.struct("record", "path", "error"), F.struct("file", "ordinal")).alias("c"))
    return wanted.join(last, "external_id").select("place", "external_id", "c.*").orderBy("place")
