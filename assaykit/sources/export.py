"""Sinks: canonical JSON Lines, append-only tables, archives of tables with a manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions.udfs import canonical_json


def write_jsonl(df: DataFrame, path: str, *order: str) -> None:
    """One canonical JSON object per line; ordered within and across files if ``order`` is given."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    line = canonical_json()(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))
    rows.select(line.alias("value")).write.text(path)


def append_new(spark: SparkSession, new: DataFrame, path: str, *keys: str) -> int:
    """Appends the rows whose key is not there yet; rows that are there are never changed. Returns how many were new."""
    fresh = new.dropDuplicates(list(keys))
    try:
        there = spark.read.parquet(path).select(*keys)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    else:
        fresh = fresh.join(there, list(keys), "left_anti")
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def digest(df: DataFrame) -> str:
    """Fingerprint of a table's rows, whatever their order: their number and the sum of the leading 60 bits of each row's
    SHA-256. A row is hashed as JSON with its nulls, so that a value and a null can't change places unseen."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    n, total = df.agg(F.count("*"), F.sum(F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)"))).first()
    return f"{n}:{int(total or 0):x}"


def export_tables(tables: dict[str, DataFrame], path: str, *, redact: dict[str, list[str]] | None = None) -> dict:
    """Each table as Parquet under ``path``, columns named in ``redact`` left out, and a manifest of rows and digests."""
    manifest = {}
    for name, df in tables.items():
        kept = df.drop(*(redact or {}).get(name, []))
        kept.write.parquet(f"{path}/{name}")
        manifest[name] = {"columns": kept.columns, "digest": digest(kept)}
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return manifest


def import_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of an export; refused as a whole if one does not match its digest."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    out = {}
    for name, facts in manifest.items():
        df = spark.read.parquet(f"{path}/{name}")
        if df.columns != facts["columns"] or digest(df) != facts["digest"]:
            raise ValueError(f"{name} does not match the manifest")
        out[name] = df
    return out


def orphans(rows: DataFrame, files: DataFrame, key: str = "sha256") -> tuple[DataFrame, DataFrame]:
    """Rows without a file, files without a row."""
    return rows.join(files, key, "left_anti"), files.join(rows, key, "left_anti")
