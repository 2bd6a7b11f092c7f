"""Strict readers: JSON, JSON Lines and YAML that are refused rather than guessed at, and results of other tools."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.functions.udfs import canonical, strict_json

MAX_BYTES = 10 * 1024 * 1024


def parse_document(content: bytes, kind: str) -> tuple[list | None, str | None]:
    """(records, error) of one file of kind json, jsonl or yaml; all or nothing, with the line of the first JSONL error."""
    if len(content) > MAX_BYTES:
        return None, f"larger than {MAX_BYTES} bytes"
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        return None, f"not UTF-8 at byte {e.start}"
    try:
        if kind == "jsonl":
            out = []
            for n, line in enumerate(text.splitlines(), 1):
                if line.strip():
                    try:
                        out.append(strict_json(line))
                    except ValueError as e:
                        return None, f"line {n}: {e}"
            return out, None
        value = strict_json(text) if kind == "json" else _yaml(text)
    except ValueError as e:
        return None, str(e)
    return value if isinstance(value, list) else [value], None


def _yaml(text: str):
    """YAML of JSON types only: no anchors, aliases, tags, duplicate or other than string keys."""
    import yaml

    try:
        for event in yaml.parse(text, yaml.SafeLoader):
            if isinstance(event, yaml.AliasEvent) or getattr(event, "anchor", None):
                raise ValueError("anchors and aliases are not allowed")
            if getattr(event, "tag", None):
                raise ValueError("tags are not allowed")

        class Loader(yaml.SafeLoader):
            pass

        def mapping(loader, node):
            pairs = [(loader.construct_object(k, True), loader.construct_object(v, True)) for k, v in node.value]
            if any(not isinstance(k, str) for k, _ in pairs):
                raise ValueError("keys must be strings")
            if len(dict(pairs)) != len(pairs):
                raise ValueError("duplicate key")
            return dict(pairs)

        Loader.add_constructor("tag:yaml.org,2002:map", mapping)
        value = yaml.load(text, Loader)
    except yaml.YAMLError as e:
        raise ValueError(str(e).splitlines()[0]) from None
    try:
        canonical(value)
    except (TypeError, ValueError) as e:
        raise ValueError(f"not a JSON type: {e}") from None
    return value


def read_strict(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, record (canonical JSON; null on error), error: one row per record, or one per refused file.

    Files are whole by nature (at most ``MAX_BYTES`` are read of each) and spread over tasks.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for p, size, content in zip(pdf["path"], pdf["length"], pdf["content"], strict=True):
                kind = {"json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "yaml": "yaml", "yml": "yaml"}.get(p.rsplit(".", 1)[-1].lower())
                got, error = (None, "unknown suffix") if kind is None else (None, f"larger than {MAX_BYTES} bytes") if size > MAX_BYTES else parse_document(bytes(content), kind)
                rows += [(p, None, error)] if error else [(p, canonical(x), None) for x in got]
            yield pd.DataFrame(rows, columns=["path", "record", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    content = F.when(F.col("length") <= MAX_BYTES, F.col("content")).otherwise(F.lit(b""))
    return files.select("path", "length", content.alias("content")).mapInPandas(run, "path string, record string, error string")


RESULT = "ordinal int, external_id string, provider string, status string, score double, output string, error string"


def assertion_results(documents: DataFrame, text: str = "text") -> DataFrame:
    """Normalised results of assertion-style result files: a JSON text per row with ``results`` a list, or nested one deeper.

    An error without a grading result, or the failure reason 2, makes the status error; else ``success`` true or false makes
    it pass or fail; neither leaves it unscored.
    """
    item = "array<struct<provider: variant, success: boolean, score: double, error: string, failureReason: int, gradingResult: variant, response: struct<output: variant>, testCase: struct<description: string>>>"
    v = F.try_parse_json(F.col(text))
    items = F.coalesce(F.try_variant_get(v, "$.results.results", item), F.try_variant_get(v, "$.results", item))
    rows = documents.select(F.posexplode(items).alias("ordinal", "r"))
    provider = F.coalesce(F.try_variant_get("r.provider", "$.id", "string"), F.try_variant_get("r.provider", "$", "string"))
    ungraded = F.coalesce(F.to_json("r.gradingResult"), F.lit("null")).isin("null", "{}")
    has_error = F.col("r.error").isNotNull() & (F.col("r.error") != "") & ungraded
    status = F.when(has_error | (F.col("r.failureReason") == 2), "error").when(F.col("r.success"), "pass").when(~F.col("r.success"), "fail").otherwise("unscored")
    output = F.coalesce(F.try_variant_get("r.response.output", "$", "string"), F.to_json("r.response.output"))
    return rows.select("ordinal", F.coalesce("r.testCase.description", F.col("ordinal").cast("string")).alias("external_id"), provider.alias("provider"), status.alias("status"), F.col("r.score").alias("score"), output.alias("output"), F.col("r.error").alias("error"))


def sample_logs(documents: DataFrame, text: str = "text") -> DataFrame:
    """Normalised results of evaluation logs with samples. Verdicts are the letter C or true (pass) and I or false (fail);
    P, N, numbers and texts are none. Any fail makes a sample fail, else any pass makes it pass, none leaves it unscored,
    and an error is an error. ``score``: the first numeric score.
    """
    item = "array<struct<id: variant, error: struct<message: string>, scores: map<string, struct<value: variant>>, output: struct<completion: string>>>"
    v = F.try_parse_json(F.col(text))
    rows = documents.select(F.try_variant_get(v, "$.eval.model", "string").alias("provider"), F.posexplode(F.try_variant_get(v, "$.samples", item)).alias("ordinal", "r"))
    said = F.transform(F.map_values("r.scores"), lambda x: F.struct(F.to_json(x["value"]).alias("json"), F.try_variant_get(x["value"], "$", "double").alias("number")))
    any_of = lambda *xs: F.coalesce(F.exists(said, lambda x: x["json"].isin(*xs)), F.lit(False))
    status = F.when(F.col("r.error").isNotNull(), "error").when(any_of('"I"', "false"), "fail").when(any_of('"C"', "true"), "pass").otherwise("unscored")
    numeric = F.filter(said, lambda x: x["json"].rlike(r"^-?[0-9]"))
    return rows.select("ordinal", F.try_variant_get("r.id", "$", "string").alias("external_id"), "provider", status.alias("status"), F.get(numeric, F.lit(0))["number"].alias("score"), F.col("r.output.completion").alias("output"), F.col("r.error.message").alias("error"))


def reference_path(value: Column, path: str, kind: str = "string") -> Column:
    """A value at ``step.field[0].x`` of a variant of earlier outputs; null if it is missing. At most 16 segments."""
    import re

    if not re.fullmatch(r"[A-Za-z_][\w-]*((\.[A-Za-z_][\w-]*)|(\[\d+\]))*", path) or len(re.findall(r"[.\[]", path)) + 1 > 16:
        raise ValueError(f"not a path: {path!r}")
    steps = "".join(f"['{s}']" if not s.startswith("[") else s for s in re.findall(r"[A-Za-z_][\w-]*|\[\d+\]", path))
    return F.try_variant_get(value, "$" + steps, kind)
