"""The store leaves one file for equal content, and finds changed bytes; gates ask whether runs may be compared."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from assaykit import registry
from assaykit.operators import compare
from assaykit.operators import summary as S
from assaykit.sources import artifacts, views


def files(root):
    return sorted(p for p in Path(root).rglob("*") if p.is_file() and not p.name.startswith("."))


def test_equal_content_is_one_file(spark, tmp_path):
    root = str(tmp_path / "store")
    df = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one"), (4, None), (5, "")], "i int, content string").repartition(4)
    rows = {r.i: r for r in artifacts.put(df, root).collect()}
    again = {r.i: r.content_hash for r in artifacts.put(df.repartition(2), root).collect()}  # as a task that runs again
    assert again == {i: r.content_hash for i, r in rows.items()} and rows[1].content_hash == rows[3].content_hash and rows[4].content_hash is None
    assert len(files(root)) == 3 and rows[1].relative_path == artifacts.relative_path(rows[1].content_hash) and rows[2].size_bytes == 3
    wanted = spark.createDataFrame([(rows[1].content_hash,), ("0" * 64,), (rows[5].content_hash,)], "content_hash string")
    assert {bytes(r.content) if r.content is not None else None for r in artifacts.read(spark, root, wanted).collect()} == {b"one", None, b""}
    place = Path(root) / rows[1].relative_path
    place.write_bytes(b"eno")
    assert [r.content_hash for r in artifacts.stored(spark, root).where("not sound").collect()] == [rows[1].content_hash]
    with pytest.raises(Exception, match="failed hash verification"):
        artifacts.read(spark, root, wanted).collect()
    place.write_bytes(b"longer")
    with pytest.raises(Exception, match="refusing to overwrite"):
        artifacts.put(df, root).collect()
    assert artifacts.stored(spark, root, contents=False).count() == 2  # Spark lists no empty files


def test_unlike_runs_have_no_interval(spark):
    cover = spark.createDataFrame([("x", 1.0), ("y", 1.0)], "comparison string, coverage double")
    intervals = spark.createDataFrame([(c, "case_pass_rate", 0.1, 0.2, 50) for c in "xy"], "comparison string, metric string, lower double, upper double, clusters int")
    findings = spark.createDataFrame([("x", "scenario", False, True), ("y", "scenario", True, False)], "comparison string, check string, ok boolean, blocks_inference boolean")
    checks = compare.gate_checks(cover, intervals, compare.Policy(), findings=findings)
    got = {r.comparison: (r.verdict, r.reasons) for r in compare.gate_decision(cover, checks, compare.Policy()).collect()}
    assert got == {"x": ("inconclusive", ["experiment: experiments are incompatible", "metric:case_pass_rate: no interval"]), "y": ("ready", [])}


def test_metric_values(spark, sf_dir):
    assert len(registry.METRICS) == 40
    rows = S.metric_values(views.cell_trials(spark, sf_dir)).collect()
    assert len(rows) == 14 and {r.name for r in rows} <= set(registry.METRICS)
    assert all(r.metric.value is not None and r.metric.unavailable_reason is None and r.metric.definition == f"{r.name}@1" for r in rows)
    none = views.cell_trials(spark, sf_dir).withColumns({"status": F.lit("timeout"), "outcome": F.lit(None).cast("string")})
    why = {r.name: (r.metric.value, r.metric.unavailable_reason) for r in S.metric_values(none).collect()}
    assert why["conditional_pass"] == (None, "no graded trials") and why["latency_p50"] == (None, "no completed calls") and why["target_completion"] == (0.0, None)
