"""Strict files as a data source: batch, stream, fixture folders."""

import json
import time

import pytest

from assaykit.sources import readers


def write(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / name.replace("__", ".")).write_text(text)


def test_batch_and_stream(spark, tmp_path):
    readers.register(spark)
    folder = tmp_path / "in"
    write(folder, a__json='[{"b": 1, "a": 1.0}, 2]', b__jsonl='{"x": 1}\n\n{"x": 2, "x": 3}', c__txt="not read", d__yaml="k: [1, two]\n")
    want = [("a.json", 0, '{"a":1.0,"b":1}', None), ("a.json", 1, "2", None), ("b.jsonl", None, None, "line 3: duplicate key"), ("d.yaml", 0, '{"k":[1,"two"]}', None)]
    short = lambda df: sorted(((r.path.rsplit("/", 1)[-1], r.ordinal, r.record, r.error) for r in df.collect()), key=repr)
    assert short(spark.read.format("strict_rows").load(str(folder))) == want
    parts = spark.read.format("strict_rows").option("partitionBytes", 1).load(str(folder))
    assert parts.rdd.getNumPartitions() == 3 and short(parts) == want
    (tmp_path / "none").mkdir()
    assert spark.read.format("strict_rows").load(str(tmp_path / "none")).count() == 0

    def follow():
        q = spark.readStream.format("strict_rows").load(str(folder)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        assert q.trigger(availableNow=True).start().awaitTermination(120) is not False
        return short(spark.read.schema(readers.SCHEMA).parquet(str(tmp_path / "out")))

    assert follow() == want
    time.sleep(0.05)
    write(folder, e__json="[]", f__ndjson="7")
    assert follow() == sorted([*want, ("f.ndjson", 0, "7", None)], key=repr)


def test_fixture_folder(spark, tmp_path):
    write(tmp_path, scenario__yaml="name: s\ndataset:\n  cases:\n    - external_id: z\n    - external_id: a\n")
    write(tmp_path / "cases", b__yaml="- external_id: q\n- external_id: p\n", a__yml="external_id: r\nn: 1\n", c__yaml="x: &y 1\n")
    rows = readers.fixture_cases(spark, str(tmp_path)).collect()
    assert [r.external_id for r in rows] == ["z", "a", "r", "q", "p", None] and "anchors" in rows[-1].error
    assert json.loads(rows[2].record) == {"external_id": "r", "n": 1}
    assert [r.external_id for r in readers.fixture_cases(spark, str(tmp_path), ["p", "z", "p"]).collect()] == ["p", "z", "p"]
    with pytest.raises(KeyError, match="nobody"):
        readers.fixture_cases(spark, str(tmp_path), ["z", "nobody"])
