"""Summaries, sources, streams and validation on small tables; every query against DuckDB on the smallest scale."""

import json
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from assaykit.functions import udfs
from assaykit.operators import grading as G
from assaykit.operators import probability as P
from assaykit.operators import records as R
from assaykit.operators import retrieval as T
from assaykit.operators import summary as S
from assaykit.operators import validation
from assaykit.plans import evidence, metrics
from assaykit.sources import export, strict, views
from assaykit.streaming import events

QUERIES, SQL = metrics.QUERIES | evidence.QUERIES, metrics.SQL | evidence.SQL


def normal(v):
    return round(v, 5) if isinstance(v, float) else int(v) if hasattr(v, "as_tuple") and v == int(v) else float(v) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_duckdb(spark, sf_dir, name):
    duck = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        duck.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = duck.sql(SQL[name])
    columns = sorted(want.columns)
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == columns
    key = lambda r: repr([normal(r[c]) for c in columns])
    assert sorted(key(r.asDict()) for r in got.collect()) == sorted(map(key, rows))


def test_agreement_of_six_and_four(spark):
    df = spark.createDataFrame([("c", "x", a) for a in "AAAAAABBBB"] + [("d", "x", "A"), ("e", "x", None)], "case_id string, candidate string, category string")
    r = {x.case_id: x for x in S.repeatability(df).collect()}
    assert (r["c"].modal_agreement, r["c"].pairwise_agreement) == pytest.approx((0.6, 42 / 90)) and r["c"].output_entropy == pytest.approx(0.673011667)
    assert r["d"].modal_agreement is None and r["e"].ineligible == 1 and r["e"].reason


def test_rank_metrics(spark):
    df = spark.createDataFrame([(["a", "c"], {"a": 1, "b": 1, "c": 0}), ([], {"a": 1}), (["x"], {}), (["c", "c", "a"], {"a": 2})], "retrieved array<string>, grades map<string,int>")
    r = T.rank_metrics(df, 2).collect()
    assert (r[0].precision, r[0].recall, r[0].reciprocal_rank) == pytest.approx((1.0, 2 / 3, 1.0))
    assert (r[1].precision, r[1].recall, r[1].reciprocal_rank, r[1].ndcg) == (None, 0.0, 0.0, 0.0)
    assert (r[2].precision, r[2].recall, r[2].ndcg) == (0.0, None, None)
    assert r[3].reciprocal_rank == 0.5


def test_duplicated_fact_counts_once(spark):
    p = spark.createDataFrame([("k", "s", "o")] * 2, "case_id string, s string, o string")
    r = T.match_facts(p, p.limit(1), "case_id", "s", "o").first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall) == (1, 1, 0, 0.5, 1.0) and r.f1 == pytest.approx(2 / 3)


def test_calibration_guards_and_fit(spark):
    rows = [(f"c{n}", "calibration", (n % 10) / 10 + 0.05, int((n * 37) % 100 < 10 * (n % 10) + 5), n) for n in range(400)]
    df = spark.createDataFrame(rows, "cluster_id string, split string, probability double, label int, i int")
    fitted = P.fit_logistic(df)
    assert 2 < fitted.slope < 9
    iso = P.fit_isotonic(df)
    assert list(iso.ys) == sorted(iso.ys)
    for bad, text in ((df.withColumn("split", F.lit("test")), "test split"), (df.where("label = 1"), "both labels"), (df.limit(20), "clusters"), (df.withColumn("label", (F.col("probability") > 0.5).cast("int")), "separated")):
        with pytest.raises(P.Refused, match=text):
            P.fit_logistic(bad)
    with pytest.raises(ValueError):
        P.Calibration("isotonic", xs=(0.1, 0.0), ys=(0.1, 0.2)).validate()


def test_text_helpers(spark):
    df = spark.createDataFrame([("Straße  ＡＢ",), (None,)], "s string")
    assert [r[0] for r in df.select(G.fold(F.col("s"))).collect()] == ["strasse ab", None]
    j = spark.createDataFrame([('{"b": 1.0, "a": [1, "é"]}',), ('{"a": 1, "a": 2}',), ("NaN",), ("1",)], "s string")
    assert [r[0] for r in j.select(udfs.canonical_json()("s")).collect()] == ['{"a":[1,"é"],"b":1.0}', None, None, "1"]
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 2}}, "additionalProperties": False}
    got = spark.createDataFrame([('{"a": 2}',), ('{"a": 1, "b": 2}',), ("[]",), ('{"a": true}',)], "s string").select(udfs.matches_schema(schema)("s").alias("e")).collect()
    assert [len(r.e) for r in got] == [0, 2, 1, 1]
    clean, n = udfs.redact({"api_key": "k", "token": "", "x": ["my abc and abcd"]}, ["abc", "abcd"])
    assert n == 3 and clean == {"api_key": "[REDACTED]", "token": "", "x": ["my [REDACTED] and [REDACTED]"]}


def test_reducers(spark):
    rows = [(1, "g", True, True, True), (1, "h", True, True, None), (2, "g", True, True, None), (2, "h", True, True, False), (3, "g", False, True, None), (3, "h", True, True, True), (4, "g", False, True, None), (4, "h", False, True, None), (5, "g", True, True, True)]
    grades = G.aggregate_checks(spark.createDataFrame(rows, "trial_id int, grader string, applicable boolean, binary boolean, passed boolean"), "trial_id", "grader")
    trials = spark.createDataFrame([(n,) for n in range(1, 7)], "trial_id int")
    got = {r.trial_id: r.outcome for r in G.trial_outcomes(trials, grades, ["g", "h"]).collect()}
    assert got == {1: None, 2: "fail", 3: "pass", 4: None, 5: None, 6: None}


def test_strict_sources(spark, tmp_path):
    files = {"a.json": b'[{"a": 1}, {"b": 2.0}]', "b.jsonl": b'{"x": 1}\n\n{"x": NaN}', "c.yaml": b"a: &x 1\nb: *x", "d.yml": b"a: [1, two]", "e.json": b"\xff", "f.txt": b"x", "g.yaml": b"a: 2020-01-01", "h.json": b'{"a": 1, "a": 2}', "i.yaml": b"a: 1\na: 2"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {}
    for r in strict.read_strict(spark, str(tmp_path)).collect():
        got.setdefault(r.path.rsplit("/", 1)[-1], []).append(r.record or "error: " + r.error)
    assert sorted(got["a.json"]) == ['{"a":1}', '{"b":2.0}'] and got["d.yml"] == ['{"a":[1,"two"]}']
    assert got["b.jsonl"][0].startswith("error: line 3")
    assert all(got[n][0].startswith("error: ") for n in ("c.yaml", "e.json", "f.txt", "g.yaml", "h.json", "i.yaml"))


def test_result_importers(spark):
    a = {"results": {"results": [{"provider": {"id": "m"}, "success": True, "score": 1, "response": {"output": "x"}, "testCase": {"description": "t1"}}, {"provider": "n", "success": False, "response": {"output": {"k": 1}}}, {"provider": "n", "success": False, "error": "boom"}]}}
    b = {"eval": {"model": "m"}, "samples": [{"id": n, "scores": {"s": {"value": v}}, "output": {"completion": "c"}} for n, v in enumerate("CIPN")] + [{"id": "e", "error": {"message": "x"}}]}
    df = spark.createDataFrame([(json.dumps(a),)], "text string")
    assert [(r.external_id, r.provider, r.status) for r in strict.assertion_results(df).orderBy("ordinal").collect()] == [("t1", "m", "pass"), ("1", "n", "fail"), ("2", "n", "error")]
    df = spark.createDataFrame([(json.dumps(b),)], "text string")
    assert [r.status for r in strict.sample_logs(df).orderBy("ordinal").collect()] == ["pass", "fail", "unscored", "unscored", "error"]
    v = spark.createDataFrame([('{"s": {"f": [{"x": 7}]}}',)], "j string").select(strict.reference_path(F.parse_json("j"), "s.f[0].x", "int").alias("a"), strict.reference_path(F.parse_json("j"), "s.g").alias("b")).first()
    assert (v.a, v.b) == (7, None)
    with pytest.raises(ValueError):
        strict.reference_path(F.lit(None), "a..b")


def test_exports_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, t string")
    export.export_tables({"t": df, "u": df}, str(tmp_path / "x"), redact={"u": ["t"]})
    got = export.import_tables(spark, str(tmp_path / "x"))
    assert sorted(map(tuple, got["t"].collect())) == [(1, "a"), (2, None)] and got["u"].columns == ["k"]
    df.limit(1).write.mode("overwrite").parquet(str(tmp_path / "x/t"))
    with pytest.raises(ValueError):
        export.import_tables(spark, str(tmp_path / "x"))
    assert export.append_new(spark, df, str(tmp_path / "log"), "k") == 2
    assert export.append_new(spark, df.unionByName(spark.createDataFrame([(3, "c")], "k int, t string")), str(tmp_path / "log"), "k") == 1
    export.write_jsonl(df, str(tmp_path / "lines"), "k")
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "lines")).collect()) == ['{"k":1,"t":"a"}', '{"k":2,"t":null}']
    a, b = export.orphans(df.selectExpr("cast(k as string) sha256"), spark.createDataFrame([("2",), ("9",)], "sha256 string"))
    assert [r[0] for r in a.collect()] == ["1"] and [r[0] for r in b.collect()] == ["9"]


def test_positions_and_split(spark):
    df = spark.createDataFrame([(f"c{n}",) for n in range(50)], "cluster_id string")
    got = R.cluster_split(df, {"a": 0.6, "b": 0.4}, "7").collect()
    assert sorted(r["rank"] for r in got) == list(range(50)) and sum(r.split == "a" for r in got) == 30


def test_pages_follow_each_other(spark):
    df = spark.createDataFrame([(n % 5, n) for n in range(23)], "s int, k int")
    seen, after = [], None
    while True:
        rows = R.page(df, "s", "k", after=after, size=4).collect()
        seen += [(r.s, r.k) for r in rows[:4]]
        if len(rows) <= 4:
            break
        after = seen[-1]
    assert seen == sorted(((n % 5, n) for n in range(23)), reverse=True)


def test_validation(spark):
    cases = spark.createDataFrame([("a", "c1", "train", ["x"], ["y"], {"k": "1"}), ("a", "c1", "test", ["x"], ["x"], {}), ("b", "c2", "test", ["z"], [], None)], "case_id string, cluster_id string, split string, need array<string>, ban array<string>, tags map<string,string>")
    assert [r.subject for r in validation.repeated(cases, "case_id", "dup").collect()] == ["a"]
    assert [r.subject for r in validation.clusters_across_splits(cases).collect()] == ["c1"]
    assert validation.missing_tags(cases, "tags", ["k"]).first().n == 2
    assert validation.contradictions(cases, "need", "ban", "case_id").count() == 1
    edges = spark.createDataFrame([("g", "a", "b"), ("g", "b", "c"), ("h", "a", "b"), ("h", "b", "a"), ("i", "a", "a"), ("j", "x", "y")], "g string, a string, b string")
    assert sorted(r.subject for r in validation.cyclic(edges, "g", "a", "b").collect()) == ["h", "i"]
    cand = spark.createDataFrame([("x",), ("y",)], "candidate string")
    assert validation.trial_slots(cases.select("case_id").distinct(), cand, 3).count() == 12
    assert {r.trials for r in validation.plan_size(cases.select("case_id").distinct(), cand, 3, F.lit(2)).collect()} == {6}


def test_event_streams_equal_batches(spark, sf_dir, tmp_path):
    log = spark.read.parquet(f"{sf_dir}/events.parquet")
    log.repartition(3).write.parquet(str(tmp_path / "log"))
    stream = events.read_log(spark, str(tmp_path / "log"), log.schema, files_per_trigger=1)
    q = events.rollup(views.run_events(stream)).writeStream.format("memory").queryName("status").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120) is not False
    assert sorted(map(tuple, spark.sql("select * from status").collect())) == sorted(map(tuple, events.rollup(views.run_events(log)).collect()))
    p = spark.createDataFrame([({"status": "x" * 300, "secret": "s"},)], "p map<string,string>").select(events.allowed_payload(F.col("p"))).first()[0]
    assert p == {"status": "x" * 200}


def test_statistics_query(spark, sf_dir):
    from assaykit.sources import views

    t = views.cell_trials(spark, sf_dir).withColumn("kind", views.case_columns()["kind"])
    for metric in S.METRICS:
        assert S.statistics(t, metric).count() == 2
        assert S.statistics(t, metric, "case").count() > 2
    with pytest.raises(ValueError):
        S.statistics(t, "made_up")
