"""Run logs that take back, archives, exact ranks and curves, windows and episodes, on rows stated by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaykit.operators import probability as P
from assaykit.operators import records as R
from assaykit.operators import summary as S
from assaykit.operators import validation
from assaykit.sources import exchange, views
from assaykit.streaming import events

LOG = "run_id string, trial_id string, seq long, status string, grade_error boolean, cancelled boolean"


def test_latest_status_of_a_trial_counts(spark):
    rows = [
        ("a", "1", 1, "running", False, False), ("a", "1", 2, "success", False, False), ("b", "1", 1, "success", False, False), ("b", "1", 2, "running", None, None),
        ("c", "1", 5, "success", False, False), ("c", "1", 3, "provider_error", False, False), ("d", "1", 1, "timeout", False, False), ("d", None, 2, None, None, True),
        ("e", "1", 1, "success", True, False), ("f", None, 1, "running", None, None), ("g", "1", 1, "provider_error", False, False), ("g", "1", 2, "success", False, False),
    ]
    df = spark.createDataFrame(rows, LOG)
    got = {r.run_id: (r.status, r.events, r.last_seq) for r in events.rollup(df).collect()}
    assert got == {"a": ("completed", 2, 2), "b": ("open", 2, 2), "c": ("completed", 2, 5), "d": ("cancelled", 2, 2), "e": ("completed_with_errors", 1, 1), "f": ("completed", 1, 1), "g": ("completed", 2, 2)}
    assert events.rollup(df.limit(0)).count() == 0


def test_stream_of_changes_equals_batch(spark, sf_dir, tmp_path):
    log = views.run_log(spark.read.parquet(f"{sf_dir}/events.parquet")).where("run_id < 'r3'")
    shuffled = log.withColumn("part", F.col("seq") % 3)  # later files bring earlier rows too
    for part in range(3):
        shuffled.where(F.col("part") == part).drop("part").coalesce(1).write.parquet(str(tmp_path / f"in/{part}"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = events.follow_runs(stream, str(tmp_path / "kept")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(180) is not False
    assert sorted(map(tuple, events.run_counters(spark, str(tmp_path / "kept")).collect())) == sorted(map(tuple, events.rollup(log).collect()))


def test_ranks_are_exact_at_random_sizes(spark):
    rng = np.random.default_rng(11)
    sizes = [1, 2, 3, 7, 99, 333, 456, 20_000, *rng.integers(2, 3_000, 12).tolist()]
    groups = {i: (rng.lognormal(size=n), rng.integers(0, 9, n).astype(float), np.full(n, 5.0))[i % 3] for i, n in enumerate(sizes)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [(None, 1.0), (None, None)], "g int, v double").repartition(5)
    for small in (0, 100, 10_000):
        got = {r.g: tuple(r)[1:] for r in S.exact_quantiles(df, F.col("v"), ["g"], {"lo": 0.05, "mid": 0.5, "hi": 0.95, "top": 1.0}, small=small).collect()}
        assert set(got) == {*groups, None} and got[None] == (1.0,) * 4
        for k, vs in groups.items():
            assert got[k] == pytest.approx(tuple(np.quantile(vs, [0.05, 0.5, 0.95, 1.0])), rel=1e-12), (small, len(vs))


def test_latency_by_both_ways(spark, sf_dir):
    t = views.cell_trials(spark, sf_dir).withColumn("kind", views.case_columns()["kind"])
    for keys in (("candidate",), ("candidate", "kind"), ()):
        rows = [sorted(map(tuple, S.latency(t, *keys, small=small).collect())) for small in (10**9, 10)]
        assert len(rows[0]) == len(rows[1])
        for a, b in zip(*rows, strict=True):
            assert a[: len(keys)] == b[: len(keys)] and a[len(keys) :] == pytest.approx(b[len(keys) :])


def test_whole_risk_curve(spark):
    rng = np.random.default_rng(2)
    p, y = rng.integers(0, 400, 3_000) / 400, rng.integers(0, 2, 3_000)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)] + [(None, 1)], "probability double, label int")
    for parts in (2, 64):
        got = {r.threshold: (r.accepted, r.coverage, r.risk) for r in P.risk_coverage_exact(df, parts=parts).collect()}
        assert set(got) == set(p.tolist())
        for t, found in got.items():
            taken = p >= t
            assert found == pytest.approx((taken.sum(), taken.mean(), 1 - y[taken].mean()))
    assert P.risk_coverage_exact(df.limit(0)).count() == 0


def test_quality_block_reasons(spark):
    schema = "external_id int, cluster_id string, probability double, raw_feature double, label int, predicted_at int, labeled_at int"
    rows = [(1, "a", 0.8, 1.0, 1, 1, 2), (2, "a", None, 0.25, 0, 1, None), (3, "b", None, None, 1, 1, 2), (4, "b", 0.5, None, None, 1, 2), (5, "c", 0.5, None, 1, 3, 2)]
    df = spark.createDataFrame(rows, schema)
    r = P.quality_block(df, fitted=P.Calibration("logistic", 1.0, 0.0)).first()
    assert (r.n_records, r.n_predictions, r.n_labels, r.label_coverage) == (5, 3, 4, 0.8)
    assert (r.no_probability, r.no_label, r.label_before_prediction, r.n_used, r.clusters, r.positive, r.negative) == (1, 1, 1, 2, 1, 1, 1)
    assert r.raw.brier == pytest.approx((0.2**2 + 0.25**2) / 2) and r.raw.coverage == 0.5 and r.raw.risk == 0 and [(b.bin, b.n) for b in r.raw.bins] == [(2, 1), (8, 1)]
    assert r.calibrated.brier == pytest.approx(((1 - 1 / (1 + np.exp(-1.0))) ** 2 + (1 / (1 + np.exp(-0.25))) ** 2) / 2)
    odd = P.quality_block(df.withColumn("probability", F.lit(None).cast("double")).withColumn("raw_feature", F.lit(2.0)), feature="probability", fitted=P.Calibration("logistic", 1.0, 0.0)).first()
    assert (odd.raw, odd.raw_reason, odd.calibrated) == (None, "raw scores are not probabilities", None) and "lack" in odd.calibrated_reason
    assert P.quality_block(df.where("label is null")).first().raw_reason == "no labelled predictions in this selection"


def test_splits_that_share_a_cluster_are_refused(spark):
    rows = [(i, f"c{i % 40}", "calibration" if i % 2 else "test", (i % 10) / 10, int(i % 3 == 0), 1, 2) for i in range(400)]
    df = spark.createDataFrame(rows, "external_id int, cluster_id string, split string, probability double, label int, predicted_at int, labeled_at int")
    fitted, scores = P.fit_and_evaluate(df, least_clusters=10)
    assert fitted.method == "logistic" and scores.count() == 2
    with pytest.raises(P.Refused, match="both splits"):
        P.fit_and_evaluate(df.withColumn("cluster_id", F.lit("same")), least_clusters=1)
    with pytest.raises(P.Refused, match="must differ"):
        P.fit_and_evaluate(df, fit_split="test")
    with pytest.raises(P.Refused, match="no labelled"):
        P.fit_and_evaluate(df, fit_split="train")


def test_closure_and_import(spark, sf_dir):
    tables = exchange.views(spark, sf_dir)
    kept = exchange.closure(tables, "p2")
    assert exchange.open_references(kept).count() == 0
    new = exchange.remap(kept, "n1", "fresh")
    assert exchange.open_references(new).count() == 0
    for name, df in new.items():
        old = {r.id for r in kept[name].collect()}
        now = [r.id for r in df.collect()]
        assert len(now) == len(set(now)) and not old & set(now)
        unknown = kept[name].where("entity_type = 'poem'").count() if name == "artifact_refs" else 0
        assert len(now) == len(old) - unknown
    again = exchange.remap(kept, "n1", "fresh")["trials"]
    assert new["trials"].exceptAll(again).count() == 0 and new["trials"].select("id").intersect(exchange.remap(kept, "n2", "fresh")["trials"].select("id")).count() == 0
    pairs = {r.old_id: r.new_id for r in exchange.id_map(kept, "n1").where("table = 'trials'").collect()}
    attempts = {pairs[r.trial_id] for r in kept["attempts"].collect()}
    assert attempts == {r.trial_id for r in new["attempts"].collect()}
    with pytest.raises(exchange.ArchiveError, match="attempts.trial_id"):
        exchange.remap(kept | {"trials": kept["trials"].limit(3)}, "n1", "fresh")
    with pytest.raises(exchange.ArchiveError, match="cases: 2 rows"):
        exchange.remap({"dataset_versions": kept["dataset_versions"], "cases": kept["cases"].limit(1).union(kept["cases"].limit(1))}, "n1", "fresh")
    with pytest.raises(exchange.ArchiveError, match="unknown"):
        exchange.closure({"poems": tables["cases"]}, "p2")
    assert all(df.count() == 0 for df in exchange.closure(tables, "none").values())


def test_manifest_hash(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string")
    same = spark.createDataFrame([(None, 2), ("x", 1)], "s string, i int").repartition(3)
    base = exchange.manifest_hash({"t": a})
    assert base == exchange.manifest_hash({"t": same})
    others = [
        {"u": a}, {"t": a.withColumn("i", F.col("i").cast("double"))}, {"t": a.union(a.limit(1))}, {"t": a.limit(1)}, {"t": a.fillna("", ["s"])}, {"t": a, "u": a}, {"t": a.limit(0)},
    ]
    assert len({base, *map(exchange.manifest_hash, others)}) == 8


def test_tail_window(spark):
    turns = [[5, 5], [50, 4, 3], [1] * 9, [100], [], None, [3, 7, None, 2], [9, 9, 9]]
    rows = [(i, None if t is None else [(k, x) for k, x in enumerate(t)]) for i, t in enumerate(turns)]
    df = spark.createDataFrame(rows, "i int, turns array<struct<k: int, tokens: int>>")
    got = {r.i: None if r.w is None else [x.k for x in r.w] for r in df.select("i", R.tail_window(F.col("turns"), F.lit(2), F.lit(20)).alias("w")).collect()}
    assert got == {0: [0, 1], 1: [1, 2], 2: [3, 4, 5, 6, 7, 8], 3: [], 4: [], 5: None, 6: [3], 7: [1, 2]}


def test_episode_errors(spark):
    def step(id_, action, store="main", status=None, target=None, refs=None):
        return (id_, action, store, status, target, refs)

    steps = [
        step("a", "assert", status="candidate"), step("b", "approve", target="a"), step("b", "reject", target="b"), step("c", "wrong", target="b"), step("d", "forget", store="other", target="a"),
        step("e", "approve", target="z"), step("f", "recall", refs=["a", "f"]),
    ]
    df = spark.createDataFrame([(steps,), ([],)], "s array<struct<id: string, action: string, store: string, status: string, target: string, refs: array<string>>>")
    assert [r[0] for r in df.select(validation.episode_errors(F.col("s"))).collect()] == [
        [
            "step 3: duplicate id b", "step 3: reject needs an earlier candidate", "step 4: wrong needs something remembered or asserted", "step 5: target belongs to store main",
            "step 6: no earlier step z", "step 7: reference to f, which isn't earlier",
        ], [],
    ]


def test_output_categories(spark):
    df = spark.createDataFrame([('{"b":1, "a":2}', None), ("x", '{"a": 2, "b": 1}'), ("null", None), ("NaN", ""), (None, "k")], "t string, p string")
    c, why = S.output_category("json", F.col("t"), F.col("p"))
    rows = df.select(c.alias("c"), why.alias("w")).collect()
    assert rows[0].c == rows[1].c and rows[0].c.startswith("json:") and [r.w for r in rows] == [None, None, "output is not valid JSON", "output is not valid JSON", "no output"]
    c, why = S.output_category("semantic", F.col("t"), semantic=F.col("p"))
    assert [tuple(r) for r in df.select(c, why).collect()][3:] == [(None, "no semantic class assigned"), (None, "no output")]
    with pytest.raises(ValueError, match="unknown representation"):
        S.output_category("shape", F.col("t"))


def test_each_reference_is_looked_up_for_itself(spark):
    rows = lambda *xs, schema: spark.createDataFrame(list(xs), schema)
    tables = {
        "runs": rows(("r1", None), ("r2", "r9"), ("r3", "r9"), schema="id string, parent_run_id string"), "trials": rows(("t1", "r1", "c1"), ("t2", "", None), schema="id string, run_id string, case_id string"),
        "artifact_refs": rows(("f1", "trial", "t1"), ("f2", "trial", "t7"), ("f3", "attempt", "a1"), ("f4", "poem", "p"), schema="id string, entity_type string, entity_id string"),
    }
    found = exchange.open_references(tables)
    assert sorted(map(tuple, found.collect())) == [
        ("artifact_refs", "entity_id", "attempts", 1), ("artifact_refs", "entity_id", "trials", 1), ("runs", "parent_run_id", "runs", 2), ("trials", "case_id", "cases", 1),
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Union")[0] and plan.count("Union") == 1  # rows of counts are united, not references
