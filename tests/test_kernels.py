"""Golden numbers and properties of the Column builders."""

import itertools
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assaykit import registry
from assaykit.functions import kernels as K
from assaykit.functions import udfs
from assaykit.operators import assignment, compare, summary


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{n}") for n, c in enumerate(cols)]).first()


def test_intervals(spark):
    low, high = K.wilson(F.lit(18), F.lit(20))
    zero, full = K.wilson(F.lit(0), F.lit(7)), K.wilson(F.lit(7), F.lit(7))
    r = one(spark, low, high, zero[0], full[1], K.wilson(F.lit(0), F.lit(0))[0], K.zero_failure_bound(F.lit(100)), K.zero_failure_bound(F.lit(298)), K.zero_failure_bound(F.lit(299)), K.posterior(F.lit(18), F.lit(20))[2])
    assert r.c0 == pytest.approx(0.6989663547715129) and r.c1 == pytest.approx(0.9721335187862318)
    assert (r.c2, r.c3, r.c4) == (0.0, 1.0, None)
    assert r.c5 == pytest.approx(0.029513049607039925) and r.c6 > 0.01 > r.c7
    assert r.c8 == pytest.approx(19 / 22)
    assert udfs.beta_quantile(0.025, 19, 3) == pytest.approx(0.69622559, abs=1e-8)
    assert udfs.beta_quantile(0.975, 19, 3) == pytest.approx(0.96951103, abs=1e-8)


def test_repeated_success_is_the_share_of_subsets(spark):
    rows = [(c, n) for n in range(1, 8) for c in range(n + 1)]
    df = spark.createDataFrame(rows, "c int, n int")
    for k in (1, 2, 3, 5):
        for r in df.select("c", "n", K.pass_at_k(F.col("c"), F.col("n"), k).alias("a"), K.pass_all_k(F.col("c"), F.col("n"), k).alias("b")).collect():
            sets = list(itertools.combinations([1] * r.c + [0] * (r.n - r.c), k))
            assert (r.a, r.b) == ((None, None) if not sets else (pytest.approx(sum(map(any, sets)) / len(sets)), pytest.approx(sum(map(all, sets)) / len(sets))))
    r = one(spark, K.pass_at_k(F.lit(8), F.lit(10), 5), K.pass_all_k(F.lit(8), F.lit(10), 5))
    assert r.c0 == 1 and r.c1 == pytest.approx(56 / 252)


def test_probability_scores(spark):
    df = spark.createDataFrame([(0.9, 1), (0.2, 0)], "p double, y int")
    assert df.agg(K.brier(F.col("p"), F.col("y"))).first()[0] == pytest.approx(0.025)
    sure = spark.createDataFrame([(1.0, 0), (0.0, 1)], "p double, y int")
    r = sure.agg(K.exact_log_loss(F.col("p"), F.col("y")).alias("a"), K.log_loss(F.col("p"), F.col("y")).alias("b")).first()
    assert r.a == math.inf and 30 < r.b < math.inf
    bins = spark.createDataFrame([(0.0,), (1.0,), (0.55,), (0.29,)], "p double").select(K.bin_of(F.col("p"), 10)).collect()
    assert [b[0] for b in bins] == [0, 9, 5, 2]
    xs, ys = [0.1, 0.4, 0.4, 0.8], [0.2, 0.3, 0.5, 0.9]
    points = [0.0, 0.1, 0.2, 0.39, 0.4, 0.6, 0.8, 1.0]
    got = spark.createDataFrame([(x,) for x in points], "x double").select(K.interpolate(F.col("x"), xs, ys)).collect()
    assert [g[0] for g in got] == pytest.approx(np.interp(points, xs, ys))


def test_metric_values_are_null_only_with_a_reason(spark):
    for value in (F.lit(None), F.lit(float("nan")), F.lit(float("inf"))):
        v = one(spark, registry.metric_value("brier", value)).c0
        assert v.value is None and v.unavailable_reason == "not available"
    v = one(spark, registry.metric_value("observed_pass_rate", F.lit(0.9), F.lit("unused"), interval=("wilson", 0.95, F.lit(0.7), F.lit(0.97)))).c0
    assert v.unavailable_reason is None and v.definition == "observed_pass_rate@1" and v.uncertainty.lower == 0.7
    with pytest.raises(ValueError):
        registry.check_score_types("brier", "observed_pass_rate")
    assert registry.as_table(spark).count() == len(registry.METRICS)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_assignment_is_best(n, m, seed):
    rng = random.Random(seed)
    score = np.array([[rng.randint(0, 9) / 9 for _ in range(m)] for _ in range(n)])
    got = sum(score[p] for p in assignment.best_assignment(score))
    small, large = min(n, m), max(n, m)
    table = score if n <= m else score.T
    want = max(sum(table[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
    assert got == pytest.approx(want)


def test_weighted_matching(spark):
    df = spark.createDataFrame([("a", [[0.95, 0.2], [0.3, 0.55], [0.9, 0.1]]), ("b", []), ("c", [[0.65]])], "case_id string, similarity array<array<double>>")
    got = {r.case_id: (r.tp, r.fp, r.fn, r.in_review) for r in assignment.match_weighted(df, "case_id", 0.6).collect()}
    assert got == {"a": (1, 2, 1, 0), "b": (0, 0, 0, 0), "c": (1, 0, 0, 1)}


def test_gate_decisions(spark):
    """Expected verdicts follow from the policy's rules: only listed invariants block, and what is unsure stays open."""
    M, P = compare.GateMetric, compare.Policy

    def decide(policy, found, *, coverage=1.0, clusters=25, broken=(), problems=()):
        cover = spark.createDataFrame([("x", coverage)], "comparison string, coverage double")
        rows = [("x", name, float(lo), float(hi), clusters) for name, (lo, hi) in found.items()]
        intervals = spark.createDataFrame(rows, "comparison string, metric string, lower double, upper double, clusters long")
        failures = spark.createDataFrame([("x", n, 1) for n in broken], "comparison string, name string, n long")
        said = spark.createDataFrame([("x", p) for p in problems], "comparison string, problem string")
        return compare.gate_decision(cover, compare.gate_checks(cover, intervals, policy, invariant_failures=failures, problems=said), policy).first()

    one = P((M("pass", 0.02),))
    assert decide(one, {"pass": (-0.01, 0.05)}).verdict == "ready"
    assert decide(one, {"pass": (-0.2, -0.1)}).verdict == "blocked"
    assert decide(one, {"pass": (-0.2, 0.1)}).verdict == "inconclusive"
    assert decide(one, {}).verdict == decide(P(()), {"pass": (0, 1)}).verdict == "inconclusive"
    assert decide(one, {"pass": (0.0, 1.0)}, clusters=19).verdict == "inconclusive"
    assert decide(one, {"pass": (0.0, 1.0)}, broken=["no_leak"]).verdict == "ready"
    assert decide(P((M("pass", 0.02),), critical_invariants=("no_leak",)), {"pass": (0.0, 1.0)}, broken=["no_leak"]).verdict == "blocked"
    assert decide(one, {"pass": (0.0, 1.0)}, coverage=0.99).verdict == "inconclusive"
    r = decide(one, {"pass": (0.0, 1.0)}, problems=["baseline run is running"])
    assert (r.verdict, r.reasons) == ("inconclusive", ["experiment: baseline run is running"])
    assert decide(P((M("cost", 0.1, lower_is_better=True),)), {"cost": (0.5, 0.9)}).verdict == "blocked"
    assert decide(P((M("pass", 0.02), M("x", 0, required=False))), {"pass": (0.0, 1.0), "x": (-1.0, -0.5)}).verdict == "ready"
    assert compare.multiplicity(P((M("a"), M("b")))) and compare.multiplicity(one) is None
    with pytest.raises(ValueError, match="negative"):
        M("pass", -1)


def test_compatibility_and_run_problems(spark):
    schema = "run_id int, graders array<string>, pass_rule string, repeats int, repeat_mode string, scenario string, status string, demo boolean"
    runs = spark.createDataFrame(
        [(1, ["g", "h"], "all", 3, "fresh", "s", "completed", False), (2, ["h", "g"], "all", 3, "fresh", "s", "completed", True),
         (3, None, None, 5, "fresh", "s", "cancelled", False), (4, None, None, 5, "fresh", "t", "completed_with_errors", False)], schema
    )
    pairs = spark.createDataFrame([("a", 1, 2), ("b", 1, 3), ("c", 3, 4)], "comparison string, base_run int, cand_run int")
    found = compare.compatibility(pairs, runs)
    bad = {}
    for r in found.where("blocks_inference").collect():
        bad.setdefault(r.comparison, set()).add(r.check)
    # a run that was never graded matches nothing; null pass rules are equal
    assert bad == {"b": {"grader_versions", "pass_rule", "repeat_design"}, "c": {"grader_versions", "scenario"}}
    assert [(r.comparison, r.ok, r.blocks_inference) for r in found.where("check = 'demo'").collect()] == [("a", True, False)]
    problems = sorted((r.comparison, r.problem) for r in compare.run_problems(pairs, runs, found).collect())
    assert problems == [("b", "candidate run is cancelled"), ("b", "experiments are incompatible"), ("c", "baseline run is cancelled"), ("c", "experiments are incompatible")]


def test_bootstrap(spark):
    same = spark.createDataFrame([(f"c{n}", 0.5, 0.5) for n in range(25)], "cluster_id string, base_rate double, cand_rate double")
    r = compare.bootstrap_interval(compare.cluster_units(same), resamples=200).first()
    assert (r.delta, r.lower, r.upper, r.degenerate, r.reason) == (0, 0, 0, True, None)
    two = spark.createDataFrame([("big", 0.0, 1.0)] * 4 + [("small", 1.0, 0.0)], "cluster_id string, base_rate double, cand_rate double")
    assert compare.bootstrap_interval(compare.cluster_units(two), resamples=200).first().delta == 0
    assert compare.bootstrap_interval(compare.cluster_units(two, case_weighted=True), resamples=200).first().delta == pytest.approx(0.6)
    assert compare.bootstrap_interval(compare.cluster_units(two.where("cluster_id = 'big'"))).first().lower is None
    units = spark.createDataFrame([(f"c{n:02}", (n * 7 % 11) / 11 - 0.4, 1.0 + n % 3) for n in range(30)], "cluster_id string, num double, den double")
    rows = [compare.bootstrap_interval(units, resamples=300, in_row=n).first() for n in (100, 0)]
    assert rows[0][1:4] == pytest.approx(rows[1][1:4])
    halves = units.withColumn("half", F.substring("cluster_id", 3, 1).cast("int") % 2)
    rows = [compare.bootstrap_interval(halves, resamples=300, by=("half",), in_row=n).orderBy("half").collect() for n in (100, 0)]
    assert [r.clusters for r in rows[0]] == [15, 15] and [x for r in rows[0] for x in r[2:5]] == pytest.approx([x for r in rows[1] for x in r[2:5]])
    table = units.toPandas().sort_values("cluster_id")
    at = np.random.default_rng(42).integers(0, 30, size=(10_000, 30))
    stat = table["num"].to_numpy()[at].sum(1) / table["den"].to_numpy()[at].sum(1)
    exact = compare.bootstrap_exact(units).first()
    assert tuple(exact) == pytest.approx(tuple(np.quantile(stat, [0.025, 0.975])))
    none = compare.bootstrap_interval(units.limit(0), resamples=100).first()
    assert (none.clusters, none.delta, none.lower) == (0, None, None)


def test_exact_quantiles(spark):
    rng = np.random.default_rng(7)
    groups = {"a": rng.lognormal(size=5_000).round(2), "b": rng.integers(0, 3, 50).astype(float), None: np.array([4.0]), "e": np.array([])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.lo, r.mid, r.hi) for r in summary.exact_quantiles(df, F.col("v"), ["g"], {"lo": 0.0, "mid": 0.5, "hi": 0.95}).collect()}
    assert set(got) == {"a", "b", None}
    for k, found in got.items():
        assert found == pytest.approx(tuple(np.quantile(groups[k], [0, 0.5, 0.95])))
