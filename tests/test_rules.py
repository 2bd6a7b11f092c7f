"""Rules whose outcomes are stated here by hand, apart from the SQL beside each query."""

import json

import pytest
from pyspark.sql import functions as F

from assaykit.functions import kernels as K
from assaykit.operators import grading as G
from assaykit.operators import retrieval as T
from assaykit.operators import state_checks as C
from assaykit.operators import summary as S
from assaykit.operators import validation
from assaykit.sources import export, strict


def column(spark, values, build, schema="v string"):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, {schema}")
    return [r[1] for r in df.select("n", build(F.col("v"))).orderBy("n").collect()]


def test_text_is_folded_in_full(spark):
    assert column(spark, ["\nYes\t", "Straße", "ＡＢ\u00a0c", " a\x1fb ", None], G.fold) == ["yes", "strasse", "ab c", "a b", None]
    same = spark.createDataFrame([("\nYes\t", "yes"), ("Straße", "STRASSE"), ("a", "b")], "a string, b string")
    assert [r[0] for r in same.select(G.normalized_match(F.col("a"), F.col("b"))).collect()] == [True, True, False]


def test_abstention_and_refusal(spark):
    texts = ["There is no record of that, I haven't told you", "I am unable to", "It is Tuesday", "Please confirm first", None]
    assert column(spark, texts, lambda c: G.abstains(c)) == [True, True, False, False, False]
    assert column(spark, texts, lambda c: G.abstains(c, should_refuse=True)) == [True, True, False, True, False]


def test_claims(spark):
    texts = ["I don't drink tea", "Drinks TEA daily", "no longer likes tea", "notable tea"]
    assert column(spark, texts, lambda c: G.claim_holds(c, F.array(F.lit("tea")))) == [False, True, False, True]
    assert column(spark, texts, lambda c: G.claim_matches(c, any_of=F.array(F.lit("daily"), F.lit("likes")), affirmative=False)) == [False, True, True, False]
    claims = spark.createDataFrame([(1, "Lives in Paris"), (1, "does not like Tea"), (2, "likes tea")], "t int, claim string")
    wanted = spark.createDataFrame([(1, 0, ["paris"], None, None), (1, 1, ["tea"], None, False), (2, 0, ["tea"], ["green", "black"], True), (3, 0, ["x"], None, True)], "t int, spec int, all_of array<string>, any_of array<string>, affirmative boolean")
    assert {r.t: r.passed for r in C.required_claims(claims, wanted, "t").collect()} == {1: True, 2: False, 3: False}
    assert {r.t: r.passed for r in C.forbidden_claims(claims, wanted, "t").collect()} == {1: False, 2: True, 3: True}


def test_labels(spark):
    texts = ['{"label": "Spam"}', '{"label": "spam"}', '"SPAM"', " spam ", "I think spam", '{"label": 3}', '{"label": "new"}']
    allowed = ["Spam", "ham"]
    assert column(spark, texts, lambda c: G.read_label(c, allowed)) == ["Spam", "spam", "Spam", "Spam", None, None, "new"]
    assert column(spark, texts, lambda c: G.label_match(c, F.array(F.lit("Spam")), allowed)) == [True, False, True, True, False, False, False]


def test_accuracy_gaps(spark):
    gaps = K.accuracy_gaps(*[F.lit(x) for x in (0.95, 0.9, 0.8, 0.75)])
    assert list(spark.range(1).select(*gaps.values()).first()) == pytest.approx([0.05, 0.1, 0.05])


def test_triage_priorities(spark):
    def cell(case, candidate, outcomes, **more):
        return [(case, candidate, n, "success" if o else "timeout", o, more.get("inv", False), more.get("ge", False)) for n, o in enumerate(outcomes)]

    p, f, u = "pass", "fail", None
    rows = sum(
        [
            cell("crit", "baseline", [p, p]), cell("crit", "new", [p, f]), cell("reg", "baseline", [p, p]), cell("reg", "new", [f, f]), cell("open", "baseline", [p, u]), cell("open", "new", [u, u]),
            cell("flaky", "baseline", [p, f]), cell("flaky", "new", [p, p]), cell("wrong", "baseline", [f, f]), cell("wrong", "new", [f, f]), cell("inv", "baseline", [p, p]), cell("inv", "new", [p, u], inv=True),
            cell("seen", "baseline", [f, f]), cell("seen", "new", [f, f]), cell("fine", "baseline", [p]), cell("fine", "new", [p]), cell("ge", "baseline", [f, p], ge=True), cell("ge", "new", [p, p]),
        ],
        [],
    )
    trials = spark.createDataFrame(rows, "case_id string, candidate string, repeat_index int, status string, outcome string, invariant_failed boolean, grading_error boolean")
    cases = spark.createDataFrame([(c, "critical" if c == "crit" else "low") for c in {r[0] for r in rows}], "case_id string, severity string")
    reviews = spark.createDataFrame([("seen", "confirm_failure", 1), ("seen", "ambiguous", 2), ("reg", "confirm_failure", 1)], "case_id string, decision string, created_at int")
    queue = S.triage(trials, cases, "baseline", reviews)
    got = {(r.case_id, r.candidate): r for r in queue.collect()}
    assert {k: r.priority for k, r in got.items()} == {
        ("crit", "new"): 0, ("inv", "new"): 0, ("reg", "new"): 1, ("open", "baseline"): 2, ("open", "new"): 2, ("seen", "baseline"): 2, ("seen", "new"): 2,
        ("ge", "baseline"): 2, ("flaky", "baseline"): 3, ("wrong", "baseline"): 4, ("wrong", "new"): 4,
    }
    assert got["crit", "new"].representative_repeat == 1 and got["open", "baseline"].representative_repeat == 1
    names = lambda **kw: {(r.case_id, r.candidate) for r in S.triage_filter(queue, **kw).collect()}
    assert names(changed=True) == {("crit", "new"), ("reg", "new")}
    assert names(provider_error=True) == {("open", "baseline"), ("open", "new"), ("inv", "new")} and names(grading_error=True) == {("ge", "baseline")}
    assert names(review="confirmed") == {("reg", "new")} and ("crit", "new") in names(review="unreviewed") and len(names(review="other")) == len(got)


def test_importers_statuses(spark):
    items = [{"error": "x", "success": False, "gradingResult": {"pass": False}}, {"error": "x"}, {"success": True, "failureReason": 2}, {"success": True, "error": ""}, {}]
    df = spark.createDataFrame([(json.dumps({"results": items}),)], "text string")
    assert [r.status for r in strict.assertion_results(df).orderBy("ordinal").collect()] == ["fail", "error", "error", "pass", "unscored"]
    scores = [{"a": "C", "b": "I"}, {"a": "N"}, {"a": True}, {"a": 0.7}, {"a": "P", "b": "C"}]
    log = {"eval": {}, "samples": [{"id": n, "scores": {k: {"value": v} for k, v in s.items()}} for n, s in enumerate(scores)]}
    rows = strict.sample_logs(spark.createDataFrame([(json.dumps(log),)], "text string")).orderBy("ordinal").collect()
    assert [r.status for r in rows] == ["fail", "unscored", "pass", "unscored", "pass"] and rows[3].score == 0.7


def test_digests_see_where_nulls_are(spark):
    schema = "a string, b string"
    one, other = (export.digest(spark.createDataFrame([r], schema)) for r in (("x", None), (None, "x")))
    assert one != other and one == export.digest(spark.createDataFrame([("x", None)], schema).select("b", "a"))


def test_titles_are_searched_and_many_candidates_kept(spark):
    corpus = spark.createDataFrame([(1, "tea", "nothing"), (2, "x", "much of my tea can")], "doc_id int, title string, text string")
    hits = T.bm25(spark.createDataFrame([("q", "tea")], "query_id string, text string"), corpus).collect()
    assert {r.doc_id for r in hits} == {1, 2}
    assert column(spark, ["much of my tea can"], T.tokens) == [["tea"]]
    cases = spark.createDataFrame([("c",)], "case_id string")
    assert validation.trial_slots(cases, spark.range(1500).select(F.col("id").cast("string").alias("candidate")), 2).count() == 3000
