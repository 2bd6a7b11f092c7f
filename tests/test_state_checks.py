from pyspark.sql import functions as F

from assaykit.operators import state_checks as C

FACTS = "array(named_struct('subject','A','relation','likes','object','Tea','status','active'), named_struct('subject','A','relation','likes','object','Milk','status','rejected'))"


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_memory_checks(spark):
    facts = F.expr(FACTS)
    steps = lambda *xs: F.array(*[F.struct(F.lit(a).alias("complete"), F.lit(b).alias("passed")) for a, b in xs])
    r = one(spark, d=C.no_durable_fact(facts), e=C.recall_excludes(F.lit("The  TEA"), F.array(F.lit("the tea"))),
            f=C.correction(F.lit(True), F.lit(None).cast("boolean")), g=C.all_steps_passed(steps((True, True), (False, True))), h=C.all_steps_passed(steps((True, True), (True, False))))
    assert tuple(r) == (False, False, False, None, False)


def test_outputs_and_judges(spark):
    fenced = F.lit('```json\n{"label": "x", "probability": 1.5}\n```')
    a, b = C.parse_output(fenced, "label"), C.parse_output(fenced, "probability")
    j, k = C.judge_reply(F.lit('{"pass": true, "reason": "ok"}')), C.judge_reply(F.lit('{"pass": "yes"}'))
    r = one(spark, a=a["label"], b=a["invalid"], c=b["probability"], d=b["invalid"], e=j["verdict"], f=j["error"], g=k["verdict"], h=k["error"], i=C.judge_reply(F.lit("hm"))["error"],
            k=C.field_assertions(F.parse_json(F.lit('{"x": {"y": [1, 2]}, "z": null}')), {"x.y": "[1,2]"}) & ~C.field_assertions(F.parse_json(F.lit('{"a": 1.0}')), {"a": "1"}), l=C.threshold(F.lit(0.5), F.lit(None).cast("double"), F.lit(True)), m=C.threshold(F.lit(0.5), F.lit(0.4), F.lit(False)),
            n=C.fill_template("{a}-{b.c}-{d}", {"a": F.lit(1), "b.c": F.lit("x")}))
    assert tuple(r) == ("x", False, None, True, "pass", None, None, "no boolean pass", "not JSON", True, None, False, "1-x-{d}")
    p = C.pairwise_preference(F.lit("A"), F.lit("A"), F.lit(True))
    q = C.pairwise_preference(F.lit("B"), F.lit("A"), F.lit(True))
    r = one(spark, a=p["outcome"], b=p["inconsistent"], c=q["outcome"], d=q["inconsistent"])
    assert tuple(r) == ("tie", True, "win", False)


def test_invariants_and_promotion(spark):
    checks = spark.createDataFrame([(1, "leak_check", True), (1, "recall_excludes", True), (1, "answer_must_not_contain", None), (1, "forbidden_current_facts", False), (2, "tool_constraints", None)], "t int, check string, passed boolean")
    got = {(r.t, r.invariant): (r.state, r.holds) for r in C.invariants(checks, "t").collect()}
    assert got == {
        (1, "no_sensitive_leak"): ("pass", True), (1, "no_cross_user_leak"): ("unavailable", None), (1, "no_rejected_fact_as_accepted"): ("fail", False),
        (1, "no_retracted_fact_active"): ("fail", False), (2, "no_unauthorized_tool_effect"): ("unavailable", None),
    }
    told = spark.createDataFrame([(1, "no_sensitive_leak"), (2, "no_sensitive_leak"), (2, "no_unauthorized_tool_effect"), (3, "made_up")], "t int, invariant string")
    got = {(r.t, r.invariant): (r.state, r.holds) for r in C.invariants(checks, "t", declared=told).collect()}
    assert got == {(1, "no_sensitive_leak"): ("pass", True), (2, "no_sensitive_leak"): ("unavailable", None), (2, "no_unauthorized_tool_effect"): ("unavailable", None), (3, "made_up"): ("unavailable", None)}
    unused = checks.withColumns({"applicable": F.col("check") != "forbidden_current_facts", "binary": F.lit(True)})
    assert ("no_retracted_fact_active", "fail") not in {(r.invariant, r.state) for r in C.invariants(unused, "t").collect()}
    cases = spark.createDataFrame([("a", "train"), ("b", "train")], "case_id string, split string")
    reviews = spark.createDataFrame([(7, "confirmed"), (8, "acceptable")], "trial_id int, verdict string")
    trials = spark.createDataFrame([(7, "a"), (8, "b")], "trial_id int, case_id string")
    assert sorted((r.case_id, r.split, r.evidence) for r in C.promoted(cases, reviews, trials).collect()) == [("a", "regression", ["7"]), ("b", "train", None)]
