"""Queries of summaries, repeatability, costs and probability quality, each with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaykit.functions import kernels as K
from assaykit.operators import probability as P
from assaykit.operators import summary as S
from assaykit.plans.views_sql import CASES, CELLS, COSTS, RECORDS, TRIALS, sql
from assaykit.sources import views as V

QUERIES, SQL = {}, {}
_Z = K.z_value(0.95)


def rounded(*names: str, digits: int = 6):
    return [F.round(F.col(n), digits).alias(n) for n in names]


def query(statement: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if statement:
            SQL[f.__name__] = statement
        return f

    return register


WILSON = f"""
  CASE WHEN graded = 0 THEN NULL WHEN passes = 0 THEN 0.0 ELSE greatest(0.0, (passes / graded + {_Z}*{_Z} / (2.0 * graded) - {_Z} * sqrt(passes / graded * (1 - passes / graded) / graded + {_Z}*{_Z} / (4.0 * graded * graded))) / (1 + {_Z}*{_Z} / graded)) END"""
WILSON_HIGH = WILSON.replace("passes = 0 THEN 0.0", "passes = graded THEN 1.0").replace("greatest(0.0,", "least(1.0,").replace(f"- {_Z} * sqrt", f"+ {_Z} * sqrt")


@query(sql(CELLS, f"""SELECT case_id, candidate, slots, graded, passes, failures, round(passes / nullif(graded, 0), 6) AS pass_rate, round({WILSON}, 6) AS wilson_low, round({WILSON_HIGH}, 6) AS wilson_high FROM cells"""))
def pass_summary_wilson(spark, sf):
    return S.cells(V.cell_trials(spark, sf)).select("case_id", "candidate", "slots", "graded", "passes", "failures", *rounded("pass_rate", "wilson_low", "wilson_high"))


@query(sql(CELLS, "SELECT case_id, candidate, passes > 0 AND failures > 0 AS flaky, graded >= 2 AND passes = 0 AS stable_wrong, graded > 0 AND failures = 0 AND unresolved = 0 AS all_pass FROM cells"))
def flags_flaky_stable_wrong(spark, sf):
    return S.cells(V.cell_trials(spark, sf)).select("case_id", "candidate", "flaky", "stable_wrong", "all_pass")


@query(sql(CELLS, """SELECT candidate, sum(slots)::BIGINT AS slots, sum(graded)::BIGINT AS graded, round(sum(completed) / sum(slots), 6) AS target_completion, round(sum(graded) / sum(completed), 6) AS grade_coverage,
  round(sum(passes) / sum(graded), 6) AS conditional_pass, round(sum(passes) / sum(slots), 6) AS end_to_end_yield FROM cells GROUP BY candidate"""))
def slot_rates(spark, sf):
    return S.slot_rates(V.cell_trials(spark, sf)).select("candidate", "slots", "graded", *rounded("target_completion", "grade_coverage", "conditional_pass", "end_to_end_yield"))


@query(sql(CELLS, "SELECT candidate, round(avg(passes / nullif(graded, 0)), 6) AS case_pass_rate, count(nullif(graded, 0)) AS cases, count_if(graded = 0) AS missing FROM cells GROUP BY candidate"))
def case_pass_rate(spark, sf):
    return S.case_pass_rate(S.cells(V.cell_trials(spark, sf))).select("candidate", *rounded("case_pass_rate"), "cases", "missing")


@query(sql(f"{TRIALS}, {CASES}", """, tagged AS (SELECT t.*, c.severity, c.kind FROM trials t JOIN cases c USING (case_id)),
long AS (SELECT 'severity' AS slice_key, severity AS slice_value, candidate, outcome FROM tagged UNION ALL SELECT 'kind', kind, candidate, outcome FROM tagged)
SELECT slice_key, slice_value, candidate, count(*) AS slots, count_if(outcome = 'pass') AS passes, round(count_if(outcome = 'pass') / nullif(count(outcome), 0), 6) AS pass_rate FROM long GROUP BY ALL"""))
def slice_pass_rate(spark, sf):
    tags = {k: c for k, c in V.case_columns().items() if k != "cluster_id"}
    return S.slices(V.cell_trials(spark, sf), tags).select("slice_key", "slice_value", "candidate", "slots", "passes", *rounded("pass_rate"))


@query(sql(CELLS, "SELECT candidate, round(sum(passes) / sum(graded), 6) AS value FROM cells GROUP BY candidate"))
def statistics_by_candidate(spark, sf):
    return S.statistics(V.cell_trials(spark, sf), "pass_rate").select("candidate", *rounded("value"))


@query(sql(f"{TRIALS}, {CASES}", "SELECT kind, candidate, round(quantile_cont(CASE WHEN status = 'success' THEN latency_ms END, 0.5), 6) AS value FROM trials JOIN cases USING (case_id) GROUP BY ALL"))
def statistics_by_slice(spark, sf):
    t = V.cell_trials(spark, sf).withColumn("kind", V.case_columns()["kind"])
    return S.statistics(t, "latency", "slice", slice_column="kind").select("kind", "candidate", *rounded("value"))


@query(sql(TRIALS, "SELECT candidate, status, count(*) AS n FROM trials GROUP BY ALL"))
def trial_status_counts(spark, sf):
    return V.cell_trials(spark, sf).groupBy("candidate", "status").agg(F.count("*").alias("n"))


@query(sql(TRIALS, "SELECT case_id, candidate, count_if(status = 'provider_error') + count_if(status = 'success' AND category = 4) AS errors FROM trials GROUP BY ALL"))
def error_counts(spark, sf):
    """Trials with a problem, plus those with a grading error (here: category 4)."""
    t = V.cell_trials(spark, sf)
    bad = F.count_if(F.col("status").isin(*S.PROBLEM_STATUSES)) + F.count_if(~F.col("status").isin(*S.PROBLEM_STATUSES) & (F.col("category") == 4))
    return t.groupBy("case_id", "candidate").agg(bad.alias("errors"))


@query(sql(TRIALS, """, named AS (SELECT candidate, unnest(CASE WHEN outcome = 'fail' AND category = 0 THEN ['no_leak', 'no_effect'] WHEN outcome = 'fail' AND category = 1 THEN ['no_leak'] ELSE [] END) AS invariant FROM trials)
SELECT candidate, invariant, count(*) AS failures FROM named GROUP BY ALL"""))
def invariant_failures(spark, sf):
    none = F.array().cast("array<string>")
    names = F.when(F.col("outcome") == "fail", F.when(F.col("category") == 0, F.array(F.lit("no_leak"), F.lit("no_effect"))).when(F.col("category") == 1, F.array(F.lit("no_leak")))).otherwise(none)
    return V.cell_trials(spark, sf).select("candidate", F.explode(names).alias("invariant")).groupBy("candidate", "invariant").agg(F.count("*").alias("failures"))


_REPEAT = sql(TRIALS, """, per AS (SELECT case_id, candidate, category, count(*) AS n FROM trials GROUP BY ALL),
s AS (SELECT case_id, candidate, sum(n) AS m, count(*) AS distinct_outputs, max(n) AS top, sum(n * (n - 1)) AS pairs FROM per GROUP BY ALL)
SELECT s.case_id, s.candidate, m::BIGINT AS comparable, distinct_outputs, {} FROM s JOIN per USING (case_id, candidate) GROUP BY s.case_id, s.candidate, m, distinct_outputs, top, pairs""")


@query(_REPEAT.format("CASE WHEN m >= 2 THEN round(top / m, 6) END AS modal_agreement, CASE WHEN m >= 2 THEN round(pairs / (m * (m - 1)), 6) END AS pairwise_agreement"))
def repeatability_agreement(spark, sf):
    return S.repeatability(V.cell_trials(spark, sf)).select("case_id", "candidate", "comparable", "distinct_outputs", *rounded("modal_agreement", "pairwise_agreement"))


@query(_REPEAT.format("CASE WHEN m >= 2 THEN round(greatest(0.0, -sum(n / m * ln(n / m))), 6) END AS output_entropy"))
def output_entropy(spark, sf):
    return S.repeatability(V.cell_trials(spark, sf)).select("case_id", "candidate", "comparable", "distinct_outputs", *rounded("output_entropy"))


_AT_K = ", ".join(
    f"""CASE WHEN graded >= {k} THEN CASE WHEN graded - passes < {k} THEN 1.0 ELSE 1 - list_product(list_transform(range({k}), lambda i: (graded - passes - i) / (graded - i)::DOUBLE)) END END AS raw_{k},
    CASE WHEN graded >= {k} THEN CASE WHEN passes < {k} THEN 0.0 ELSE list_product(list_transform(range({k}), lambda i: (passes - i) / (graded - i)::DOUBLE)) END END AS all_{k}"""
    for k in (1, 3, 5)
)


@query(sql(CELLS, f"SELECT case_id, candidate, round(raw_1, 6) AS pass_at_1, round(raw_3, 6) AS pass_at_3, round(raw_5, 6) AS pass_at_5 FROM (SELECT *, {_AT_K} FROM cells)"))
def pass_at_k(spark, sf):
    return S.repeated_success(S.cells(V.cell_trials(spark, sf))).select("case_id", "candidate", *rounded("pass_at_1", "pass_at_3", "pass_at_5"))


@query(sql(CELLS, f"SELECT case_id, candidate, round(all_1, 6) AS pass_all_1, round(all_3, 6) AS pass_all_3, round(all_5, 6) AS pass_all_5 FROM (SELECT *, {_AT_K} FROM cells)"))
def pass_all_k(spark, sf):
    return S.repeated_success(S.cells(V.cell_trials(spark, sf))).select("case_id", "candidate", *rounded("pass_all_1", "pass_all_3", "pass_all_5"))


@query(sql(CELLS, "SELECT candidate, sum(problems)::BIGINT AS n, round(1 - pow(0.05, 1 / nullif(sum(problems), 0)), 6) AS bound FROM cells GROUP BY candidate"))
def zero_failure_bound(spark, sf):
    """The bound that as many trials without a failure as there were problems would give."""
    return S.counts(V.cell_trials(spark, sf), "candidate").select("candidate", F.col("problems").alias("n"), F.round(K.zero_failure_bound(F.col("problems")), 6).alias("bound"))


@query(sql(CELLS, "SELECT case_id, candidate, passes + 1.0::DOUBLE AS alpha, failures + 1.0::DOUBLE AS beta, round((passes + 1.0) / (graded + 2.0), 6) AS mean FROM cells"))
def posterior_mean(spark, sf):
    a, b, mean = K.posterior(F.col("passes"), F.col("graded"))
    return S.cells(V.cell_trials(spark, sf)).select("case_id", "candidate", a.alias("alpha"), b.alias("beta"), F.round(mean, 6).alias("mean"))


@query(sql(CELLS, "SELECT candidate, round(1 - pow(1 - sum(passes) / sum(graded), 5), 6) AS at_least_one_of_5, round(pow(sum(passes) / sum(graded), 5), 6) AS all_of_5 FROM cells GROUP BY candidate"))
def independent_success(spark, sf):
    c = S.counts(V.cell_trials(spark, sf), "candidate").withColumn("p", K.rate(F.col("passes"), F.col("graded")))
    return c.select("candidate", F.round(K.at_least_one(F.col("p"), 5), 6).alias("at_least_one_of_5"), F.round(K.all_succeed(F.col("p"), 5), 6).alias("all_of_5"))


@query(sql(CELLS, "SELECT candidate, round(sum(passes / graded * slots) / sum(slots), 6) AS weighted_rate FROM cells WHERE graded > 0 GROUP BY candidate"))
def weighted_mean(spark, sf):
    c = S.cells(V.cell_trials(spark, sf)).where("graded > 0")
    return c.groupBy("candidate").agg(F.round(K.weighted_mean(F.col("pass_rate"), F.col("slots")), 6).alias("weighted_rate"))


@query(sql(TRIALS, """SELECT candidate, count_if(status = 'success') AS n, round(quantile_cont(CASE WHEN status = 'success' THEN latency_ms END, 0.5), 6) AS p50_ms, round(quantile_cont(CASE WHEN status = 'success' THEN latency_ms END, 0.95), 6) AS p95_ms,
  count_if(status = 'provider_error') AS problems FROM trials GROUP BY candidate"""))
def latency_quantiles(spark, sf):
    return S.latency(V.cell_trials(spark, sf), "candidate").select("candidate", "n", *rounded("p50_ms", "p95_ms"), "problems")


@query(sql(COSTS, "SELECT kind, currency, round(sum(amount), 2) AS known, count(*) AS n, count(*) - count(amount) AS unknown, round(count(amount) / count(*), 6) AS coverage, count(amount) = count(*) AS complete FROM attempts GROUP BY ALL"))
def cost_summary(spark, sf):
    return S.costs(V.attempt_costs(spark, sf)).select("kind", "currency", *rounded("known", digits=2), "n", "unknown", *rounded("coverage"), "complete")


@query(sql(f"{COSTS}, {TRIALS}", """SELECT kind, CASE WHEN count(amount) < count(*) THEN 'incomplete cost' WHEN count(DISTINCT currency) <> 1 THEN 'more than one currency' END AS reason,
  CASE WHEN count(amount) = count(*) AND count(DISTINCT currency) = 1 THEN round(sum(amount) / (SELECT count_if(outcome = 'pass') FROM trials), 6) END AS cost_per_success
FROM (SELECT * FROM attempts UNION ALL SELECT trial_id, 'known', amount, 'USD', tokens, attempt_index FROM attempts WHERE amount IS NOT NULL) GROUP BY kind"""))
def cost_per_success(spark, sf):
    a, t = V.attempt_costs(spark, sf), V.cell_trials(spark, sf)
    parts = [(k, a.where(F.col("kind") == k)) for k in ("target", "judge")] + [("known", a.where("amount is not null").withColumn("currency", F.lit("USD")))]
    out = None
    for kind, part in parts:
        row = S.cost_per_success(part, t).select(F.lit(kind).alias("kind"), "reason", *rounded("cost_per_success"))
        out = row if out is None else out.unionByName(row)
    return out


@query(sql(COSTS, """, prices AS (SELECT * FROM (VALUES (0, 'model-*', 3.0, 15.0), (1, 'model-large*', 5.0, 25.0), (2, 'model-small', 0.5, 1.5)) p(ordinal, pattern, price_in, price_out)),
used AS (SELECT trial_id, attempt_index, tokens, ['model-large-2', 'model-small', 'model-x', 'other'][trial_id % 4 + 1] AS model FROM attempts),
hit AS (SELECT model, arg_max(price_in, ordinal) AS pi, arg_max(price_out, ordinal) AS po FROM (SELECT DISTINCT model FROM used) JOIN prices ON model GLOB pattern GROUP BY model)
SELECT u.model, count(*) AS attempts, count(h.pi) AS priced, round(sum((u.tokens * 100 * h.pi + u.tokens * 10 * h.po) / 1e6), 6) AS cost FROM used u LEFT JOIN hit h USING (model) GROUP BY u.model"""))
def price_lookup(spark, sf):
    from assaykit.operators.records import priced

    model = F.element_at(F.array(*[F.lit(x) for x in ("model-large-2", "model-small", "model-x", "other")]), (F.col("trial_id") % 4 + 1).cast("int"))
    used = V.attempt_costs(spark, sf).select("tokens", model.alias("model"))
    done = priced(used, [("model-*", 3.0, 15.0), ("model-large*", 5.0, 25.0), ("model-small", 0.5, 1.5)])
    amount = K.cost(F.col("tokens") * 100, F.col("tokens") * 10, F.col("price_in"), F.col("price_out"))
    return done.groupBy("model").agg(F.count("*").alias("attempts"), F.count("price_in").alias("priced"), F.round(F.sum(amount), 6).alias("cost"))


# probability quality

_SCORES = """round(avg(pow(probability - label, 2)), 6) AS brier"""


@query(sql(RECORDS, f"SELECT split, {_SCORES} FROM usable GROUP BY split"))
def brier(spark, sf):
    return P.quality(P.usable(V.probability_records(spark, sf)), "split").select("split", *rounded("brier"))


_CLIP = "least(greatest(probability, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE)"
_LOG_LOSS = f"round(avg(CASE WHEN label = 1 THEN -ln({_CLIP}) WHEN probability >= 1 - 1e-15::DOUBLE THEN -ln(1 - (1 - 1e-15::DOUBLE)) ELSE -ln(1 - {_CLIP}) END), 5) AS log_loss"


@query(sql(RECORDS, f"SELECT split, {_LOG_LOSS} FROM usable GROUP BY split"))
def log_loss_clipped(spark, sf):
    return P.quality(P.usable(V.probability_records(spark, sf)), "split").select("split", *rounded("log_loss", digits=5))


@query(sql(RECORDS, """SELECT split, score_type, CASE WHEN bool_or(CASE WHEN label = 1 THEN probability ELSE 1 - probability END <= 0) THEN 'infinite' ELSE 'finite' END AS kind,
  round(avg(-ln(nullif(CASE WHEN label = 1 THEN probability ELSE 1 - probability END, 0))), 5) AS mean_where_finite FROM usable GROUP BY ALL"""))
def log_loss_exact(spark, sf):
    u = P.usable(V.probability_records(spark, sf))
    q = F.when(F.col("label") == 1, F.col("probability")).otherwise(1 - F.col("probability"))
    g = u.groupBy("split", "score_type").agg(K.exact_log_loss(F.col("probability"), F.col("label")).alias("x"), F.round(F.avg(-F.log(F.when(q > 0, q))), 5).alias("mean_where_finite"))
    return g.select("split", "score_type", F.when(F.col("x") == float("inf"), "infinite").otherwise("finite").alias("kind"), "mean_where_finite")


_BINS = """, b AS (SELECT least(9, floor(probability * 10))::INTEGER AS bin, count(*) AS n, avg(probability) AS mp, avg(label) AS mo FROM usable GROUP BY 1),
bins AS (SELECT r::INTEGER AS bin, coalesce(n, 0) AS n, mp, mo FROM range(10) t(r) LEFT JOIN b ON r = bin)"""


@query(sql(RECORDS, f"{_BINS} SELECT bin, n, round(mp, 6) AS mean_probability, round(mo, 6) AS observed_rate, round(abs(mp - mo), 6) AS gap FROM bins"))
def calibration_bins(spark, sf):
    return P.calibration_bins(P.usable(V.probability_records(spark, sf))).select("bin", "n", *rounded("mean_probability", "observed_rate", "gap"))


@query(sql(RECORDS, f"{_BINS} SELECT round(sum(n * abs(mp - mo)) / sum(n), 6) AS ece, round(max(abs(mp - mo)), 6) AS max_gap FROM bins"))
def ece(spark, sf):
    return P.expected_calibration_error(P.usable(V.probability_records(spark, sf))).select(*rounded("ece", "max_gap"))


_RISK = """SELECT t AS threshold, count_if(probability >= t) AS accepted, round(count_if(probability >= t) / count(*), 6) AS coverage, round(1 - sum(label) FILTER (WHERE probability >= t) / nullif(count_if(probability >= t), 0), 6) AS risk FROM usable, (SELECT {} AS t) GROUP BY t"""


@query(sql(RECORDS, _RISK.format("0.5::DOUBLE")))
def selective_risk(spark, sf):
    return P.selective_risk(P.usable(V.probability_records(spark, sf)), [0.5]).select("threshold", "accepted", *rounded("coverage", "risk"))


@query(sql(RECORDS, _RISK.format("unnest(range(21)) / 20.0::DOUBLE")))
def risk_coverage_curve(spark, sf):
    return P.selective_risk(P.usable(V.probability_records(spark, sf)), [i / 20 for i in range(21)]).select("threshold", "accepted", *rounded("coverage", "risk"))


@query(sql(RECORDS, "SELECT event, score_type, count(*) AS records, count(label) AS labelled FROM records GROUP BY ALL"))
def probability_events(spark, sf):
    return V.probability_records(spark, sf).groupBy("event", "score_type").agg(F.count("*").alias("records"), F.count("label").alias("labelled"))


@query(sql(RECORDS, "SELECT CASE WHEN probability IS NULL THEN 'no_probability' WHEN label IS NULL THEN 'no_label' WHEN labeled_at < predicted_at THEN 'label_before_prediction' ELSE 'usable' END AS reason, count(*) AS n FROM records GROUP BY 1"))
def excluded_records(spark, sf):
    return P.with_reason(V.probability_records(spark, sf)).groupBy(F.coalesce("reason", F.lit("usable")).alias("reason")).agg(F.count("*").alias("n"))


@query(sql(RECORDS, f"SELECT split, score_type, count(*) AS n, sum(label)::BIGINT AS positives, count(DISTINCT cluster_id) AS clusters, {_SCORES}, {_LOG_LOSS}, round(avg(probability), 6) AS mean_probability, round(avg(label), 6) AS base_rate FROM usable GROUP BY ALL"))
def quality_overview(spark, sf):
    return P.quality(P.usable(V.probability_records(spark, sf)), "split", "score_type").select("split", "score_type", "n", "positives", "clusters", *rounded("brier"), *rounded("log_loss", digits=5), *rounded("mean_probability", "base_rate"))


@query(sql(RECORDS, "SELECT external_id, round(1 / (1 + exp(-(2.5 * probability - 1.25))), 6) AS calibrated FROM usable"))
def calibration_apply_logistic(spark, sf):
    c = P.Calibration("logistic", 2.5, -1.25)
    return P.usable(V.probability_records(spark, sf)).select("external_id", F.round(c.apply(F.col("probability")), 6).alias("calibrated"))


@query(sql(RECORDS, """SELECT external_id, round(CASE WHEN probability <= 0.1 THEN 0.2 WHEN probability < 0.4 THEN 0.2 + (probability - 0.1) * (0.35 - 0.2) / (0.4 - 0.1) WHEN probability < 0.8 THEN 0.35 + (probability - 0.4) * (0.7 - 0.35) / (0.8 - 0.4) ELSE 0.7 END, 9) AS calibrated FROM usable"""))
def calibration_apply_isotonic(spark, sf):
    c = P.Calibration("isotonic", xs=(0.1, 0.4, 0.8), ys=(0.2, 0.35, 0.7))
    return P.usable(V.probability_records(spark, sf)).select("external_id", F.round(c.apply(F.col("probability")), 9).alias("calibrated"))


@query(sql(RECORDS, "SELECT split, count(*) AS n, count(DISTINCT cluster_id) AS clusters, count_if(label = 1) AS pos, count_if(label = 0) AS neg, count(DISTINCT cluster_id) >= 30 AND count_if(label = 1) > 0 AND count_if(label = 0) > 0 AND split <> 'test' AS may_fit FROM usable GROUP BY split"))
def calibration_guard(spark, sf):
    u = P.usable(V.probability_records(spark, sf)).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("cluster_id").alias("clusters"), F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    return u.withColumn("may_fit", (F.col("clusters") >= 30) & (F.col("pos") > 0) & (F.col("neg") > 0) & (F.col("split") != "test"))


@query(None)
def calibration_fit_evaluate(spark, sf):
    """Fitted on the calibration split, scored on the test split; few clusters at the smallest scales are allowed here."""
    u = P.usable(V.probability_records(spark, sf))
    fitted = P.fit_logistic(u.where(F.col("split") == "calibration"), least_clusters=2)
    return P.evaluate(u.where(F.col("split") == "test"), fitted).select("which", "n", *rounded("brier", "log_loss"))


@query(sql(RECORDS, "SELECT cluster_id, count(DISTINCT s) AS splits FROM (SELECT cluster_id, CASE WHEN external_id % 50 = 0 THEN 'test' ELSE split END AS s FROM records) GROUP BY 1 HAVING count(DISTINCT s) > 1"))
def split_leakage(spark, sf):
    r = V.probability_records(spark, sf).withColumn("split", F.when(F.col("external_id") % 50 == 0, "test").otherwise(F.col("split")))
    return P.split_leaks(r)


@query(sql(RECORDS, "SELECT cluster_id, round(sum(ln(greatest(probability, 0.001))), 5) AS total, round(avg(ln(greatest(probability, 0.001))), 6) AS mean, count(*) AS n FROM usable GROUP BY 1"))
def token_logprob_summary(spark, sf):
    u = P.usable(V.probability_records(spark, sf)).withColumn("lp", F.log(F.greatest(F.col("probability"), F.lit(0.001))))
    cols = K.token_logprobs(F.col("lp"))
    return u.groupBy("cluster_id").agg(F.round(cols["total"], 5).alias("total"), F.round(cols["mean"], 6).alias("mean"), cols["n"].alias("n"))


@query(sql(TRIALS, """, p AS (SELECT case_id, category + 1 AS score, count(*) AS n FROM trials GROUP BY ALL), q AS (SELECT case_id, score, n / sum(n) OVER (PARTITION BY case_id) AS p FROM p)
SELECT case_id, round(sum(score * p), 6) AS expected_score FROM q GROUP BY case_id"""))
def geval_expected(spark, sf):
    from pyspark.sql import Window

    p = V.cell_trials(spark, sf).groupBy("case_id", (F.col("category") + 1).alias("score")).agg(F.count("*").alias("n"))
    q = p.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("case_id")))
    return q.groupBy("case_id").agg(F.round(K.expected_score(F.col("score"), F.col("p")), 6).alias("expected_score"))


@query(sql(TRIALS, """, r AS (SELECT case_id, event_id // 2 % 4 AS era, count_if(outcome = 'pass') / nullif(count(outcome), 0) AS rate FROM trials GROUP BY ALL),
w AS (SELECT case_id, max(CASE WHEN era = 0 THEN rate END) AS a, max(CASE WHEN era = 1 THEN rate END) AS b, max(CASE WHEN era = 2 THEN rate END) AS c, max(CASE WHEN era = 3 THEN rate END) AS d FROM r GROUP BY case_id)
SELECT case_id, round(a - b, 6) AS generalization_gap, round(b - c, 6) AS domain_gap, round(c - d, 6) AS temporal_gap FROM w"""))
def accuracy_gaps(spark, sf):
    """Trials are dealt to training, evaluation, first production and later production in turn."""
    t = V.cell_trials(spark, sf)
    era = lambda n: K.rate(F.count_if((F.col("outcome") == "pass") & (F.col("era") == n)), F.count(F.when(F.col("era") == n, F.col("outcome"))))
    w = t.withColumn("era", F.floor(F.col("event_id") / 2) % 4).groupBy("case_id").agg(*[era(n).alias(f"e{n}") for n in range(4)])
    gaps = K.accuracy_gaps(*[F.col(f"e{n}") for n in range(4)])
    return w.select("case_id", *[F.round(v, 6).alias(k) for k, v in gaps.items()])
