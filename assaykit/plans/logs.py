"""Queries of run logs, archives, whole probability blocks, windows and episodes, each with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaykit.operators import probability as P
from assaykit.operators import records as R
from assaykit.operators import summary as S
from assaykit.operators import validation
from assaykit.plans.views_sql import CELLS, RECORDS, sql
from assaykit.sources import exchange
from assaykit.sources import views as V
from assaykit.streaming import events

QUERIES, SQL = {}, {}


def query(statement: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if statement:
            SQL[f.__name__] = statement
        return f

    return register


_LOG = """log AS (
  SELECT 'r' || user_id AS run_id, CASE WHEN event_id % 37 <> 0 THEN 'r' || user_id || '-' || event_id % 7 END AS trial_id, event_id AS seq, CASE WHEN event_id % 37 <> 0 THEN
           CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running' WHEN 'error' THEN 'provider_error' ELSE 'success' END END AS status,
         event_type = 'purchase' AND value > 150 AS grade_error, event_id % 37 = 0 AND event_type = 'click' AND value > 100 AS cancelled FROM events
), newest AS (
  SELECT * FROM log WHERE trial_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run_id, trial_id ORDER BY seq DESC) = 1
), counted AS (
  SELECT run_id, count_if(status IN ('pending', 'running')) AS open, count_if(status = 'provider_error' OR grade_error) AS bad FROM newest GROUP BY run_id
), asked AS (SELECT run_id, count_if(cancelled) AS asked, count(*) AS events, max(seq) AS last_seq FROM log GROUP BY run_id)"""


@query(sql(_LOG, """SELECT run_id, CASE WHEN open > 0 THEN 'open' WHEN asked > 0 THEN 'cancelled' WHEN bad > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status, events, last_seq
FROM asked LEFT JOIN counted USING (run_id)"""))
def run_log_rollup(spark, sf):
    """Status of each run from the latest status of each of its trials."""
    return events.rollup(V.run_log(V.read(spark, sf, "events")))


_PROJECT = """e AS (SELECT event_id AS i, user_id AS u, event_type AS t FROM events), us AS (SELECT DISTINCT user_id AS u FROM events),
rows AS (
  SELECT DISTINCT 'dataset_versions' AS "table", 'd' || u % 3 AS id, u % 3 AS p FROM us
  UNION ALL SELECT 'cases', 'c' || u, u % 3 FROM us UNION ALL SELECT 'runs', 'r' || u, u % 3 FROM us UNION ALL SELECT 'grading_runs', 'g' || u, u % 3 FROM us
  UNION ALL SELECT 'trials', 't' || i, u % 3 FROM e UNION ALL SELECT 'attempts', 'a' || i, u % 3 FROM e
  UNION ALL SELECT 'grades', 'h' || i, u % 3 FROM e WHERE t <> 'error' UNION ALL SELECT 'reviews', 'v' || i, u % 3 FROM e WHERE t = 'purchase'
  UNION ALL SELECT 'artifact_refs', 'f' || i, u % 3 FROM e WHERE u % 2 = 0 OR u % 5 <> 0)"""


@query(sql(_PROJECT, 'SELECT "table", id FROM rows WHERE p = 1'))
def project_closure(spark, sf):
    """Every row that belongs to one project, table by table, by who owns it."""
    found = exchange.closure(exchange.views(spark, sf), "p1")
    out = None
    for name, df in found.items():
        own = df.select(F.lit(name).alias("table"), "id")
        out = own if out is None else out.unionByName(own)
    return out


_NEW = "CASE WHEN {1} IS NOT NULL THEN regexp_replace(substr(sha256('import-7:{0}:' || {1}), 1, 32), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') END"


def _new(kind: str, old: str) -> str:
    return _NEW.format(kind, old)


@query(f"""WITH e AS (SELECT event_id AS i, user_id AS u, event_type AS t FROM events WHERE user_id % 3 = 1), us AS (SELECT DISTINCT u FROM e), f AS (
  SELECT 'dataset_versions' AS "table", {_new('dataset_versions', "'d1'")} AS id, 'logical_id' AS "column", {_new('dataset_versions/logical', "'logical1'")} AS value
  UNION ALL SELECT 'cases', {_new('cases', "('c' || u)")}, 'dataset_id', {_new('dataset_versions', "'d1'")} FROM us
  UNION ALL SELECT 'runs', {_new('runs', "('r' || u)")}, 'dataset_id', {_new('dataset_versions', "'d1'")} FROM us
  UNION ALL SELECT 'runs', {_new('runs', "('r' || u)")}, 'parent_run_id', CASE WHEN u % 2 = 0 THEN {_new('runs', "('r' || u)")} END FROM us
  UNION ALL SELECT 'grading_runs', {_new('grading_runs', "('g' || u)")}, 'run_id', {_new('runs', "('r' || u)")} FROM us
  UNION ALL SELECT 'trials', {_new('trials', "('t' || i)")}, 'run_id', {_new('runs', "('r' || u)")} FROM e
  UNION ALL SELECT 'trials', {_new('trials', "('t' || i)")}, 'case_id', {_new('cases', "('c' || u)")} FROM e
  UNION ALL SELECT 'trials', {_new('trials', "('t' || i)")}, 'selected_attempt_id', CASE WHEN t <> 'error' THEN {_new('attempts', "('a' || i)")} END FROM e
  UNION ALL SELECT 'attempts', {_new('attempts', "('a' || i)")}, 'trial_id', {_new('trials', "('t' || i)")} FROM e
  UNION ALL SELECT 'grades', {_new('grades', "('h' || i)")}, 'grading_run_id', {_new('grading_runs', "('g' || u)")} FROM e WHERE t <> 'error'
  UNION ALL SELECT 'grades', {_new('grades', "('h' || i)")}, 'trial_id', {_new('trials', "('t' || i)")} FROM e WHERE t <> 'error'
  UNION ALL SELECT 'reviews', {_new('reviews', "('v' || i)")}, 'trial_id', {_new('trials', "('t' || i)")} FROM e WHERE t = 'purchase'
  UNION ALL SELECT 'reviews', {_new('reviews', "('v' || i)")}, 'grade_ids', {_new('grades', "('h' || i)")} FROM e WHERE t = 'purchase'
  UNION ALL SELECT 'artifact_refs', {_new('artifact_refs', "('f' || i)")}, 'entity_id', CASE WHEN u % 2 = 0 THEN {_new('trials', "('t' || i)")} ELSE {_new('attempts', "('a' || i)")} END FROM e WHERE u % 2 = 0 OR u % 5 <> 0)
SELECT * FROM f""")
def import_remap(spark, sf):
    """A project's rows under new ids, every reference of every row."""
    new = exchange.remap(exchange.closure(exchange.views(spark, sf), "p1"), "import-7", "new")
    out = None
    for name, df in new.items():
        columns = [c for c in df.columns if c not in ("id", "project_id", "entity_type")]
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.array_join(c, ",").alias("value") if c == "grade_ids" else F.col(c).alias("value")) for c in columns])
        own = df.select(F.lit(name).alias("table"), "id", F.inline(pairs))
        out = own if out is None else out.unionByName(own)
    return out


@query(sql(RECORDS, """, d AS (SELECT probability AS threshold, count(*) AS n, sum(label) AS y FROM usable GROUP BY probability),
c AS (SELECT threshold, sum(n) OVER w AS accepted, sum(y) OVER w AS hits, sum(n) OVER () AS total FROM d WINDOW w AS (ORDER BY threshold DESC))
SELECT threshold, CAST(accepted AS BIGINT) AS accepted, accepted / total AS coverage, 1 - hits / accepted AS risk FROM c"""))
def risk_coverage_exact(spark, sf):
    """Coverage and risk at every distinct probability."""
    return P.risk_coverage_exact(P.usable(V.probability_records(spark, sf)))


_BLOCK = """, v AS (SELECT *, CASE WHEN score_type = 'logprob' AND external_id % 5 = 0 THEN -1.5 ELSE CASE WHEN external_id % 46 = 0 THEN 0.25 END END AS raw_feature FROM records),
s AS (SELECT *, coalesce(probability, raw_feature) AS p, CASE WHEN coalesce(probability, raw_feature) IS NULL THEN 'no_probability' WHEN label IS NULL THEN 'no_label' WHEN labeled_at < predicted_at THEN 'label_before_prediction' END AS unused FROM v),
q AS (SELECT score_type, p, label, least(9, CAST(floor(p * 10) AS INTEGER)) AS bin FROM s WHERE unused IS NULL),
b AS (SELECT score_type, bin, count(*) AS n, avg(p) AS mp, avg(label) AS r FROM q GROUP BY ALL),
e AS (SELECT score_type, sum(n * abs(mp - r)) / sum(n) AS ece, string_agg(bin || '=' || n, ',' ORDER BY bin) AS bins FROM b GROUP BY ALL),
o AS (SELECT score_type, avg((p - label) * (p - label)) AS brier, count_if(p >= 0.5) / count(*) AS coverage, 1 - sum(CASE WHEN p >= 0.5 THEN label END) / nullif(count_if(p >= 0.5), 0) AS risk, count_if(NOT p BETWEEN 0 AND 1) AS odd FROM q GROUP BY ALL)
SELECT score_type, count(*) AS n_records, count(probability) AS n_predictions, count(label) AS n_labels, round(count(label) / count(*), 9) AS label_coverage,
       count_if(unused = 'no_probability') AS no_probability, count_if(unused = 'no_label') AS no_label, count_if(unused = 'label_before_prediction') AS label_before_prediction, count_if(unused IS NULL) AS n_used,
       count(DISTINCT CASE WHEN unused IS NULL THEN cluster_id END) AS clusters, count_if(unused IS NULL AND label = 1) AS positive, count_if(unused IS NULL AND label = 0) AS negative,
       any_value(CASE WHEN odd > 0 THEN 'raw scores are not probabilities' END) AS raw_reason, round(any_value(CASE WHEN odd = 0 THEN brier END), 9) AS brier, round(any_value(CASE WHEN odd = 0 THEN ece END), 9) AS ece,
       any_value(CASE WHEN odd = 0 THEN bins END) AS bins, round(any_value(CASE WHEN odd = 0 THEN coverage END), 9) AS coverage, round(any_value(CASE WHEN odd = 0 THEN risk END), 9) AS risk,
       any_value(CASE WHEN score_type = 'logprob' THEN NULL END) AS calibrated_brier, 'some records lack the calibration feature ''raw_feature''' AS calibrated_reason
FROM s JOIN o USING (score_type) JOIN e USING (score_type) GROUP BY score_type"""


@query(sql(RECORDS, _BLOCK.replace("any_value(CASE WHEN score_type = 'logprob' THEN NULL END) AS calibrated_brier, ", "")))
def quality_block(spark, sf):
    """All that is said of a set of predictions, by kind of score: coverage, exclusions, classes, scores and their reasons."""
    i = F.col("external_id")
    raw = F.when((F.col("score_type") == "logprob") & (i % 5 == 0), -1.5).when(i % 46 == 0, 0.25)
    rows = V.probability_records(spark, sf).withColumn("raw_feature", raw)
    done = P.quality_block(rows, "score_type", fitted=P.Calibration("logistic", 2.0, -1.0))
    at = lambda c: F.round(F.col(f"raw.{c}"), 9).alias(c)
    bins = F.array_join(F.transform("raw.bins", lambda b: F.concat(b["bin"].cast("string"), F.lit("="), b["n"].cast("string"))), ",")
    return done.select(
        "score_type", "n_records", "n_predictions", "n_labels", F.round("label_coverage", 9).alias("label_coverage"), "no_probability", "no_label", "label_before_prediction", "n_used",
        "clusters", "positive", "negative", "raw_reason", at("brier"), at("ece"), bins.alias("bins"), at("coverage"), at("risk"), "calibrated_reason",
    )


@query("""WITH x AS (SELECT event_id AS trial_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '{"b": 1, "a": "' || event_type || '"}' WHEN 2 THEN '{"a":"' || event_type || '","b":1}' WHEN 3 THEN 'not json' ELSE '{"a": "' || event_type || '", "b": 1.0}' END AS text,
  CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN event_type END AS class, event_type AS t, event_id % 5 AS k FROM events)
SELECT trial_id, 'raw:' || substr(sha256(text), 1, 24) AS raw, CASE WHEN text IS NULL THEN 'no output' END AS raw_reason,
  'json:' || substr(sha256(CASE WHEN k IN (1, 2) THEN '{"a":"' || t || '","b":1}' WHEN k = 4 THEN '{"a":"' || t || '","b":1.0}' END), 1, 24) AS json, CASE WHEN text IS NULL THEN 'no output' WHEN k = 3 THEN 'output is not valid JSON' END AS json_reason,
  CASE WHEN text IS NOT NULL AND class <> '' THEN 'semantic:' || class END AS semantic, CASE WHEN text IS NULL THEN 'no output' WHEN coalesce(class, '') = '' THEN 'no semantic class assigned' END AS semantic_reason FROM x""")
def output_categories(spark, sf):
    """What each output is the same as, in three representations, or why it isn't eligible."""
    x = V.read(spark, sf, "events").selectExpr(
        "event_id AS trial_id",
        """CASE event_id % 5 WHEN 1 THEN concat('{"b": 1, "a": "', event_type, '"}') WHEN 2 THEN concat('{"a":"', event_type, '","b":1}') WHEN 3 THEN 'not json' WHEN 4 THEN concat('{"a": "', event_type, '", "b": 1.0}') END AS text""",
        "CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN event_type END AS class",
    )
    shown = []
    for kind in S.REPRESENTATIONS:
        category, reason = S.output_category(kind, F.col("text"), semantic=F.col("class"))
        shown += [category.alias(kind), reason.alias(f"{kind}_reason")]
    return x.select("trial_id", *shown)


@query("""WITH t AS (SELECT l_orderkey AS o, l_linenumber AS n, CASE WHEN l_linenumber = 3 AND l_orderkey % 10 = 0 THEN 1000 ELSE CAST(l_quantity AS BIGINT) END AS tokens, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, tokens DESC) AS back FROM lineitem),
s AS (SELECT o, n, back, 20 + sum(tokens) OVER (PARTITION BY o ORDER BY back) AS used FROM t WHERE back <= 6),
k AS (SELECT o, coalesce(min(CASE WHEN used > 120 THEN back END), 7) AS stop FROM s GROUP BY o)
SELECT o AS order_key, coalesce(string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) FILTER (WHERE back < stop), '') AS kept FROM s JOIN k USING (o) GROUP BY o""")
def history_window(spark, sf):
    """The last turns, six at most, that fit a budget of 120 tokens with 20 of them taken."""
    tokens = F.when((F.col("l_linenumber") == 3) & (F.col("l_orderkey") % 10 == 0), 1000).otherwise(F.col("l_quantity").cast("long")).cast("long")
    li = V.read(spark, sf, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").cast("int").alias("n"), tokens.alias("tokens")).alias("turn"))
    turns = li.groupBy(F.col("l_orderkey").alias("order_key")).agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    kept = R.tail_window(F.col("turns"), F.lit(20), F.lit(120))
    return turns.select("order_key", F.array_join(F.transform(kept, lambda t: t["n"].cast("string")), ",").alias("kept"))


@query("""WITH s AS (SELECT l_orderkey AS e, l_linenumber AS n, l_partkey % 7 AS k, ['assert', 'remember', 'approve', 'wrong', 'recall', 'reject', 'forget'][l_partkey % 7 + 1] AS action,
    's' || CASE WHEN l_partkey % 7 = 6 THEN 1 ELSE l_linenumber END AS id, CASE WHEN l_linenumber % 5 = 0 THEN 'other' ELSE 'main' END AS store, l_linenumber % 2 = 1 AS candidate,
    CASE WHEN l_partkey % 7 IN (2, 3, 5, 6) THEN 's' || (l_linenumber - 1) END AS target, CASE WHEN l_partkey % 7 = 4 THEN 's' || (l_linenumber - 2) END AS ref,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, id, action) AS pos FROM lineitem),
j AS (SELECT a.e, a.n, a.pos, a.action, a.id, a.store, a.target, a.ref, arg_min(b.action, b.pos) FILTER (WHERE b.id = a.target) AS p_action, arg_min(b.store, b.pos) FILTER (WHERE b.id = a.target) AS p_store,
    arg_min(b.candidate, b.pos) FILTER (WHERE b.id = a.target) AS p_candidate, count_if(b.id = a.id) AS same, count_if(b.id = a.ref) AS there
  FROM s a LEFT JOIN s b ON a.e = b.e AND b.pos < a.pos GROUP BY ALL),
m AS (SELECT e, pos, list_filter([
    CASE WHEN same > 0 THEN 'step ' || pos || ': duplicate id ' || id END, CASE WHEN target IS NOT NULL AND p_action IS NULL THEN 'step ' || pos || ': no earlier step ' || target END,
    CASE WHEN action IN ('approve', 'reject') AND p_action IS NOT NULL AND NOT (p_action = 'assert' AND p_candidate) THEN 'step ' || pos || ': ' || action || ' needs an earlier candidate' END,
    CASE WHEN action IN ('wrong', 'forget') AND p_action NOT IN ('remember', 'assert') THEN 'step ' || pos || ': ' || action || ' needs something remembered or asserted' END,
    CASE WHEN p_store <> store THEN 'step ' || pos || ': target belongs to store ' || p_store END,
    CASE WHEN ref IS NOT NULL AND coalesce(there, 0) = 0 THEN 'step ' || pos || ': reference to ' || ref || ', which isn''t earlier' END], lambda x: x IS NOT NULL) AS told FROM j)
SELECT e AS episode_id, array_to_string(flatten(list(told ORDER BY pos)), '; ') AS errors FROM m GROUP BY e""")
def episode_rules(spark, sf):
    """What is wrong with each episode: targets, candidates, stores, references, ids."""
    return V.episodes(spark, sf).select("episode_id", F.array_join(validation.episode_errors(F.col("steps")), "; ").alias("errors"))


@query(sql(CELLS, """, s AS (SELECT candidate, sum(slots) AS slots, sum(passes) AS p, sum(graded) AS g, sum(completed) AS c, avg(passes / nullif(graded, 0)) AS rate, count_if(graded > 0) AS cases FROM cells GROUP BY candidate),
l AS (SELECT candidate, quantile_cont(latency_ms, 0.5) AS a, quantile_cont(latency_ms, 0.95) AS b, count(latency_ms) AS n FROM trials WHERE status = 'success' GROUP BY candidate),
m AS (SELECT candidate, 'target_completion' AS name, c / slots AS value, slots AS eligible FROM s UNION ALL SELECT candidate, 'grade_coverage', g / c, c FROM s UNION ALL SELECT candidate, 'conditional_pass', p / g, g FROM s
  UNION ALL SELECT candidate, 'observed_success_yield', p / slots, slots FROM s UNION ALL SELECT candidate, 'case_pass_rate', rate, cases FROM s
  UNION ALL SELECT candidate, 'latency_p50', a, n FROM l UNION ALL SELECT candidate, 'latency_p95', b, n FROM l)
SELECT candidate, name, name || '@1' AS definition, round(value, 6) AS value, CAST(eligible AS BIGINT) AS eligible FROM m"""))
def metric_values(spark, sf):
    """The run summary as values of registered metrics."""
    return S.metric_values(V.cell_trials(spark, sf)).select("candidate", "name", "metric.definition", F.round("metric.value", 6).alias("value"), "metric.eligible")
