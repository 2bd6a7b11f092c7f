"""The evaluation model read from the driver's tables, by fixed rules that SQL can state too (see ``plans.views_sql``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per case, candidate and repeat, with its status, outcome (pass, fail, null: unresolved) and category."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    order = Window.partitionBy("user_id", "candidate").orderBy("event_id")
    failed = F.col("event_type") == "error"
    return (
        e.withColumn("candidate", F.when(F.col("event_id") % 2 == 0, "baseline").otherwise("candidate"))
        .withColumn("repeat_index", F.row_number().over(order) - 1)
        .select(
            F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("case_id"), "user_id", "candidate", "repeat_index", "event_id",
            F.when(failed, "provider_error").otherwise("success").alias("status"),
            F.when(~failed, F.when(F.col("value") >= 50, "pass").otherwise("fail")).alias("outcome"),
            F.col("value").alias("latency_ms"),
            (F.regexp_extract("props", "([0-9]+)", 1).cast("long") % 5).alias("category"),
        )
    )


def cell_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``trials`` without the repeat index, so without its window: what summaries need."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props")
    failed = F.col("event_type") == "error"
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("case_id"), "user_id", "event_id",
        F.when(F.col("event_id") % 2 == 0, "baseline").otherwise("candidate").alias("candidate"),
        F.when(failed, "provider_error").otherwise("success").alias("status"),
        F.when(~failed, F.when(F.col("value") >= 50, "pass").otherwise("fail")).alias("outcome"),
        F.col("value").alias("latency_ms"),
        (F.regexp_extract("props", "([0-9]+)", 1).cast("long") % 5).alias("category"),
    )


def case_columns(user_id: str = "user_id") -> dict[str, Column]:
    """Attributes of a case, all derived from its id, so that no join is needed where a fact carries it."""
    u = F.col(user_id)
    names = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (u % n + 1).cast("int"))
    return {
        "cluster_id": F.concat(F.lit("c"), (u % 50).cast("string")),
        "severity": names(4, "critical", "high", "medium", "low"),
        "kind": names(3, "short", "long", "mixed"),
    }


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dimension: one row per case."""
    users = read(spark, sf_dir, "events").select("user_id").distinct()
    return users.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("case_id"), "user_id", *[c.alias(k) for k, c in case_columns().items()])


def probability_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with labels; one in 17 lacks its label, one in 19 was labelled before it was predicted, one in 23 has no probability."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    i = F.col("event_id")
    p = F.least(F.lit(1.0), F.col("value") / 300)
    return e.select(
        i.alias("external_id"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("cluster_id"), F.lit("purchase_or_click").alias("event"),
        F.when(i % 3 == 0, "logprob").otherwise("verbal").alias("score_type"),
        F.when(i % 23 != 0, p).alias("probability"),
        F.when(i % 17 != 0, F.col("event_type").isin("purchase", "click").cast("int")).alias("label"),
        i.alias("predicted_at"), F.when(i % 19 == 0, i - 1).otherwise(i + 1).alias("labeled_at"),
        F.when(F.substring(F.sha2(F.concat(F.lit("7:"), F.col("user_id").cast("string")), 256), 1, 1) < "8", "calibration").otherwise("test").alias("split"),
    )


def attempt_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of attempts; unknown (null) for returned items."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_linestatus", "l_quantity")
    return li.select(
        F.col("l_orderkey").alias("trial_id"), F.when(F.col("l_linestatus") == "O", "target").otherwise("judge").alias("kind"),
        F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("amount"), F.when(F.col("l_orderkey") % 2 == 0, "USD").otherwise("EUR").alias("currency"),
        F.col("l_quantity").alias("tokens"), F.col("l_linenumber").alias("attempt_index"),
    )


def facts(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """(case, subject, relation, object) triples: predicted from odd line numbers, reference from even ones; duplicates occur."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return li.where(F.col("l_linenumber") % 2 == (1 if side == "predicted" else 0)).select(
        F.col("l_orderkey").alias("case_id"), F.lit("order").alias("subject"), F.col("l_returnflag").alias("relation"), F.col("l_linestatus").alias("object")
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored answers of language-model trials: documents beside the labels that graders check against."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    return d.select(F.col("doc_id").alias("trial_id"), "text", "lang", "n_chars")


def run_events(events: DataFrame) -> DataFrame:
    """The event table, or its stream, as a run's log: run_id, seq, trial status, whether grading failed, cancel requests."""
    kind, i = F.col("event_type"), F.col("event_id")
    status = F.when(kind == "error", "provider_error").when((kind == "signup") & (i % 50 == 0), "running").otherwise("success")
    return events.select(
        F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run_id"), i.alias("seq"), status.alias("status"),
        ((kind == "view") & (F.col("value") > 180)).alias("grade_error"), ((kind == "purchase") & (F.col("value") > 290)).alias("cancelled"),
    )


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of few bytes that cost much each, dealt evenly to two tasks a core, if their files give fewer. No more than that: each
    task generates the code of its projections anew."""
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= tasks else rows.repartition(tasks)


def graded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials with what the check registry reads: outputs, expectations and scenario, all derived from each event."""
    step = "named_struct('step_id', {}, 'action', {}, 'status', {}, 'context', {}, 'used', i % 50, 'budget', 40L, 'smalltalk', {}, 'unresolved', {}, 'checks', {})"
    none, no_checks = "CAST(NULL AS ARRAY<STRING>)", "CAST(NULL AS ARRAY<BOOLEAN>)"
    recall = step.format("'s1'", "'recall'", "IF(i % 6 = 0, 'error', 'ok')", "concat('About ', upper(t))", "IF(i % 7 = 0, NULL, t)", none, no_checks)
    asserted = step.format("'s2'", "'assert_state'", "IF(i % 11 = 0, 'skipped', 'ok')", "NULL", "NULL", none, "array(true, i % 3 <> 0)")
    rebuild = step.format("'s3'", "'rebuild'", "'ok'", "NULL", "NULL", "IF(i % 2 = 0, array(concat('likes ', t)), array())", no_checks)
    call = "named_struct('tool', {}, 'arguments', {}, 'effects', {}, 'confirmed', {})"
    output = f"""named_struct(
        'text', CASE i % 5 WHEN 0 THEN concat('  ', upper(t), ' ') WHEN 1 THEN concat('{{"label": "', t, '"}}') WHEN 2 THEN concat('I do NOT know  about ', t)
                WHEN 4 THEN concat('key AKIA', i, ' for ', t) END,
        'parsed', CASE i % 4 WHEN 0 THEN concat('{{"n": 1, "facts": [], "s": "', t, '"}}') WHEN 2 THEN '[1]'
                  WHEN 1 THEN concat('{{"n": 1.0, "facts": [{{"subject": "Ü", "relation": "did ", "object": "', t, '"}}]}}') END,
        'refused', i % 31 = 0, 'retrieved_ids', IF(i % 3 = 0, NULL, array(concat('d', i % 7), concat('d', i % 5))),
        'tool_calls', CASE i % 3 WHEN 1 THEN array({call.format("'search'", "'{\"q\": \"x\"}'", none, "NULL")}, {call.format("'delete'", "'{}'", "array('gone')", "i % 2 = 0")})
                      WHEN 2 THEN array({call.format("IF(i % 2 = 0, 'search', t)", "'{\"q\": 1}'", none, "true")}) ELSE array() END,
        'stores', IF(i % 4 = 0, array(), array('main')),
        'facts', IF(i % 4 = 0, array(), array(named_struct('store', 'main', 'claim', concat('U likes ', upper(t)), 'state', 'active', 'source_step', 's1'),
                                             named_struct('store', 'main', 'claim', 'U does not drink tea', 'state', IF(i % 3 = 0, 'active', 'rejected'), 'source_step', NULL))),
        'steps', concat(array({recall}), IF(i % 5 = 1, array({asserted}), array()), IF(i % 5 = 2, array({rebuild}), array())),
        'probability', IF(i % 23 <> 0, 0.5D, NULL), 'base_text', IF(i % 16 = 0, NULL, 'Click'))"""
    spec = "named_struct('relation', 'likes', 'object', {}, 'all', {}, 'affirmative', {})"
    triple = "array(named_struct('subject', 'ü', 'relation', 'Did', 'object', t))"
    expected = f"""named_struct(
        'reference', IF(i % 2 = 0, t, NULL), 'expected_label', IF(i % 3 = 0, 'click', NULL), 'alternatives', array('view'), 'fields', IF(i % 2 = 1, map('n', '1'), NULL),
        'facts', IF(i % 4 = 1, {triple}, NULL), 'no_facts_required', i % 4 = 0, 'forbidden_facts', IF(i % 8 = 1, {triple}, NULL),
        'required_facts', IF(i % 5 = 0, array({spec.format("IF(i % 40 = 0, NULL, t)", none, "true")}), NULL),
        'forbidden_current_facts', IF(i % 5 = 1, array({spec.format("NULL", "array('TEA')", "i % 2 = 0")}), NULL),
        'no_durable_fact', i % 9 = 0, 'recall_excludes', IF(i % 4 = 2, array(named_struct('step', 's1', 'text', 'about CLICK')), NULL),
        'recall_budget', IF(i % 4 = 3, named_struct('step', 's1'), NULL), 'classification_outcome', IF(i % 4 = 1, named_struct('step', 's1', 'outcome', 'view'), NULL),
        'correction', IF(i % 5 = 2, named_struct('store', 'main', 'claim_contains', t), NULL), 'answer_contains', IF(i % 5 = 4, array('KEY'), NULL),
        'answer_contains_any', IF(i % 2 = 0, array('click', 'View'), NULL), 'answer_must_not_contain', IF(i % 3 = 1, array('akia4'), NULL),
        'should_abstain', i % 7 = 2, 'should_refuse', i % 7 = 3, 'relevant_ids', IF(i % 2 = 0, array('d1'), NULL), 'k', IF(i % 82 = 0, 0, 2),
        'required_tools', IF(i % 4 = 1, array('search'), NULL), 'forbidden_tools', IF(i % 8 = 5, array('delete'), NULL), 'forbidden_effects', IF(i % 6 = 1, array('gone'), NULL),
        'must_precede', IF(i % 4 = 2, array(named_struct('first', 'delete', 'then', 'search')), NULL), 'exact_trajectory', IF(i % 10 = 0, array('search', 'delete'), NULL),
        'sensitive_markers', IF(i % 3 = 2, array('akia'), NULL), 'forbidden_outputs', IF(i % 6 = 2, array('not know'), NULL), 'invariance_base', IF(i % 8 = 0, 'b', NULL),
        'invariants', IF(i % 2 = 1, array('no_sensitive_leak', 'no_unauthorized_tool_effect', 'no_sensitive_leak'), IF(i % 10 = 0, array('made_up'), NULL)))"""
    scenario = """named_struct('pack', 'general', 'allowed_labels', array('click', 'View', 'purchase'), 'output_schema', IF(i % 3 = 0, NULL, '{"type": "object", "required": ["n"]}'),
        'tools', array(named_struct('name', 'search', 'arguments_schema', '{"type": "object", "required": ["q"], "properties": {"q": {"type": "string"}}}', 'requires_confirmation', false),
                       named_struct('name', 'delete', 'arguments_schema', NULL, 'requires_confirmation', true)))"""
    e = dealt(read(spark, sf_dir, "events").selectExpr("event_id AS i", "event_type AS t"))
    return e.selectExpr("i AS trial_id", "IF(t = 'error', 'provider_error', 'success') AS status", f"{output} AS output", f"{expected} AS expected", f"{scenario} AS scenario")


def run_log(events: DataFrame) -> DataFrame:
    """The event table, or its stream, as a run's log with several rows a trial: a user's run has seven trials, whose status
    changes with each event; every 37th event is about the run itself."""
    kind, i = F.col("event_type"), F.col("event_id")
    status = F.element_at(F.create_map(*[F.lit(x) for x in ("signup", "pending", "view", "running", "click", "success", "purchase", "success", "error", "provider_error")]), kind)
    run = F.concat(F.lit("r"), F.col("user_id").cast("string"))
    of_run = i % 37 == 0
    return events.select(
        run.alias("run_id"), F.when(~of_run, F.concat(run, F.lit("-"), (i % 7).cast("string"))).alias("trial_id"), i.alias("seq"), F.when(~of_run, status).alias("status"),
        F.coalesce((kind == "purchase") & (F.col("value") > 150), F.lit(False)).alias("grade_error"), F.coalesce(of_run & (kind == "click") & (F.col("value") > 100), F.lit(False)).alias("cancelled"),
    )


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One episode of memory steps an order, a step a line: its kind, store, status and target follow from the line."""
    li = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS episode_id", "CAST(l_linenumber AS INT) AS n", "CAST(l_partkey % 7 AS INT) AS k")
    action = F.element_at(F.array(*[F.lit(x) for x in ("assert", "remember", "approve", "wrong", "recall", "reject", "forget")]), F.col("k") + 1)
    name = lambda c: F.concat(F.lit("s"), c.cast("string"))
    step = F.struct(
        F.col("n").alias("n"), name(F.when(F.col("k") == 6, 1).otherwise(F.col("n"))).alias("id"), action.alias("action"), F.when(F.col("n") % 5 == 0, "other").otherwise("main").alias("store"),
        F.when(F.col("n") % 2 == 1, "candidate").otherwise("accepted").alias("status"), F.when(F.col("k").isin(2, 3, 5, 6), name(F.col("n") - 1)).alias("target"),
        F.when(F.col("k") == 4, F.array(name(F.col("n") - 2))).alias("refs"),
    )
    return li.groupBy("episode_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
