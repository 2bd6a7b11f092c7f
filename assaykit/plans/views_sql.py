"""The binding views as SQL, for the side that DuckDB runs."""

TRIALS = """trials AS (
  SELECT 'u' || user_id AS case_id, user_id, CASE WHEN event_id % 2 = 0 THEN 'baseline' ELSE 'candidate' END AS candidate,
         row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY event_id) - 1 AS repeat_index, event_id,
         CASE WHEN event_type = 'error' THEN 'provider_error' ELSE 'success' END AS status,
         CASE WHEN event_type = 'error' THEN NULL WHEN value >= 50 THEN 'pass' ELSE 'fail' END AS outcome,
         value AS latency_ms, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 5 AS category
  FROM events)"""

CELLS = (
    TRIALS
    + """, cells AS (
  SELECT case_id, candidate, count(*) AS slots, count_if(outcome = 'pass') AS passes, count_if(outcome = 'fail') AS failures,
         count(outcome) AS graded, count(*) - count(outcome) AS unresolved, count_if(status = 'provider_error') AS problems, count_if(status = 'success') AS completed
  FROM trials GROUP BY case_id, candidate)"""
)

CASES = """cases AS (
  SELECT 'u' || user_id AS case_id, user_id, 'c' || (user_id % 50) AS cluster_id,
         ['critical', 'high', 'medium', 'low'][user_id % 4 + 1] AS severity, ['short', 'long', 'mixed'][user_id % 3 + 1] AS kind
  FROM (SELECT DISTINCT user_id FROM events))"""

RECORDS = """records AS (
  SELECT event_id AS external_id, 'c' || user_id AS cluster_id, 'purchase_or_click' AS event, CASE WHEN event_id % 3 = 0 THEN 'logprob' ELSE 'verbal' END AS score_type,
         CASE WHEN event_id % 23 <> 0 THEN least(1.0::DOUBLE, value / 300) END AS probability,
         CASE WHEN event_id % 17 <> 0 THEN CAST(event_type IN ('purchase', 'click') AS INTEGER) END AS label,
         event_id AS predicted_at, CASE WHEN event_id % 19 = 0 THEN event_id - 1 ELSE event_id + 1 END AS labeled_at,
         CASE WHEN substr(sha256('7:' || user_id), 1, 1) < '8' THEN 'calibration' ELSE 'test' END AS split
  FROM events), usable AS (SELECT * FROM records WHERE probability IS NOT NULL AND label IS NOT NULL AND labeled_at >= predicted_at)"""

COSTS = """attempts AS (
  SELECT l_orderkey AS trial_id, CASE WHEN l_linestatus = 'O' THEN 'target' ELSE 'judge' END AS kind,
         CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS amount, CASE WHEN l_orderkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency,
         l_quantity AS tokens, l_linenumber AS attempt_index FROM lineitem)"""

FACTS = """facts AS (SELECT l_orderkey AS case_id, l_returnflag AS relation, l_linestatus AS object, l_linenumber % 2 = 1 AS predicted, count(*) AS n FROM lineitem GROUP BY ALL)"""


def sql(views: str, body: str) -> str:
    """A statement over the views; a body that starts with a comma adds views of its own."""
    return f"WITH {views}{body}" if body.startswith(",") else f"WITH {views}\n{body}"
