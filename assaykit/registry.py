"""Metric definitions, and metric values that are null only with a reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The type of a metric value, as DDL.
METRIC_VALUE = (
    "value double, unavailable_reason string, numerator double, denominator double, eligible long, missing long, unit string, direction string, definition string, "
    "uncertainty struct<method: string, level: double, lower: double, upper: double>"
)


@dataclass(frozen=True)
class Metric:
    name: str
    unit: str
    direction: str
    score_type: str = "outcome"
    version: int = 1

    @property
    def definition(self) -> str:
        return f"{self.name}@{self.version}"


def _family(score_type: str, direction: str, unit: str, names: str) -> list[Metric]:
    return [Metric(n, unit, direction, score_type) for n in names.split()]


#: The names of metrics, with the kind of score, the better direction and the unit.
METRICS: dict[str, Metric] = {
    m.name: m
    for m in [
        *_family("observed_rate", "higher", "fraction of graded repeats", "observed_pass_rate"),
        *_family("observed_rate", "none", "fraction", "wilson_interval"),
        *_family("posterior_success_probability", "higher", "probability", "beta_posterior"),
        *_family("observed_rate", "lower", "failure probability", "zero_failure_upper_bound"),
        *_family("agreement", "none", "fraction of repeats", "modal_agreement"),
        *_family("agreement", "none", "probability two repeats match", "pairwise_agreement"),
        *_family("entropy", "none", "nats", "output_entropy"),
        *_family("observed_rate", "higher", "probability", "pass_at_k pass_all_k"),
        *_family("distance", "lower", "squared error", "brier"),
        *_family("distance", "lower", "nats", "log_loss_clipped"),
        *_family("distance", "lower", "probability", "ece"),
        *_family("observed_rate", "lower", "error fraction of accepted", "selective_risk"),
        *_family("observed_rate", "higher", "fraction accepted", "coverage"),
        *_family("observed_rate", "higher", "fraction of retrieved", "precision_at_k"),
        *_family("observed_rate", "higher", "fraction of k", "precision_fixed_slots_at_k"),
        *_family("observed_rate", "higher", "fraction of relevant", "recall_at_k"),
        *_family("observed_rate", "higher", "1/rank", "reciprocal_rank"),
        *_family("observed_rate", "higher", "fraction of ideal", "ndcg_at_k"),
        *_family("observed_rate", "higher", "fraction of predicted facts", "fact_precision"),
        *_family("observed_rate", "higher", "fraction of reference facts", "fact_recall"),
        *_family("observed_rate", "higher", "F1", "fact_f1 macro_f1 micro_f1"),
        *_family("observed_rate", "higher", "fraction of claims", "supported_claim_fraction"),
        *_family("observed_rate", "higher", "fraction", "accuracy"),
        *_family("observed_rate", "higher", "fraction of eligible judgements", "win_rate"),
        *_family("observed_rate", "higher", "fraction of scheduled", "target_completion observed_success_yield"),
        *_family("observed_rate", "higher", "fraction of eligible", "grade_coverage"),
        *_family("observed_rate", "higher", "fraction of graded", "conditional_pass"),
        *_family("observed_rate", "higher", "mean per-case pass fraction", "case_pass_rate"),
        *_family("duration", "lower", "ms", "latency_p50 latency_p95"),
        *_family("currency", "lower", "currency", "cost_total"),
        *_family("currency", "lower", "currency / pass", "cost_per_confirmed_success"),
        *_family("observed_rate", "higher", "difference", "paired_delta"),
        *_family("observed_rate", "none", "difference", "accuracy_gap"),
        *_family("token_log_probability", "none", "nats per token", "mean_token_log_probability"),
        *_family("rubric_score", "higher", "rubric points", "geval_expected_score"),
    ]
}


def metric_value(name: str, value: Column, reason: Column | None = None, *, numerator: Column | None = None, denominator: Column | None = None, eligible: Column | None = None, missing: Column | None = None, interval: tuple[str, float, Column, Column] | None = None) -> Column:
    """A ``METRIC_VALUE`` struct. A value that is null or not finite becomes null, and a null always has a reason."""
    m = METRICS[name]
    none = lambda kind: F.lit(None).cast(kind)
    value = value.cast("double")
    finite = F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), value)
    why = F.when(finite.isNull(), F.coalesce(none("string") if reason is None else reason, F.lit("not available")))
    spread = none("struct<method:string,level:double,lower:double,upper:double>")
    if interval is not None:
        method, level, lower, upper = interval
        spread = F.when(finite.isNotNull(), F.struct(F.lit(method).alias("method"), F.lit(level).alias("level"), lower.alias("lower"), upper.alias("upper")))
    cast = lambda c, kind: none(kind) if c is None else c.cast(kind)
    return F.struct(
        finite.alias("value"), why.alias("unavailable_reason"), cast(numerator, "double").alias("numerator"), cast(denominator, "double").alias("denominator"), cast(eligible, "long").alias("eligible"),
        cast(missing, "long").alias("missing"), F.lit(m.unit).alias("unit"), F.lit(m.direction).alias("direction"), F.lit(m.definition).alias("definition"), spread.alias("uncertainty"),
    )


def check_score_types(*names: str) -> None:
    """Metrics about different kinds of scores don't go into one figure."""
    kinds = {METRICS[n].score_type for n in names}
    if len(kinds) > 1:
        raise ValueError(f"score types do not mix: {sorted(kinds)}")


def as_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m.name, m.version, m.unit, m.direction, m.score_type) for m in METRICS.values()], "name string, version int, unit string, direction string, score_type string")
