"""The engine's front door: one object over a run's trials, cases and probability records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.operators import compare, probability, records, summary
from assaykit.operators.compare import Policy
from assaykit.sources import views


@dataclass
class Engine:
    """``trials``: case_id, candidate, repeat_index, status, outcome, latency_ms, category; ``cases``: case_id, cluster_id,
    severity and tags; ``predictions``: probability records. All results are lazy DataFrames."""

    trials: DataFrame
    cases: DataFrame
    predictions: DataFrame | None = None

    @classmethod
    def from_tables(cls, spark: SparkSession, sf_dir: str) -> Engine:
        return cls(views.trials(spark, sf_dir), views.cases(spark, sf_dir), views.probability_records(spark, sf_dir))

    def query(self, metric: str, group_by: str = "candidate", *, slice_key: str | None = None, k: int = 3) -> DataFrame:
        """An ad-hoc metric by candidate, case or slice; a slice key is a column of ``cases``."""
        rows = self.trials
        if group_by == "slice" and slice_key not in rows.columns:
            rows = rows.join(self.cases.select("case_id", slice_key), "case_id")
        return summary.statistics(rows, metric, group_by, slice_column=slice_key, k=k)

    def cells(self) -> DataFrame:
        return summary.cells(self.trials)

    def run_summary(self) -> DataFrame:
        return summary.slot_rates(self.trials).join(summary.case_pass_rate(self.cells()), "candidate")

    def triage(self, **filters) -> DataFrame:
        return summary.triage_filter(summary.triage(self.trials, self.cases), **filters).orderBy(*summary.TRIAGE_ORDER)

    def pairs(self, baseline: str = "baseline", candidate: str = "candidate") -> DataFrame:
        """Cases of two candidates side by side; case content is taken as equal where ``cases`` has no case_hash."""
        content = F.col("case_hash") if "case_hash" in self.cases.columns else F.col("case_id")
        cell = self.cells().join(self.cases.select("case_id", "cluster_id", content.alias("case_hash")), "case_id")
        both = records.pair_cases(cell.where(F.col("candidate") == baseline), cell.where(F.col("candidate") == candidate))
        return both.join(self.cases.select("case_id", "cluster_id"), "case_id")

    def compare(self, baseline: str = "baseline", candidate: str = "candidate", *, resamples: int = 10_000) -> DataFrame:
        units = compare.cluster_units(self.pairs(baseline, candidate).where("pairing = 'paired'"))
        return compare.bootstrap_interval(units, resamples=resamples)

    def gate(self, policy: Policy | None = None, *, baseline: str = "baseline", candidate: str = "candidate", problems: list[str] = (), runs: DataFrame | None = None) -> DataFrame:
        """The release decision on the case pass rate, as one row; trials may list broken invariants (invariant_failures).

        ``runs``: what ``compare.compatibility`` asks of the two runs, with ``baseline`` and ``candidate`` as run_id. Runs that may not
        be compared have no interval, and unfinished ones are a problem."""
        policy = policy or Policy()
        name, pairs = F.lit(candidate).alias("comparison"), self.pairs(baseline, candidate)
        coverage = pairs.agg(name, (F.count_if(F.col("pairing") == "paired") / F.count("*")).alias("coverage"))
        units = compare.cluster_units(pairs.where("pairing = 'paired'"))
        interval = compare.bootstrap_interval(units, resamples=policy.resamples, seed=policy.seed, confidence=policy.confidence)
        found = interval.select(name, F.lit("case_pass_rate").alias("metric"), "lower", "upper", "clusters")
        broken = None
        if "invariant_failures" in self.trials.columns:
            named = self.trials.where(F.col("candidate") == candidate).select(F.explode("invariant_failures").alias("name"))
            broken = named.groupBy("name").agg(F.count("*").alias("n")).select(name, "name", "n")
        said = coverage.select("comparison", F.explode(F.array(*[F.lit(p) for p in problems]).cast("array<string>")).alias("problem"))
        findings = None
        if runs is not None:
            pair = self.trials.sparkSession.range(1).select(name, F.lit(baseline).alias("base_run"), F.lit(candidate).alias("cand_run"))
            findings = compare.compatibility(pair, runs)
            said = said.unionByName(compare.run_problems(pair, runs))
        checks = compare.gate_checks(coverage, found, policy, invariant_failures=broken, problems=said, findings=findings)
        return compare.gate_decision(coverage, checks, policy)

    def quality(self, *keys: str) -> DataFrame:
        return probability.quality(probability.usable(self.predictions), *keys)
