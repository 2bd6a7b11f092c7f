"""Paired comparison of two candidates: compatibility, independent clusters, bootstrap interval, release gate."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.operators.records import positions

DEGENERATE = 1e-12

#: Statuses of runs that can't be released on.
UNFINISHED = ("cancelled", "cancelling", "failed", "queued", "running")


def _sides(comparisons: DataFrame, runs: DataFrame) -> DataFrame:
    """comparison, and each side's run as the structs b and c."""
    run = F.struct(*[c for c in runs.columns if c != "run_id"])
    side = lambda name: runs.select(F.col("run_id").alias(f"{name}_run"), run.alias(name[0]))
    return comparisons.join(side("base"), "base_run").join(side("cand"), "cand_run")


def compatibility(comparisons: DataFrame, runs: DataFrame) -> DataFrame:
    """comparison, check, ok, blocks_inference: whether the two runs of each comparison may be compared at all.

    ``comparisons``: comparison, base_run, cand_run; ``runs``: run_id, graders (hashes, null if never graded), pass_rule,
    repeats, repeat_mode, scenario, status, demo. Order of graders does not matter; a demo run is noted and blocks nothing.
    """
    same = lambda name: F.col(f"b.{name}").eqNullSafe(F.col(f"c.{name}"))
    checks = {
        "grader_versions": F.coalesce(F.sort_array("b.graders") == F.sort_array("c.graders"), F.lit(False)),
        "pass_rule": same("pass_rule"), "repeat_design": same("repeats") & same("repeat_mode"), "scenario": same("scenario"),
    }
    of = lambda name, ok, blocks: F.struct(F.lit(name).alias("check"), ok.alias("ok"), blocks.alias("blocks_inference"))
    demo = F.when(F.col("b.demo") | F.col("c.demo"), of("demo", F.lit(True), F.lit(False)))
    listed = F.array_compact(F.array(*[of(name, ok, ~ok) for name, ok in checks.items()], demo))
    return _sides(comparisons, runs).select("comparison", F.inline(listed))


def run_problems(comparisons: DataFrame, runs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """comparison, problem: sides whose run has not finished, and experiments whose findings forbid an inference."""
    odd = lambda side, name: F.when(F.col(f"{side}.status").isin(*UNFINISHED), F.concat(F.lit(f"{name} run is "), F.col(f"{side}.status")))
    found = _sides(comparisons, runs).select("comparison", F.explode(F.array_compact(F.array(odd("b", "baseline"), odd("c", "candidate")))).alias("problem"))
    if findings is None:
        return found
    unlike = findings.where("blocks_inference").select("comparison").distinct()
    return found.unionByName(unlike.withColumn("problem", F.lit("experiments are incompatible")))


def cluster_units(pairs: DataFrame, cluster: str = "cluster_id", *, case_weighted: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Numerator and denominator of each cluster's mean difference, from base_rate and cand_rate of its paired cases."""
    d = pairs.where(F.col("base_rate").isNotNull() & F.col("cand_rate").isNotNull()).withColumn("d", F.col("cand_rate") - F.col("base_rate"))
    if case_weighted:
        weight = F.col("weight") if "weight" in d.columns else F.lit(1.0)
        return d.groupBy(*by, cluster).agg(F.sum(F.col("d") * weight).alias("num"), F.sum(weight).alias("den"))
    return d.groupBy(*by, cluster).agg(F.avg("d").alias("num"), F.lit(1.0).alias("den"))


def _draw(seed: int, resample: Column, place: Column, m: Column) -> Column:
    """The cluster drawn: the first eight hex digits of md5(seed:resample:place) modulo their number."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), resample.cast("string"), place.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % m


def bootstrap_interval(
    units: DataFrame, *, resamples: int = 10_000, seed: int = 42, confidence: float = 0.95, cluster: str = "cluster_id",
    least_clusters: int = 2, by: tuple[str, ...] = (), in_row: int = 100_000,
) -> DataFrame:
    """clusters, delta, lower, upper, degenerate, reason, for each value of ``by`` (one row without): whole clusters are
    drawn with replacement, by digests that any engine can repeat.

    Up to ``in_row`` units, which are counted first, go to each task as arrays and a resample is one row: nothing is
    shuffled but one figure a resample. Beyond, resamples x clusters drawn places are joined to the units. A single key
    must have a sum of weights other than 0; fewer than ``least_clusters`` clusters give no limits, and a reason.
    """
    keys = list(by) or ["__all"]
    rows = units.withColumn("digest", F.sha2(F.col(cluster), 256)) if by else units.withColumns({"digest": F.sha2(F.col(cluster), 256), "__all": F.lit(0)})
    numbers = units.sparkSession.range(resamples).withColumnRenamed("id", "r")
    if units.count() <= in_row:
        listed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("digest", cluster, "num", "den"))).alias("all"))
        arrays = listed.select(*keys, F.transform("all", lambda x: x["num"]).alias("nums"), F.transform("all", lambda x: x["den"]).alias("dens"))
        total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
        whole = arrays.withColumns({"clusters": F.size("nums").cast("long"), "delta": F.try_divide(total("nums"), total("dens"))})

        def add(s: Column, j: Column) -> Column:
            u = _draw(seed, F.col("r"), j, F.col("clusters")).cast("int")
            return F.struct((s["n"] + F.get("nums", u)).alias("n"), (s["d"] + F.get("dens", u)).alias("d"))

        places = F.sequence(F.lit(0).cast("long"), F.col("clusters") - 1)
        summed = F.aggregate(places, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d")), add, lambda s: F.try_divide(s["n"], s["d"]))
        stats = numbers.join(F.broadcast(whole)).select(*keys, "clusters", "delta", summed.alias("stat"))
    else:
        place = Window.partitionBy(*keys).orderBy("digest", cluster)
        ranked = rows.withColumn("u", F.row_number().over(place).cast("long") - 1) if by else positions(rows, "digest", cluster, to="u")
        whole = rows.groupBy(*keys).agg(F.count("*").alias("clusters"), F.try_divide(F.sum("num"), F.sum("den")).alias("delta"))
        places = ranked.select(*keys, F.col("u").cast("long").alias("j")).join(whole, keys).join(F.broadcast(numbers))  # as many numbers as resamples
        drawn = places.withColumn("u", _draw(seed, F.col("r"), F.col("j"), F.col("clusters"))).join(ranked.select(*keys, F.col("u").cast("long").alias("u"), "num", "den"), [*keys, "u"])
        stats = drawn.groupBy(*keys, "r", "clusters", "delta").agg(F.try_divide(F.sum("num"), F.sum("den")).alias("stat"))
    tail = (1 - confidence) / 2
    enough = F.col("clusters") >= least_clusters
    found = stats.groupBy(*keys, "clusters", "delta").agg(
        F.percentile("stat", F.lit(tail)).alias("lower"), F.percentile("stat", F.lit(1 - tail)).alias("upper"), (F.max("stat") - F.min("stat") < DEGENERATE).alias("degenerate")
    )
    few = F.when(~enough, F.concat(F.col("clusters").cast("string"), F.lit(f" independent clusters; {least_clusters} are needed"))).when(F.col("clusters") < 20, "fewer than 20 clusters")
    if not by:  # no cluster at all still gives the one row
        one = units.sparkSession.range(1).select(F.lit(0).alias("__all"))
        found = one.join(found, "__all", "left").withColumn("clusters", F.coalesce("clusters", F.lit(0).cast("long")))
    return found.select(*by, "clusters", "delta", *[F.when(enough, F.col(c)).alias(c) for c in ("lower", "upper", "degenerate")], few.alias("reason"))


def bootstrap_exact(
    units: DataFrame, *, resamples: int = 10_000, seed: int = 42, confidence: float = 0.95, cluster: str = "cluster_id", most_clusters: int = 1_000_000
) -> DataFrame:
    """The same interval with NumPy's default generator, whose one stream of draws fixes the figures: lower, upper.

    The units, counted first, go to every task as two arrays; each task walks the stream in blocks of bounded size and
    sums its own resamples. More than ``most_clusters`` clusters are refused: ``bootstrap_interval`` has no such bound.
    """
    import numpy as np

    if resamples < 100:
        raise ValueError("at least 100 resamples")
    if (m := units.count()) > most_clusters:
        raise ValueError(f"{m} clusters; use bootstrap_interval beyond {most_clusters}")
    table = units.orderBy(cluster).select("num", "den").toPandas()
    num, den = table["num"].to_numpy(float), table["den"].to_numpy(float)
    spark = units.sparkSession
    tasks = min(resamples, spark.sparkContext.defaultParallelism)
    block = max(1, 2_000_000 // max(1, m))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = {int(t) for b in batches for t in b["id"]}
        draws = np.random.default_rng(seed)
        for first in range(0, resamples if m and mine else 0, block):
            at = draws.integers(0, m, size=(min(block, resamples - first), m))
            if first // block % tasks in mine:
                yield pd.DataFrame({"stat": num[at].sum(1) / den[at].sum(1)})

    stats = spark.range(0, tasks, 1, tasks).mapInPandas(run, "stat double")
    tail = (1 - confidence) / 2
    return stats.agg(F.percentile("stat", F.lit(tail)).alias("lower"), F.percentile("stat", F.lit(1 - tail)).alias("upper"))


def metric_verdict(low: Column, high: Column, margin: Column, lower_is_better: Column) -> Column:
    """clear if all of the interval is above -margin, blocked if all is below it, else inconclusive."""
    lo, hi = F.when(lower_is_better, -high).otherwise(low), F.when(lower_is_better, -low).otherwise(high)
    return F.when(lo >= -margin, "clear").when(hi < -margin, "blocked").otherwise("inconclusive")


@dataclass(frozen=True)
class GateMetric:
    name: str
    margin: float = 0.0
    required: bool = True
    lower_is_better: bool = False

    def __post_init__(self) -> None:
        if self.margin < 0:
            raise ValueError(f"{self.name}: the margin must not be negative")


@dataclass(frozen=True)
class Policy:
    """What a release needs; the defaults are fixed values."""

    metrics: tuple[GateMetric, ...] = (GateMetric("case_pass_rate", 0.05),)
    critical_invariants: tuple[str, ...] = ()
    least_coverage: float = 1.0
    least_clusters: int = 20
    confidence: float = 0.95
    resamples: int = 10_000
    seed: int = 42


def gate_checks(coverage: DataFrame, intervals: DataFrame, policy: Policy, *, invariant_failures: DataFrame | None = None, problems: DataFrame | None = None, findings: DataFrame | None = None) -> DataFrame:
    """comparison, check, status (clear, blocked, inconclusive, advisory), reason: each rule of the policy on each comparison.

    ``coverage``: comparison, coverage (one row a comparison); ``intervals``: comparison, metric, lower, upper, clusters;
    ``invariant_failures``: comparison, name, n; ``problems``: comparison, problem. Only the policy's invariants block; too
    few clusters, low coverage and problems leave a comparison open; a metric that is not required only advises. With
    ``findings`` (``compatibility``), runs that can't be compared have no interval, whatever was computed, and that as a problem.
    """
    if findings is not None:
        unlike = findings.where("blocks_inference").select("comparison").distinct()
        intervals = intervals.join(unlike, "comparison", "left_anti")
        told = unlike.withColumn("problem", F.lit("experiments are incompatible"))
        problems = told if problems is None else problems.select("comparison", "problem").unionByName(told).distinct()
    row = lambda check, status, reason: [check.alias("check"), status.alias("status"), reason.alias("reason")]
    short = f"paired coverage is below {policy.least_coverage}"
    out = coverage.where(F.col("coverage") < policy.least_coverage).select("comparison", *row(F.lit("paired_coverage"), F.lit("inconclusive"), F.lit(short)))
    if policy.metrics:
        listed = F.array(*[F.struct(F.lit(m.name).alias("metric"), F.lit(float(m.margin)).alias("margin"), F.lit(m.required).alias("required"), F.lit(m.lower_is_better).alias("flip")) for m in policy.metrics])
        rows = coverage.select("comparison", F.inline(listed)).join(intervals, ["comparison", "metric"], "left")
        none, few = F.col("lower").isNull() | F.col("upper").isNull(), F.coalesce("clusters", F.lit(0)) < policy.least_clusters
        status = F.when(none | few, "inconclusive").otherwise(metric_verdict(F.col("lower"), F.col("upper"), F.col("margin"), F.col("flip")))
        why = F.when(none, "no interval").when(few, f"fewer than {policy.least_clusters} independent clusters").when(status == "blocked", "a shown regression").when(status == "inconclusive", "the interval crosses the margin").otherwise("not inferior")
        out = out.unionByName(rows.select("comparison", *row(F.concat(F.lit("metric:"), "metric"), F.when(~F.col("required") & (status != "clear"), "advisory").otherwise(status), why)))
    if policy.critical_invariants:
        names = coverage.select("comparison", F.explode(F.array(*[F.lit(n) for n in policy.critical_invariants])).alias("name"))
        failed = F.lit(0) if invariant_failures is None else F.coalesce("n", F.lit(0))
        rows = names if invariant_failures is None else names.join(invariant_failures, ["comparison", "name"], "left")
        out = out.unionByName(rows.select("comparison", *row(F.concat(F.lit("invariant:"), "name"), F.when(failed > 0, "blocked").otherwise("clear"), F.when(failed > 0, F.concat(failed.cast("string"), F.lit(" failures"))).otherwise("no failure seen"))))
    if problems is not None:
        out = out.unionByName(problems.select("comparison", *row(F.lit("experiment"), F.lit("inconclusive"), F.col("problem"))))
    return out


def gate_decision(coverage: DataFrame, checks: DataFrame, policy: Policy) -> DataFrame:
    """comparison, verdict (ready, blocked, inconclusive), blocked, inconclusive, checks (counts), reasons: the checks that stand
    in the way, in order. A policy without metrics is never ready."""
    stands = F.col("status").isin("blocked", "inconclusive")
    g = checks.groupBy("comparison").agg(
        F.count_if(F.col("status") == "blocked").alias("blocked"), F.count_if(F.col("status") == "inconclusive").alias("inconclusive"), F.count("*").alias("checks"),
        F.sort_array(F.collect_list(F.when(stands, F.concat_ws(": ", "check", "reason")))).alias("reasons"),
    )
    rows = coverage.select("comparison").join(g, "comparison", "left").fillna(0, ["blocked", "inconclusive", "checks"])
    ready = F.lit("ready" if policy.metrics else "inconclusive")
    verdict = F.when(F.col("blocked") > 0, "blocked").when(F.col("inconclusive") > 0, "inconclusive").otherwise(ready)
    return rows.select("comparison", verdict.alias("verdict"), "blocked", "inconclusive", "checks", F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))


def multiplicity(policy: Policy) -> str | None:
    """The caution that goes with several required metrics."""
    n = sum(m.required for m in policy.metrics)
    return f"{n} required metrics: the chance of a false alarm adds up" if n > 1 else None
