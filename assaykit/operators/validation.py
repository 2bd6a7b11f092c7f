"""Checks of datasets and run plans, as queries that return the violations; none returned means valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def repeated(rows: DataFrame, key: str, rule: str, level: str = "error") -> DataFrame:
    """Keys that occur more than once."""
    g = rows.groupBy(F.col(key).cast("string").alias("subject")).agg(F.count("*").alias("n")).where("n > 1")
    return g.select(F.lit(rule).alias("rule"), F.lit(level).alias("level"), "subject", "n")


def clusters_across_splits(cases: DataFrame) -> DataFrame:
    g = cases.groupBy(F.col("cluster_id").alias("subject")).agg(F.count_distinct("split").alias("n")).where("n > 1")
    return g.select(F.lit("cluster in several splits").alias("rule"), F.lit("error").alias("level"), "subject", "n")


def unknown_references(rows: DataFrame, reference: str, known: DataFrame, key: str, rule: str) -> DataFrame:
    """Referenced values that do not exist: labels not allowed, documents not in the corpus, tools not declared."""
    used = rows.groupBy(F.col(reference).alias("subject")).agg(F.count("*").alias("n")).where("subject is not null")
    return used.join(known.select(F.col(key).alias("subject")).distinct(), "subject", "left_anti").select(F.lit(rule).alias("rule"), F.lit("error").alias("level"), F.col("subject").cast("string").alias("subject"), "n")


def missing_tags(cases: DataFrame, tags: str, keys: list[str]) -> DataFrame:
    """Slice keys that cases lack."""
    lacking = F.array_except(F.array(*[F.lit(k) for k in keys]), F.coalesce(F.map_keys(tags), F.array().cast("array<string>")))
    return cases.select(F.explode(lacking).alias("subject")).groupBy("subject").agg(F.count("*").alias("n")).select(F.lit("missing slice tag").alias("rule"), F.lit("warning").alias("level"), "subject", "n")


def contradictions(cases: DataFrame, required: str, forbidden: str, key: str) -> DataFrame:
    """Cases that require what they forbid."""
    both = F.size(F.array_intersect(required, forbidden))
    return cases.where(both > 0).select(F.lit("required and forbidden").alias("rule"), F.lit("error").alias("level"), F.col(key).cast("string").alias("subject"), both.cast("long").alias("n"))


def cyclic(edges: DataFrame, group: str, first: str, then: str) -> DataFrame:
    """Groups whose order pairs (``first`` before ``then``) form a cycle or a loop.

    Nodes without a predecessor are peeled off until none is left to peel; what remains lies on or behind a cycle. The pairs of a group are few; groups are checked together.
    """
    left = edges.select(F.col(group).alias("g"), F.col(first).alias("a"), F.col(then).alias("b")).distinct()
    before = left.count()
    while before:
        targets = left.select("g", F.col("b").alias("a")).distinct()
        left = left.join(targets, ["g", "a"], "left_semi")
        now = left.count()
        if now == before:
            break
        before = now
    return left.groupBy("g").agg(F.count("*").alias("n")).select(F.lit("cyclic order").alias("rule"), F.lit("error").alias("level"), F.col("g").cast("string").alias("subject"), "n")


def plan_size(cases: DataFrame, candidates: DataFrame, repeats: int, calls_per_trial: Column) -> DataFrame:
    """Trials and calls that a run would make, by candidate: counted, not enumerated."""
    per_case = cases.agg(F.count("*").alias("cases"), F.sum(calls_per_trial).alias("calls"))
    return candidates.join(F.broadcast(per_case)).select("candidate", (F.col("cases") * repeats).alias("trials"), (F.col("calls") * repeats).alias("calls"))


def trial_slots(cases: DataFrame, candidates: DataFrame, repeats: int) -> DataFrame:
    """One row per case, candidate and repeat. The candidates are attached to each case in its row if there are at most
    1,000, else by a product with them, which is what was asked for."""
    names = [r[0] for r in candidates.select("candidate").distinct().orderBy("candidate").limit(1001).collect()]
    if len(names) <= 1000:
        each = cases.select("case_id", F.explode(F.array(*[F.lit(n) for n in names]).cast("array<string>")).alias("candidate"))
    else:
        each = cases.select("case_id").crossJoin(candidates.select("candidate").distinct())
    return each.select("case_id", "candidate", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat_index"))


def episode_errors(steps: Column) -> Column:
    """What is wrong with an episode, as texts in the order of its steps.

    ``steps``: array of struct<id, action, store, status, target, refs>. A target must be an earlier step of the same store; only an
    earlier candidate can be approved or rejected, only something remembered or asserted be called wrong or forgotten; what
    a step refers to must come before it; ids are unique, and the first step of an id is the one that counts.
    """

    def of(step: Column, at: Column) -> Column:
        earlier = F.slice(steps, 1, at)
        prior = F.get(F.filter(earlier, lambda x: x["id"] == step["target"]), F.lit(0))
        aimed, found = step["target"].isNotNull(), prior["id"].isNotNull()
        candidate = (prior["action"] == "assert") & F.coalesce(prior["status"] == "candidate", F.lit(False))
        place = F.concat(F.lit("step "), (at + 1).cast("string"), F.lit(": "))
        told = [
            F.when(F.exists(earlier, lambda x: x["id"] == step["id"]), F.concat(place, F.lit("duplicate id "), step["id"])),
            F.when(aimed & ~found, F.concat(place, F.lit("no earlier step "), step["target"])),
            F.when(found & step["action"].isin("approve", "reject") & ~candidate, F.concat(place, step["action"], F.lit(" needs an earlier candidate"))),
            F.when(found & step["action"].isin("wrong", "forget") & ~prior["action"].isin("remember", "assert"), F.concat(place, step["action"], F.lit(" needs something remembered or asserted"))),
            F.when(found & ~prior["store"].eqNullSafe(step["store"]), F.concat(place, F.lit("target belongs to store "), F.coalesce(prior["store"], F.lit("none")))),
        ]
        lost = F.filter(F.coalesce(step["refs"], F.array().cast("array<string>")), lambda r: ~F.exists(earlier, lambda x: x["id"] == r))
        return F.concat(F.filter(F.array(*told), lambda x: x.isNotNull()), F.transform(lost, lambda r: F.concat(place, F.lit("reference to "), r, F.lit(", which isn't earlier"))))

    return F.flatten(F.transform(steps, of))
