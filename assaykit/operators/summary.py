"""Summaries of trials: per cell (case and candidate) first, then over cases, candidates and slices.

All take a trials table with case_id, candidate, status, outcome (pass, fail, null) and combine before they shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaykit.functions import kernels as K
from assaykit.functions.udfs import canonical_json
from assaykit.registry import metric_value

#: Trial statuses that end with an output, and those that count as problems.
OUTPUT_STATUSES = ("success", "invalid_output")
PROBLEM_STATUSES = ("provider_error", "timeout", "budget_exceeded", "interrupted", "cancelled", "failed")


def n_outcome(outcome: str) -> Column:
    return F.count_if(F.col("outcome") == outcome)


def counts(trials: DataFrame, *keys: str) -> DataFrame:
    """slots, graded, passes, failures, unresolved, problems and completed by ``keys``: the one shuffle of a summary."""
    g = trials.groupBy(*keys).agg(
        F.count("*").alias("slots"), n_outcome("pass").alias("passes"), n_outcome("fail").alias("failures"),
        F.count_if(F.col("status").isin(*PROBLEM_STATUSES)).alias("problems"), F.count_if(F.col("status").isin(*OUTPUT_STATUSES)).alias("completed"),
    )
    return g.withColumns({"graded": F.col("passes") + F.col("failures"), "unresolved": F.col("slots") - F.col("passes") - F.col("failures")})


def cells(trials: DataFrame) -> DataFrame:
    """One row per case and candidate with rate, Wilson interval and flags; a cell without graded trials has null rate and a reason."""
    c = counts(trials, "case_id", "candidate")
    low, high = K.wilson(F.col("passes"), F.col("graded"))
    return c.withColumns(
        {
            "pass_rate": K.rate(F.col("passes"), F.col("graded")), "wilson_low": low, "wilson_high": high,
            "reason": F.when(F.col("graded") == 0, "no graded trials"),
            "flaky": (F.col("passes") > 0) & (F.col("failures") > 0),
            "stable_wrong": (F.col("graded") >= 2) & (F.col("passes") == 0),
            "all_pass": (F.col("graded") > 0) & (F.col("failures") == 0) & (F.col("unresolved") == 0),
        }
    )


def slot_rates(trials: DataFrame) -> DataFrame:
    """Completion, coverage, conditional pass rate and yield of each candidate's slots."""
    c = counts(trials, "candidate")
    return c.withColumns(
        {
            "target_completion": K.rate(F.col("completed"), F.col("slots")), "grade_coverage": K.rate(F.col("graded"), F.col("completed")),
            "conditional_pass": K.rate(F.col("passes"), F.col("graded")), "end_to_end_yield": K.rate(F.col("passes"), F.col("slots")),
        }
    )


def case_pass_rate(cell: DataFrame) -> DataFrame:
    """Mean over cases of each case's own pass rate; cases without graded trials count as missing."""
    return cell.groupBy("candidate").agg(F.avg("pass_rate").alias("case_pass_rate"), F.count("pass_rate").alias("cases"), F.count_if(F.col("pass_rate").isNull()).alias("missing"))


def metric_values(trials: DataFrame) -> DataFrame:
    """The run summary as metric values: candidate, name and ``metric``, a value with its numerator, denominator, counts, unit,
    direction and definition, or null with a reason. One row a candidate and metric."""
    slots, cells_ = counts(trials, "candidate"), counts(trials, "case_id", "candidate")
    by_case = cells_.withColumn("rate", K.rate(F.col("passes"), F.col("graded"))).groupBy("candidate").agg(F.avg("rate").alias("case_rate"), F.count("rate").alias("cases"), F.count_if(F.col("rate").isNull()).alias("ungraded"))
    rows = slots.join(by_case, "candidate").join(latency(trials, "candidate").drop("problems"), "candidate")
    low, high = K.wilson(F.col("passes"), F.col("graded"))

    def rate(name: str, over: str, under: str, reason: str, interval=None) -> Column:
        a, b = F.col(over), F.col(under)
        return metric_value(name, K.rate(a, b), F.lit(reason), numerator=a, denominator=b, eligible=b, missing=F.greatest(F.lit(0), F.col("slots") - b), interval=interval)

    done = {
        "target_completion": rate("target_completion", "completed", "slots", "no scheduled slots"),
        "grade_coverage": rate("grade_coverage", "graded", "completed", "no eligible slots"),
        "conditional_pass": rate("conditional_pass", "passes", "graded", "no graded trials", ("wilson", 0.95, low, high)),
        "observed_success_yield": rate("observed_success_yield", "passes", "slots", "no scheduled slots"),
        "case_pass_rate": metric_value("case_pass_rate", F.col("case_rate"), F.lit("no case with graded trials"), eligible=F.col("cases"), missing=F.col("ungraded")),
        "latency_p50": metric_value("latency_p50", F.col("p50_ms"), F.lit("no completed calls"), eligible=F.col("n"), missing=F.col("slots") - F.col("n")),
        "latency_p95": metric_value("latency_p95", F.col("p95_ms"), F.lit("no completed calls"), eligible=F.col("n"), missing=F.col("slots") - F.col("n")),
    }
    return rows.select("candidate", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), m.alias("metric")) for n, m in done.items()])))


def slices(trials: DataFrame, tags: dict[str, Column]) -> DataFrame:
    """Counts and pass rate by slice key, value and candidate. Slices overlap; every candidate shows in each.

    Counts are made once for the whole tag combination, then folded by key, so the fact table is read and shuffled once.
    """
    fine = counts(trials.withColumns(tags), *tags, "candidate")
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("slice_key"), F.col(k).cast("string").alias("slice_value")) for k in tags])).alias("s")
    long = fine.select(pairs, "candidate", "slots", "passes", "failures").select("s.*", "candidate", "slots", "passes", "failures").where("slice_value is not null")
    got = long.groupBy("slice_key", "slice_value", "candidate").agg(*[F.sum(c).alias(c) for c in ("slots", "passes", "failures")])
    names = got.groupBy("slice_key", "slice_value").agg(F.count("*").alias("__n")).drop("__n")
    every = names.join(F.broadcast(trials.select("candidate").distinct()))  # candidates of a run: a handful
    full = every.join(got, ["slice_key", "slice_value", "candidate"], "left").fillna(0, ["slots", "passes", "failures"])
    return full.withColumn("pass_rate", K.rate(F.col("passes"), F.col("passes") + F.col("failures")))


def repeatability(trials: DataFrame, category: str = "category") -> DataFrame:
    """Agreement between a cell's repeated outputs: distinct, modal and pairwise agreement, entropy in nats.

    Null categories are ineligible and counted; fewer than two comparable outputs give nulls and a reason.
    """
    per = trials.groupBy("case_id", "candidate", category).agg(F.count("*").alias("n"))
    known = F.col(category).isNotNull()
    g = per.groupBy("case_id", "candidate").agg(
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("comparable"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("ineligible"),
        F.count_if(known).alias("distinct_outputs"), F.max(F.when(known, F.col("n"))).alias("__max"),
        F.sum(F.when(known, F.col("n") * (F.col("n") - 1))).alias("__pairs"), F.sum(F.when(known, F.col("n") * F.log(F.col("n").cast("double")))).alias("__nlogn"),
    )
    n = F.col("comparable").cast("double")
    enough = F.col("comparable") >= 2
    return g.select(
        "case_id", "candidate", "comparable", "ineligible", "distinct_outputs",
        F.when(enough, F.col("__max") / n).alias("modal_agreement"), F.when(enough, F.col("__pairs") / (n * (n - 1))).alias("pairwise_agreement"),
        F.when(enough, F.greatest(F.lit(0.0), F.log(n) - F.col("__nlogn") / n)).alias("output_entropy"),
        F.when(~enough, "fewer than two comparable outputs").alias("reason"),
    )


#: Ways in which outputs count as the same.
REPRESENTATIONS = ("raw", "json", "semantic")


def output_category(representation: str, text: Column, parsed: Column | None = None, semantic: Column | None = None, has_output: Column | None = None) -> tuple[Column, Column]:
    """(category, reason): what an output is the same as, by its bytes, its canonical JSON or an assigned class; null, with the
    reason, where it isn't eligible. ``parsed``: JSON text, else the text is read as JSON."""
    if representation not in REPRESENTATIONS:
        raise ValueError(f"unknown representation {representation!r}")
    there = text.isNotNull() if has_output is None else has_output
    digest = lambda c, kind: F.concat(F.lit(f"{kind}:"), F.left(F.sha2(c, 256), F.lit(24)))
    if representation == "raw":
        found, reason = digest(text, "raw"), "no text output"
    elif representation == "semantic":
        said = F.lit(None).cast("string") if semantic is None else F.nullif(semantic, F.lit(""))
        found, reason = F.concat(F.lit("semantic:"), said), "no semantic class assigned"
    else:
        json = text if parsed is None else F.coalesce(parsed, text)
        whole = canonical_json()(json)
        found, reason = F.when(whole != "null", digest(whole, "json")), "output is not valid JSON"
    found = F.when(there, found)
    return found, F.when(~there, "no output").when(found.isNull(), reason)


def repeated_success(cell: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """pass@k and pass^k of each cell, with the zero-failure bound and the posterior mean."""
    p, n = F.col("passes"), F.col("graded")
    cols = {f"pass_at_{k}": K.pass_at_k(p, n, k) for k in ks} | {f"pass_all_{k}": K.pass_all_k(p, n, k) for k in ks}
    cols["zero_failure_bound"] = F.when((F.col("failures") == 0) & (n > 0), K.zero_failure_bound(n))
    cols["posterior_mean"] = F.when(n > 0, K.posterior(p, n)[2])
    return cell.select("case_id", "candidate", "passes", "graded", *[c.alias(k) for k, c in cols.items()])


#: Half widths, as shares of a group, of the nested brackets in which a rank is looked for.
BRACKETS = (3e-4, 24e-4, 192e-4, 1536e-4)


def exact_quantiles(rows: DataFrame, value: Column, keys: list[str], quantiles: dict[str, float], *, small: int = 10_000) -> DataFrame:
    """``keys`` and one column for each of ``quantiles``: exact, linear between ranks; nulls don't count, a group of nulls
    has no row.

    Groups of at most ``small`` values are settled by one aggregate. Of a larger one a sketch gives nested brackets around each
    quantile; how many values lie below and up to their ends is counted, and the narrowest bracket is taken that holds the
    ranks, or none, which always does. Only the distinct values inside are put in order: some 6 in 10,000 of a group.
    """
    group = F.struct(F.lit(0).alias("__g"), *keys).alias("__k")
    data = rows.select(group, value.cast("double").alias("__v")).where("__v is not null")
    names, levels = list(quantiles), range(len(BRACKETS))
    plain = data.groupBy("__k").agg(*[F.percentile("__v", F.lit(q)).alias(n) for n, q in quantiles.items()])
    sizes = data.groupBy("__k").agg(F.count("*").alias("n"))
    big, groups = sizes.agg(F.count_if(F.col("n") > small), F.count("*")).first()
    shown = [*[F.col(f"__k.{k}").alias(k) for k in keys], *names]
    if not big:
        return plain.select(*shown)
    near = lambda df: F.broadcast(df) if groups <= 100_000 else df  # noqa: E731  a row for each group
    sized = data.join(near(sizes.select(F.col("__k").alias("__key"), "n")), F.col("__k").eqNullSafe(F.col("__key"))).drop("__key")
    few = sized.where(F.col("n") <= small).groupBy("__k").agg(*[F.percentile("__v", F.lit(q)).alias(n) for n, q in quantiles.items()])
    many = sized.where(F.col("n") > small)
    ends = [(max(0.0, q - w), min(1.0, q + w)) for q in quantiles.values() for w in BRACKETS]
    sketch = many.groupBy("__k").agg(F.percentile_approx("__v", [x for pair in ends for x in pair], 10_000).alias("s"))
    marked = many.join(near(sketch.withColumnRenamed("__k", "__key")), F.col("__k").eqNullSafe(F.col("__key")))
    end = lambda i, upper: F.get("s", F.lit(2 * i + upper))
    counts = [c for i in range(len(ends)) for c in (F.count_if(F.col("__v") < end(i, 0)).alias(f"b{i}"), F.count_if(F.col("__v") <= end(i, 1)).alias(f"u{i}"))]
    counted = marked.groupBy("__k").agg(F.first("n").alias("n"), F.first("s").alias("s"), *counts)

    def bracket(at: int, name: str, q: float) -> Column:
        rank = F.lit(q) * (F.col("n") - 1)
        of = lambda lo, hi, below: F.struct(F.lit(name).alias("name"), rank.alias("rank"), lo.alias("lo"), hi.alias("hi"), below.alias("below"))
        out = of(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(0).cast("long"))
        for level in reversed(levels):
            i = at * len(BRACKETS) + level
            holds = (F.col(f"b{i}") <= F.floor(rank)) & (F.col(f"u{i}") > F.ceil(rank))
            out = F.when(holds, of(end(i, 0), end(i, 1), F.col(f"b{i}"))).otherwise(out)
        return out

    chosen = counted.select(F.col("__k").alias("__key"), F.explode(F.array(*[bracket(i, n, q) for i, (n, q) in enumerate(quantiles.items())])).alias("m"))
    inside = many.join(near(chosen), F.col("__k").eqNullSafe(F.col("__key"))).where("(m.lo is null or __v >= m.lo) and (m.hi is null or __v <= m.hi)")
    tied = inside.groupBy("__k", "m.name", "m.rank", "m.below", "__v").agg(F.count("*").alias("n"))
    upto = tied.withColumn("upto", F.col("below") + F.sum("n").over(Window.partitionBy("__k", "name").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)))
    at_rank = lambda r: F.min(F.when(F.col("upto") > r, F.col("__v")))
    found = upto.groupBy("__k", "name").agg(at_rank(F.floor("rank")).alias("a"), at_rank(F.ceil("rank")).alias("b"), F.first(F.col("rank") - F.floor("rank")).alias("f"))
    each = [F.max(F.when(F.col("name") == n, F.col("a") + (F.col("b") - F.col("a")) * F.col("f"))).alias(n) for n in names]
    return few.unionByName(found.groupBy("__k").agg(*each)).select(*shown)


def latency(trials: DataFrame, *keys: str, small: int = 1_000_000) -> DataFrame:
    """Exact linear-interpolated quantiles over completed trials; problems are counted apart. Groups of over ``small``
    completed trials are settled by ``exact_quantiles``; up to there one aggregate holds a group's distinct values."""
    done = F.when(F.col("status").isin(*OUTPUT_STATUSES), F.col("latency_ms"))
    counted = [F.count(done).alias("n"), F.count_if(F.col("status").isin(*PROBLEM_STATUSES)).alias("problems")]
    sizes = trials.groupBy(*keys).agg(*counted)
    if not sizes.where(F.col("n") > small).limit(1).count():
        return trials.groupBy(*keys).agg(counted[0], F.percentile(done, F.lit(0.5)).alias("p50_ms"), F.percentile(done, F.lit(0.95)).alias("p95_ms"), counted[1])
    found = exact_quantiles(trials, done, list(keys), {"p50_ms": 0.5, "p95_ms": 0.95}, small=small)
    right = found.select(*[F.col(k).alias(f"__{k}") for k in keys], "p50_ms", "p95_ms")
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    joined = sizes.join(right, same, "left") if keys else sizes.crossJoin(F.broadcast(right))  # without keys both have one row
    return joined.select(*keys, "n", "p50_ms", "p95_ms", "problems")


def costs(attempts: DataFrame) -> DataFrame:
    """Known cost by kind and currency, unknown amounts counted, coverage, and whether the sum is complete."""
    g = attempts.groupBy("kind", "currency").agg(F.sum("amount").alias("known"), F.count("*").alias("n"), F.count_if(F.col("amount").isNull() | F.col("currency").isNull()).alias("unknown"))
    return g.withColumns({"coverage": K.rate(F.col("n") - F.col("unknown"), F.col("n")), "complete": (F.col("n") > 0) & (F.col("unknown") == 0)})


def cost_per_success(attempts: DataFrame, passes: DataFrame) -> DataFrame:
    """One row: cost of all attempts over the passes; null, with the reason, if incomplete, in several currencies or without a pass."""
    a = attempts.agg(F.sum("amount").alias("amount"), F.count("*").alias("n"), F.count_if(F.col("amount").isNull()).alias("unknown"), F.count_distinct("currency").alias("currencies"))
    b = passes.agg(n_outcome("pass").alias("passes"))
    reason = F.when((F.col("n") == 0) | (F.col("unknown") > 0), "incomplete cost").when(F.col("currencies") != 1, "more than one currency").when(F.col("passes") == 0, "no confirmed success")
    return a.join(b).withColumn("reason", reason).withColumn("cost_per_success", F.when(F.col("reason").isNull(), F.col("amount") / F.col("passes")))


#: The ranks of severities, and the latest review decisions that leave a label uncertain.
SEVERITIES = ("critical", "high", "medium", "low")
UNCERTAIN_REVIEWS = ("ambiguous", "grader_incorrect")


def triage(trials: DataFrame, cases: DataFrame, baseline: str = "baseline", reviews: DataFrame | None = None) -> DataFrame:
    """Failing cells, with what puts them in order and the trial to look at first: the first failed, else the first not
    passed, else the first one.

    A cell fails if a trial of it failed, has a problem or is unresolved. Priorities: 0 a failure of a critical case, or
    any broken invariant; 1 a rate below the baseline's; 2 an uncertain label: a grading error, an unsettling review, or
    nothing but unresolved trials; 3 flaky; 4 the rest. ``trials`` needs repeat_index and may have invariant_failed and
    grading_error (boolean); ``cases`` severity; ``reviews`` case_id, decision and created_at.
    """
    flag = lambda name: F.count_if(F.col(name)) if name in trials.columns else F.lit(0).cast("long")
    rank = F.when(F.col("outcome") == "fail", 0).when(F.col("outcome").isNull(), 1).otherwise(2)
    cell = trials.groupBy("case_id", "candidate").agg(
        F.count("*").alias("slots"), n_outcome("pass").alias("passes"), n_outcome("fail").alias("failures"),
        F.count_if(F.col("status").isin(*PROBLEM_STATUSES)).alias("problems"), F.count_if(F.col("status").isin("provider_error", "timeout")).alias("provider_errors"),
        flag("invariant_failed").alias("invariant_failures"), flag("grading_error").alias("grading_errors"),
        F.min_by("repeat_index", F.struct(rank.alias("r"), "repeat_index")).alias("representative_repeat"),
    )
    graded = F.col("passes") + F.col("failures")
    cell = cell.withColumns({"graded": graded, "unresolved": F.col("slots") - graded, "pass_rate": K.rate(F.col("passes"), graded), "flaky": (F.col("passes") > 0) & (F.col("failures") > 0), "stable_wrong": (graded >= 2) & (F.col("passes") == 0)})
    of_base = lambda c: F.max(F.when(F.col("candidate") == baseline, F.col(c))).over(Window.partitionBy("case_id"))
    rows = cell.withColumns({"baseline_rate": of_base("pass_rate"), "__base_wrong": of_base("stable_wrong")}).join(cases, "case_id")
    if reviews is None:
        rows = rows.withColumn("review", F.lit(None).cast("string"))
    else:
        rows = rows.join(reviews.groupBy("case_id").agg(F.max_by("decision", "created_at").alias("review")), "case_id", "left")
    other = F.col("candidate") != baseline
    moved = F.abs(F.col("pass_rate") - F.col("baseline_rate")) >= 0.5
    differs = F.coalesce(moved, F.lit(False)) | (F.col("stable_wrong") != F.coalesce("__base_wrong", F.lit(False)))
    uncertain = (F.col("grading_errors") > 0) | F.coalesce(F.col("review").isin(*UNCERTAIN_REVIEWS), F.lit(False))
    rows = rows.withColumns(
        {
            "regressed": F.coalesce(other & (F.col("pass_rate") < F.col("baseline_rate")), F.lit(False)),
            "changed": F.max(other & differs).over(Window.partitionBy("case_id")) & other,
            "severity_rank": F.coalesce(F.array_position(F.array(*[F.lit(x) for x in SEVERITIES]), F.col("severity")) - 1, F.lit(9)),
        }
    )
    priority = (
        F.when((F.col("severity") == "critical") & (F.col("failures") > 0) | (F.col("invariant_failures") > 0), 0)
        .when(F.col("regressed"), 1)
        .when(uncertain | (F.col("unresolved") > 0) & (F.col("failures") == 0), 2)
        .when(F.col("flaky"), 3)
        .otherwise(4)
    )
    failing = (F.col("failures") > 0) | (F.col("problems") + F.col("grading_errors") > 0) | (F.col("unresolved") > 0)
    return rows.where(failing).withColumn("priority", priority).drop("__base_wrong")


TRIAGE_ORDER = ("priority", "severity_rank", "case_id", "candidate")


def triage_filter(
    rows: DataFrame, *, severity: str | None = None, candidate: str | None = None, flaky: bool | None = None, stable_wrong: bool | None = None, regressed: bool | None = None,
    changed: bool | None = None, grading_error: bool | None = None, provider_error: bool | None = None, problems: bool | None = None, review: str | None = None, tag: str | None = None,
) -> DataFrame:
    """Conjunction of the filters that are set; '' counts as unset, a ``tag`` that is not key=value and a ``review`` other
    than unreviewed or confirmed keep all."""
    for name, value in (("severity", severity), ("candidate", candidate), ("flaky", flaky), ("stable_wrong", stable_wrong), ("regressed", regressed), ("changed", changed)):
        if value not in (None, ""):
            rows = rows.where(F.col(name) == value)
    for name, value in (("grading_errors", grading_error), ("provider_errors", provider_error), ("problems", problems)):
        if value not in (None, ""):
            rows = rows.where((F.col(name) > 0) == value)
    if review == "unreviewed":
        rows = rows.where(F.col("review").isNull())
    elif review == "confirmed":
        rows = rows.where(F.col("review") == "confirm_failure")
    if tag and "=" in tag:
        key, value = tag.split("=", 1)
        rows = rows.where(F.col(key).cast("string") == value) if key in rows.columns else rows.where(F.lit(False))
    return rows


METRICS = ("pass_rate", "case_pass_rate", "pass_at_k", "pass_all_k", "modal_agreement", "pairwise_agreement", "output_entropy", "latency")


def statistics(trials: DataFrame, metric: str, group_by: str = "candidate", *, slice_column: str | None = None, k: int = 3) -> DataFrame:
    """The ad-hoc query: one of ``METRICS`` by candidate, case or slice, as keys and ``value``."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {METRICS}")
    keys = {"candidate": ["candidate"], "case": ["case_id", "candidate"], "slice": [slice_column, "candidate"]}[group_by]
    if None in keys:
        raise ValueError("group_by='slice' needs slice_column")
    if metric == "pass_rate":
        return counts(trials, *keys).select(*keys, K.rate(F.col("passes"), F.col("graded")).alias("value"))
    if metric == "latency":
        return latency(trials, *keys).select(*keys, F.col("p50_ms").alias("value"))
    if metric in ("case_pass_rate", "pass_at_k", "pass_all_k"):
        of = {"case_pass_rate": lambda p, n: K.rate(p, n), "pass_at_k": lambda p, n: K.pass_at_k(p, n, k), "pass_all_k": lambda p, n: K.pass_all_k(p, n, k)}[metric]
        inner = counts(trials, *dict.fromkeys(["case_id", *keys])).withColumn("v", of(F.col("passes"), F.col("graded")))
        return inner.groupBy(*keys).agg(F.avg("v").alias("value"))
    if group_by == "slice":
        raise ValueError(f"{metric} is defined by case and candidate")
    r = repeatability(trials)
    return r.groupBy(*keys).agg(F.avg(metric).alias("value"))
