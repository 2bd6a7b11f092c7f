"""Joins, windows and set operations over run records: versions, reviews, schedules, splits, pairing, prices, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def glob_to_regex(pattern: str) -> str:
    import fnmatch

    return "^" + fnmatch.translate(pattern).removesuffix(r"\z").removesuffix(r"\Z").replace("(?s:", "(?s:", 1) + "$"


def priced(used: DataFrame, prices: list[tuple[str, float, float]], model: str = "model") -> DataFrame:
    """Adds price_in and price_out of the last pattern that matches the model; null without one. The list is configuration."""
    price_in, price_out = F.lit(None).cast("double"), F.lit(None).cast("double")
    for pattern, p_in, p_out in prices:
        hit = F.col(model).rlike(glob_to_regex(pattern))
        price_in, price_out = F.when(hit, p_in).otherwise(price_in), F.when(hit, p_out).otherwise(price_out)
    return used.withColumns({"price_in": price_in, "price_out": price_out})


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by ``order``: an aggregate, so it combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def not_superseded(reviews: DataFrame, key: str = "review_id", supersedes: str = "supersedes_id") -> DataFrame:
    gone = reviews.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias(key)).distinct()
    return reviews.join(gone, key, "left_anti")


def adjudicated(outcomes: DataFrame, reviews: DataFrame, key: str = "trial_id") -> DataFrame:
    """The reviewer's word over the machine's: confirmed means fail, acceptable means pass; others leave it."""
    last = latest(not_superseded(reviews).select(key, "review_id", "verdict", "created_at"), [key], "created_at", "review_id").select(key, "verdict")
    human = F.when(F.col("verdict") == "confirmed", "fail").when(F.col("verdict") == "acceptable", "pass")
    joined = outcomes.join(last, key, "left")
    return joined.withColumn("final_outcome", F.coalesce(human, F.col("outcome"))).withColumn("disagrees", F.coalesce(human != F.col("outcome"), F.lit(False)))


def schedule(slots: DataFrame, seed: str, *parts: str) -> DataFrame:
    """A reproducible order: position of each slot by the SHA-256 of seed and parts.

    Range partitions sort for themselves; a partition's first position is the count of those before it, one row per
    partition. No task sees all slots.
    """
    digest = F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(p).cast("string") for p in parts]), 256)
    return positions(slots.withColumn("digest", digest), "digest", *parts)


def positions(rows: DataFrame, *order: str, to: str = "position") -> DataFrame:
    """Adds the place of each row in the whole order, from 0, without bringing all rows to one task.

    Buckets come from the order's quantile-like leading bytes where it is a digest: the first three hex digits.
    """
    bucket = F.substring(F.col(order[0]).cast("string"), 1, 3)
    with_bucket = rows.withColumn("__bucket", bucket)
    sizes = with_bucket.groupBy("__bucket").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("__n")  # at most 4,096 rows
    local = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)) - 1
    return with_bucket.join(F.broadcast(before), "__bucket").withColumn(to, local + F.coalesce("__before", F.lit(0))).drop("__bucket", "__before")


def cluster_split(clusters: DataFrame, fractions: dict[str, float], seed: str, cluster: str = "cluster_id") -> DataFrame:
    """Each cluster's split: clusters in hash order, cut at the rounded (half to even) cumulative fractions."""
    ranked = positions(clusters.select(cluster).distinct().withColumn("digest", F.sha2(F.concat(F.lit(f"{seed}:"), F.col(cluster)), 256)), "digest", cluster, to="rank")
    total = clusters.select(cluster).distinct().agg(F.count("*").alias("total"))
    rows = ranked.join(F.broadcast(total))  # one row
    out, cum = F.lit(None).cast("string"), 0.0
    cuts = []
    for name, share in fractions.items():
        cum += share
        cuts.append((name, cum))
    for name, c in reversed(cuts):
        out = F.when(F.col("rank") < F.bround(F.col("total") * F.lit(round(c, 12))), name).otherwise(out)
    return rows.select(cluster, "rank", F.coalesce(out, F.lit(cuts[-1][0])).alias("split"))


def pair_cases(baseline: DataFrame, candidate: DataFrame, key: str = "case_id", content: str = "case_hash") -> DataFrame:
    """Full outer pairing by case, with how the case fared: paired, case_changed, added_in_candidate or missing_in_candidate."""
    b = baseline.select(F.col(key), F.col(content).alias("base_hash"), F.col("pass_rate").alias("base_rate"))
    c = candidate.select(F.col(key), F.col(content).alias("cand_hash"), F.col("pass_rate").alias("cand_rate"))
    kind = F.when(F.col("base_hash").isNull(), "added_in_candidate").when(F.col("cand_hash").isNull(), "missing_in_candidate").when(F.col("base_hash") != F.col("cand_hash"), "case_changed").otherwise("paired")
    return b.join(c, key, "full_outer").withColumn("pairing", kind)


def case_change(base: Column, cand: Column) -> Column:
    return F.when(base.isNull() | cand.isNull(), "unresolved").when(cand > base, "improved").when(cand < base, "regressed").otherwise("unchanged")


def page(rows: DataFrame, sort: str, key: str, *, after: tuple | None = None, size: int = 50) -> DataFrame:
    """Keyset page, newest first: rows below (sort, key), one more than ``size`` to tell whether others follow."""
    if after is not None:
        rows = rows.where((F.col(sort) < after[0]) | (F.col(sort) == after[0]) & (F.col(key) < after[1]))
    return rows.orderBy(F.desc(sort), F.desc(key)).limit(size + 1)


def duplicates(rows: DataFrame, content: Column, key: str) -> DataFrame:
    """Groups of keys with equal content: its SHA-256, number of keys, smallest key."""
    g = rows.groupBy(F.sha2(content, 256).alias("content_hash")).agg(F.count("*").alias("n"), F.min(key).alias("first"))
    return g.where("n > 1")


def once_each(requests: DataFrame, key: str, body: str, *order: str) -> DataFrame:
    """Idempotent requests: the first of each key runs; later ones replay it if their body is equal and conflict if not."""
    first = requests.groupBy(key).agg(F.min_by(F.struct(F.col(body).alias("b"), *order), F.struct(*order)).alias("first"))
    joined = requests.join(first, key)
    is_first = F.struct(*order) == F.struct(*[F.col(f"first.{o}") for o in order])
    return joined.withColumn("result", F.when(is_first, "created").when(F.col(body).eqNullSafe(F.col("first.b")), "replayed").otherwise("conflict")).drop("first")


def invariance(trials: DataFrame, others: DataFrame, answer: str) -> DataFrame:
    """Whether each trial answers as its base case does in the same candidate and repeat; null without a base's answer.

    ``trials`` names its base in base_case. The plain equi-join moves one narrow row per trial.
    """
    base = others.select(F.col("case_id").alias("base_case"), "candidate", "repeat_index", F.col(answer).alias("__base"))
    return trials.join(base, ["base_case", "candidate", "repeat_index"], "left").withColumn("invariant", F.col(answer) == F.col("__base")).drop("__base")


def tail_window(turns: Column, base: Column, budget: Column, *, most: int = 6) -> Column:
    """The longest run of the last turns, at most ``most`` of them, that fits: tokens of the turns and ``base`` within ``budget``.

    ``turns``: array of structs with ``tokens``, in order. From the end, the first turn too long for what is left ends the
    window, even if shorter ones lie before it. Null turns give null; unknown tokens count as too long.
    """
    last = F.reverse(F.slice(turns, F.greatest(F.lit(1), F.size(turns) - (most - 1)), most))
    start = F.struct(F.coalesce(base, F.lit(0)).cast("long").alias("used"), F.lit(0).alias("kept"), F.lit(True).alias("open"))

    def add(state: Column, turn: Column) -> Column:
        used = state["used"] + turn["tokens"]
        fits = state["open"] & F.coalesce(used <= budget, F.lit(False))
        return F.struct(F.when(fits, used).otherwise(state["used"]).alias("used"), (state["kept"] + fits.cast("int")).alias("kept"), fits.alias("open"))

    kept = F.aggregate(last, start, add, lambda state: state["kept"])
    return F.when(turns.isNotNull(), F.reverse(F.slice(last, 1, F.coalesce(kept, F.lit(0)))))
