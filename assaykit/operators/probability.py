"""Probability quality: usable records, scores, calibration bins, selective risk, and calibration fitted and applied."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.functions import kernels as K


def with_reason(records: DataFrame) -> DataFrame:
    """Adds ``reason``: why a record can't be used, null if it can."""
    reason = F.when(F.col("probability").isNull(), "no_probability").when(F.col("label").isNull(), "no_label").when(F.col("labeled_at") < F.col("predicted_at"), "label_before_prediction")
    return records.withColumn("reason", reason)


def usable(records: DataFrame) -> DataFrame:
    return with_reason(records).where("reason is null").drop("reason")


def quality(records: DataFrame, *keys: str) -> DataFrame:
    """Scores by ``keys``. One probability outside 0 to 1 makes all of a group's scores null, with a reason."""
    p, y = F.col("probability"), F.col("label")
    valid = F.coalesce(F.bool_and((p >= 0) & (p <= 1)), F.lit(False))
    g = records.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(y == 1).alias("positives"), F.count_distinct("cluster_id").alias("clusters"),
        F.when(valid, K.brier(p, y)).alias("brier"), F.when(valid, K.log_loss(p, y)).alias("log_loss"),
        F.when(valid, K.exact_log_loss(p, y)).alias("exact_log_loss"), F.when(valid, F.avg(p)).alias("mean_probability"), F.when(~valid, "outside 0 to 1").alias("reason"),
    )
    return g.withColumn("base_rate", K.rate(F.col("positives"), F.col("n")))


def calibration_bins(records: DataFrame, bins: int = 10) -> DataFrame:
    """All equal-width bins: n, mean probability, observed rate, gap; means of an empty bin are null."""
    got = records.groupBy(K.bin_of(F.col("probability"), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("probability").alias("mean_probability"), F.avg("label").alias("observed_rate"))
    every = records.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(got), "bin", "left").fillna(0, ["n"]).withColumn("gap", F.abs(F.col("mean_probability") - F.col("observed_rate")))  # at most ``bins`` rows


def expected_calibration_error(records: DataFrame, bins: int = 10) -> DataFrame:
    return calibration_bins(records, bins).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("max_gap"))


def selective_risk(records: DataFrame, thresholds: list[float]) -> DataFrame:
    """Coverage and risk of accepting p >= threshold, all thresholds in one pass; risk is null if nothing is accepted.

    A record counts for the thresholds up to its own place in the sorted list, so it is binned once, and the sums run
    over one row per threshold.
    """
    from pyspark.sql import Window

    ts = sorted(thresholds)
    place = F.size(F.filter(F.array(*[F.lit(float(t)) for t in ts]), lambda t: t <= F.col("probability")))
    got = records.groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.sum("label").alias("y"))
    every = records.sparkSession.createDataFrame([(i, float(t)) for i, t in enumerate(ts, 1)] + [(0, None)], "place int, threshold double")
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row per threshold
    down = Window.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = every.join(F.broadcast(got), "place", "left").fillna(0, ["n", "y"])
    rows = rows.withColumns({"accepted": F.sum("n").over(down), "hits": F.sum("y").over(down), "total": F.sum("n").over(whole)}).where("place > 0")
    return rows.select("threshold", "accepted", K.rate(F.col("accepted"), F.col("total")).alias("coverage"), (1 - K.rate(F.col("hits"), F.col("accepted"))).alias("risk"))


def risk_coverage_exact(records: DataFrame, *, parts: int = 256) -> DataFrame:
    """The whole curve: coverage and risk of accepting p >= threshold, for every distinct probability as the threshold.

    Records are counted by probability. Quantiles of the distinct ones cut them into ``parts`` ranges; each range sums for
    itself, and what lies above it is added from one row of each range. No task holds more than its range.
    """
    from pyspark.sql import Window

    by_p = records.where("probability is not null").groupBy("probability").agg(F.count("*").alias("n"), F.sum("label").alias("y"))
    marks = by_p.agg(F.percentile_approx("probability", [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    cuts = F.array(*[F.lit(float(m)) for m in sorted(set(marks))]).cast("array<double>")
    ranged = by_p.withColumn("part", F.size(F.filter(cuts, lambda m: m < F.col("probability"))))
    sums = ranged.groupBy("part").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    listed = sums.agg(F.collect_list(F.struct("part", "n", "y")).alias("all"))  # one row of at most ``parts`` entries
    added = lambda rows, c: F.aggregate(F.transform(rows, lambda r: F.coalesce(r[c], F.lit(0)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    above = F.filter("all", lambda r: r["part"] > F.col("part"))
    carried = sums.select("part").join(F.broadcast(listed)).select("part", added(above, "n").alias("n_above"), added(above, "y").alias("y_above"), added(F.col("all"), "n").alias("total"))
    down = Window.partitionBy("part").orderBy(F.desc("probability")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranged.join(F.broadcast(carried), "part").withColumns({"accepted": F.col("n_above") + F.sum("n").over(down), "hits": F.col("y_above") + F.sum("y").over(down)})
    return rows.select(F.col("probability").alias("threshold"), "accepted", K.rate(F.col("accepted"), F.col("total")).alias("coverage"), (1 - K.rate(F.col("hits"), F.col("accepted"))).alias("risk"))


def quality_block(records: DataFrame, *keys: str, fitted: Calibration | None = None, feature: str = "raw_feature", bins: int = 10, threshold: float = 0.5) -> DataFrame:
    """One row by ``keys`` with all that is said of a set of records: how many there are, are predicted, are labelled, and
    why others aren't used; clusters and classes of those that are; and their scores, ``raw`` and ``calibrated``.

    ``records`` may have raw_feature, the score before it was a probability; it stands in where the probability is missing.
    ``raw`` is null, with raw_reason, if one of them isn't within 0 and 1; ``calibrated`` if a record lacks ``feature``. Each is a
    struct of brier, log_loss, ece, its bins (n, mean_probability, observed_rate), and coverage and risk at ``threshold``. Records
    are read once: the bins of all groups come from the same aggregate, by group and bin, then folded.
    """
    have = records if "raw_feature" in records.columns else records.withColumn("raw_feature", F.lit(None).cast("double"))
    score = F.coalesce("probability", "raw_feature")
    unused = (
        F.when(score.isNull(), "no_probability").when(F.col("label").isNull(), "no_label")
        .when(F.coalesce(F.col("labeled_at") < F.col("predicted_at"), F.lit(False)), "label_before_prediction")
    )
    use = F.col("unused").isNull()
    said = have.withColumn("unused", unused).withColumns({"p_raw": F.when(use, score), "p_cal": F.when(use, fitted.apply(F.col(feature))) if fitted else F.lit(None).cast("double")})
    group = [F.struct(F.lit(0).alias("__g"), *keys).alias("__k")]
    counted = said.groupBy(*group).agg(
        F.count("*").alias("n_records"), F.count("probability").alias("n_predictions"), F.count("label").alias("n_labels"),
        *[F.count_if(F.col("unused") == r).alias(r) for r in ("no_probability", "no_label", "label_before_prediction")], F.count_if(use).alias("n_used"),
        F.count_distinct(F.when(use, F.col("cluster_id"))).alias("clusters"), F.count_if(use & (F.col("label") == 1)).alias("positive"), F.count_if(use & (F.col("label") == 0)).alias("negative"),
        F.count_if(use & ~((F.col("p_raw") >= 0) & (F.col("p_raw") <= 1))).alias("__odd"), F.count_if(use & F.col(feature).isNull()).alias("__lacking"),
    )

    def scores(p: str, to: str) -> DataFrame:
        x, y = F.col(p), F.col("label")
        accepted = x >= threshold
        part = said.where(use & (x >= 0) & (x <= 1)).groupBy(*group, K.bin_of(x, bins).alias("bin")).agg(
            F.count("*").alias("n"), F.avg(x).alias("mean_probability"), F.avg(y).alias("observed_rate"), F.sum((x - y) * (x - y)).alias("sq"),
            (K.log_loss(x, y) * F.count("*")).alias("ll"), F.count_if(accepted).alias("acc"), F.coalesce(F.sum(F.when(accepted, y)), F.lit(0)).alias("hits"),
        )
        n = F.sum("n")
        gap = F.abs(F.col("mean_probability") - F.col("observed_rate"))
        return part.groupBy(F.col("__k").alias("__key")).agg(
            F.struct(
                (F.sum("sq") / n).alias("brier"), (F.sum("ll") / n).alias("log_loss"), (F.sum(F.col("n") * gap) / n).alias("ece"),
                K.rate(F.sum("acc"), n).alias("coverage"), (1 - K.rate(F.sum("hits"), F.sum("acc"))).alias("risk"),
                F.array_sort(F.collect_list(F.struct("bin", "n", "mean_probability", "observed_rate"))).alias("bins"),
            ).alias(to)
        )

    out = counted.join(scores("p_raw", "raw"), F.col("__k").eqNullSafe(F.col("__key")), "left").drop("__key")
    raw_reason = F.when(F.col("n_used") == 0, "no labelled predictions in this selection").when(F.col("__odd") > 0, "raw scores are not probabilities")
    if fitted:
        out = out.join(scores("p_cal", "calibrated"), F.col("__k").eqNullSafe(F.col("__key")), "left").drop("__key")
        lacking = F.when(F.col("n_used") == 0, "no labelled predictions in this selection").when(F.col("__lacking") > 0, f"some records lack the calibration feature {feature!r}")
    else:
        out, lacking = out.withColumn("calibrated", F.lit(None).cast(out.schema["raw"].dataType)), F.lit("no calibration")
    done = out.withColumns(
        {
            "label_coverage": K.rate(F.col("n_labels"), F.col("n_records")), "raw_reason": raw_reason, "raw": F.when(raw_reason.isNull(), F.col("raw")),
            "calibrated_reason": lacking, "calibrated": F.when(lacking.isNull(), F.col("calibrated")),
        }
    )
    return done.select(*[F.col(f"__k.{k}").alias(k) for k in keys], *[c for c in done.columns if not c.startswith("__")])


def shared_clusters(fit: DataFrame, held_out: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    """Clusters that lie in both sets."""
    return fit.select(cluster).distinct().join(held_out.select(cluster).distinct(), cluster, "left_semi")


def fit_and_evaluate(records: DataFrame, method: str = "logistic", *, fit_split: str = "calibration", eval_split: str = "test", least_clusters: int = 30) -> tuple[Calibration, DataFrame]:
    """A calibration fitted on one split, and its scores on another, raw and calibrated. ``Refused`` if the splits are one, the
    fitting split has no usable record, or the two share a cluster."""
    if method not in ("logistic", "isotonic"):
        raise Refused("method must be logistic or isotonic")
    if fit_split == eval_split:
        raise Refused("the evaluation split must differ from the fitting split")
    known = usable(records)
    fit, held_out = (known.where(F.col("split") == s) for s in (fit_split, eval_split))
    if not fit.limit(1).count():
        raise Refused(f"no labelled predictions in the {fit_split!r} split")
    leaking = [r[0] for r in shared_clusters(fit, held_out).orderBy("cluster_id").limit(5).collect()]
    if leaking:
        raise Refused(f"clusters {leaking} appear in both splits; split by cluster first")
    fitted = (fit_logistic if method == "logistic" else fit_isotonic)(fit, least_clusters=least_clusters)
    return fitted, evaluate(held_out, fitted)


def split_leaks(records: DataFrame, split: str = "split", cluster: str = "cluster_id") -> DataFrame:
    """Clusters that lie in more than one split."""
    return records.groupBy(cluster).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


class Refused(ValueError):
    """The data do not allow a fit; the text says why. A result, not a failure to be retried."""


def check_fit(records: DataFrame, least_clusters: int = 30) -> dict:
    """One row of facts about the records to fit on; raises ``Refused``."""
    y = F.col("label")
    row = records.agg(
        F.count("*").alias("n"), F.count_distinct("split").alias("splits"), F.max("split").alias("split"), F.count_distinct("cluster_id").alias("clusters"), F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"),
        F.count_if(F.col("probability").isNull()).alias("missing"), F.max(F.when(y == 0, F.col("probability"))).alias("neg_max"), F.min(F.when(y == 1, F.col("probability"))).alias("pos_min"),
        F.max(F.when(y == 1, F.col("probability"))).alias("pos_max"), F.min(F.when(y == 0, F.col("probability"))).alias("neg_min"),
    ).first().asDict()
    if row["splits"] > 1:
        raise Refused("records of more than one split")
    if row["split"] == "test":
        raise Refused("the test split is not for fitting")
    if row["missing"]:
        raise Refused("records without a feature")
    if not row["pos"] or not row["neg"]:
        raise Refused("both labels are needed")
    if row["clusters"] < least_clusters:
        raise Refused(f"{row['clusters']} clusters; at least {least_clusters} are needed")
    return row | {"few_clusters": row["clusters"] < 100}


@dataclass(frozen=True)
class Calibration:
    method: str
    slope: float = 0.0
    intercept: float = 0.0
    on_logit: bool = False
    xs: tuple[float, ...] = ()
    ys: tuple[float, ...] = ()

    def apply(self, p: Column) -> Column:
        if self.method == "logistic":
            return K.logistic(K.logit(p) if self.on_logit else p, self.slope, self.intercept)
        return K.interpolate(p, list(self.xs), list(self.ys))

    def validate(self) -> None:
        import math

        numbers = [self.slope, self.intercept, *self.xs, *self.ys]
        if not all(math.isfinite(v) for v in numbers):
            raise ValueError("parameters must be finite")
        if self.method == "isotonic":
            if not self.xs or len(self.xs) != len(self.ys):
                raise ValueError("thresholds and values must be as many")
            if any(a > b for v in (self.xs, self.ys) for a, b in zip(v, v[1:], strict=False)) or not all(0 <= y <= 1 for y in self.ys):
                raise ValueError("must not decrease, values within 0 and 1")


def fit_logistic(records: DataFrame, *, on_logit: bool = False, least_clusters: int = 30) -> Calibration:
    """Unpenalised maximum likelihood; separated classes are refused."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    facts = check_fit(records, least_clusters)
    if facts["neg_max"] <= facts["pos_min"] or facts["pos_max"] <= facts["neg_min"]:
        raise Refused("the classes are separated; the fit has no finite optimum")
    x = K.logit(F.col("probability")) if on_logit else F.col("probability")
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(records.select(x.alias("x"), F.col("label").cast("double").alias("label")))
    model = LogisticRegression(regParam=0.0, standardization=False, tol=1e-10, maxIter=500).fit(rows)
    if abs(model.coefficients[0]) > 1e3:
        raise Refused("the slope is beyond 1000")
    out = Calibration("logistic", float(model.coefficients[0]), float(model.intercept), on_logit)
    out.validate()
    return out


def fit_isotonic(records: DataFrame, *, least_clusters: int = 30) -> Calibration:
    """Pool adjacent violators; between thresholds linear, beyond them constant."""
    from pyspark.ml.regression import IsotonicRegression

    check_fit(records, least_clusters)
    model = IsotonicRegression(featuresCol="x").fit(records.select(F.col("probability").alias("x"), F.col("label").cast("double").alias("label")))
    clip = lambda v: min(1.0, max(0.0, float(v)))
    out = Calibration("isotonic", xs=tuple(float(v) for v in model.boundaries), ys=tuple(clip(v) for v in model.predictions))
    out.validate()
    return out


def evaluate(records: DataFrame, fitted: Calibration) -> DataFrame:
    """Scores of held-out records, raw and calibrated."""
    raw = quality(records).withColumn("which", F.lit("raw"))
    done = quality(records.withColumn("probability", fitted.apply(F.col("probability")))).withColumn("which", F.lit("calibrated"))
    return raw.unionByName(done)
