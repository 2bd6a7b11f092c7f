"""Statistics as Column builders: no UDF, so the optimizer sees through them. A missing denominator gives null, never 0."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def z_value(confidence: float) -> float:
    """Two-sided normal quantile."""
    return NormalDist().inv_cdf((1 + confidence) / 2)


def rate(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def wilson(passes: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Score interval; exactly 0 below with no passes, exactly 1 above with no failures; null without trials."""
    z = z_value(confidence)
    p, m = rate(passes, n), F.nullif(n.cast("double"), F.lit(0.0))
    scale = F.lit(1.0) + z * z / m
    middle = (p + z * z / (2 * m)) / scale
    half = z / scale * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    low = F.when(passes == 0, F.when(n > 0, F.lit(0.0))).otherwise(F.greatest(F.lit(0.0), middle - half))
    high = F.when(passes == n, F.when(n > 0, F.lit(1.0))).otherwise(F.least(F.lit(1.0), middle + half))
    return low, high


def zero_failure_bound(n: Column, confidence: float = 0.95) -> Column:
    """Upper bound of the failure rate after n trials without a failure."""
    return F.when(n > 0, -F.expm1(F.log1p(F.lit(-confidence)) / n))


def posterior(passes: Column, n: Column, alpha: float = 1.0, beta: float = 1.0) -> tuple[Column, Column, Column]:
    """Parameters and mean of the beta posterior."""
    a, b = passes + F.lit(alpha), n - passes + F.lit(beta)
    return a, b, a / (a + b)


def pass_at_k(passes: Column, n: Column, k: int) -> Column:
    """Chance that k of the n trials, drawn without replacement, hold a pass; null if k > n."""
    miss = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda acc, i: acc * F.greatest(n - passes - i, F.lit(0)) / F.greatest(n - i, F.lit(1)))
    return F.when(n >= k, F.when(n - passes < k, F.lit(1.0)).otherwise(1 - miss))


def pass_all_k(passes: Column, n: Column, k: int) -> Column:
    """Chance that all k of the n trials, drawn without replacement, pass; null if k > n."""
    hit = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda acc, i: acc * F.greatest(passes - i, F.lit(0)) / F.greatest(n - i, F.lit(1)))
    return F.when(n >= k, F.when(passes < k, F.lit(0.0)).otherwise(hit))


def at_least_one(p: Column, k: int) -> Column:
    return 1 - F.pow(1 - p, F.lit(float(k)))


def all_succeed(p: Column, k: int) -> Column:
    return F.pow(p, F.lit(float(k)))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate; null unless the weights sum to more than 0."""
    return F.when(F.sum(weight) > 0, F.sum(value * weight) / F.sum(weight))


# probability quality: aggregates over p (0 to 1) and a label y (0 or 1)


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def log_loss(p: Column, y: Column, clip: float = 1e-15) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.avg(F.when(y == 1, -F.log(q)).otherwise(-F.log1p(-q)))


def exact_log_loss(p: Column, y: Column) -> Column:
    """Infinite as soon as one outcome had probability 0."""
    q = F.when(y == 1, p).otherwise(1 - p)
    return F.when(F.bool_or(q <= 0), F.lit(float("inf"))).otherwise(F.avg(-F.log(F.when(q > 0, q))))


def bin_of(p: Column, bins: int) -> Column:
    return F.least(F.lit(bins - 1), F.floor(p * bins)).cast("int")


def token_logprobs(value: Column) -> dict[str, Column]:
    """Aggregates of token log probabilities."""
    return {"total": F.sum(value), "mean": F.avg(value), "n": F.count(value), "sequence_probability": F.exp(F.sum(value))}


def expected_score(score: Column, p: Column) -> Column:
    """Aggregate: sum of score * probability; null unless the probabilities sum to 1."""
    return F.when(F.abs(F.sum(p) - 1) <= 1e-6, F.sum(score * p))


def logistic(x: Column, slope: float, intercept: float) -> Column:
    return 1 / (1 + F.exp(-(slope * x + intercept)))


def logit(p: Column, clip: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.log(q / (1 - q))


def interpolate(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Linear between the points, constant beyond the ends. The points are constant arrays, searched by halves, so that the
    plan stays small however many there are."""
    n = len(xs)
    slopes = [(ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i]) if xs[i + 1] != xs[i] else 0.0 for i in range(n - 1)] + [0.0]
    px, py, ps = (F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>") for values in (xs, ys, slopes))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        left = F.get(px, mid) > x
        return F.struct(F.when(left, s["lo"]).otherwise(mid).alias("lo"), F.when(left, mid - 1).otherwise(s["hi"]).alias("hi"))

    ends = F.struct(F.lit(0).alias("lo"), F.lit(n - 1).alias("hi"))
    last = F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), ends, halve, lambda s: s["lo"])
    value = F.get(F.transform(F.array(last), lambda i: F.get(py, i) + (x - F.get(px, i)) * F.get(ps, i)), 0)
    return F.when(x.isNotNull(), F.when(x <= xs[0], F.lit(float(ys[0]))).when(x >= xs[-1], F.lit(float(ys[-1]))).otherwise(value))


def cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Per million tokens; null without a price or usage."""
    return (tokens_in * price_in + tokens_out * price_out) / F.lit(1e6)


def accuracy_gaps(train: Column, evaluation: Column, production: Column, later: Column) -> dict[str, Column]:
    """What accuracy loses from training to evaluation, from there to production, and over time there."""
    return {"generalization_gap": train - evaluation, "domain_gap": evaluation - production, "temporal_gap": production - later}
