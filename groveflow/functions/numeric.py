"""Numeric column expressions shared by the operators."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(x) -> Column:
    """Round to six digits for reports; adding zero turns -0.0 into 0.0."""
    x = F.col(x) if isinstance(x, str) else x
    return F.round(x.cast("double"), 6) + F.lit(0.0)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def div0(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b, or `default` where b is zero or null."""
    return F.when(b != 0, a / b).otherwise(F.lit(float(default)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def tanh_distance(a: Column, b: Column) -> Column:
    """|tanh((a-b)/2)|; one finite side counts 1, none is null (skipped by avg)."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return (
        F.when(finite(a) & finite(b), F.abs(F.tanh((a - b) / 2)))
        .when(finite(a) | finite(b), F.lit(1.0))
    )


def best_of_k(v: Column, k: int = 4) -> Column:
    """Chance that the best of k draws succeeds."""
    return F.lit(1.0) - F.pow(F.lit(1.0) - v, F.lit(float(k)))


def ci_length(p: Column, n: Column) -> Column:
    """Length of the 95 % normal interval of a proportion."""
    return F.lit(2 * 1.96) * F.sqrt(p * (F.lit(1.0) - p) / n)


def overlong_penalty(length: Column, max_len: int, buffer: int, factor: float) -> Column:
    return F.least(-(length - F.lit(max_len - buffer)) / F.lit(float(buffer)) * F.lit(float(factor)), F.lit(0.0))


def confidence_radius(n: Column, alpha: float) -> Column:
    import math

    return F.when(n > 0, F.sqrt(F.lit(math.log(2.0 / alpha)) / (n * 2.0))).otherwise(F.lit(float("inf")))


def log_sum_exp(arr: Column) -> Column:
    m = F.array_max(arr)
    return m + F.log(F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))


def perplexity(arr: Column) -> Column:
    """exp of the negative mean log-probability; null for an empty array."""
    return F.when(F.size(arr) > 0, F.exp(-F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / F.size(arr)))


def residual_logp(arr: Column) -> Column:
    """log of the probability mass the listed log-probs leave over, floored."""
    mass = F.aggregate(arr, F.lit(0.0), lambda a, x: a + F.exp(x))
    return F.log(F.greatest(F.lit(1.0) - mass, F.lit(1e-12)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def tail_corrected(tv: Column, eps: float) -> Column:
    tv = clip(tv, 0.0, 1.0)
    eps = min(max(eps, 0.0), 1.0)
    return tv + (F.lit(1.0) - tv) * F.lit(eps)


def value_gap_bound(tv: Column, gamma=0.9, r_max=1.0, eps_tail=0.0, form="linear") -> Column:
    """Bound on the value gap of two prefixes from their total-variation distance."""
    tv = tail_corrected(tv, eps_tail)
    if form == "linear":
        gap = tv
    elif form == "simulation_lemma":
        gamma = min(max(gamma, 0.0), 1.0 - 1e-8)
        gap = F.lit(gamma) * tv / (F.lit(1.0 - gamma) * (F.lit(1.0 - gamma) + F.lit(gamma) * tv))
    else:
        raise ValueError(f"unknown bound form {form!r}")
    return F.lit(max(r_max, 0.0)) * F.least(gap, F.lit(1.0))


def eta(epsilon: float, r_max: float) -> float:
    return epsilon / max(r_max, 1e-8)


def stable_id(text: Column, digits: int = 15) -> Column:
    """Non-negative integer id from a string, same in every engine that has md5."""
    return F.conv(F.substring(F.md5(text.cast("string")), 1, digits), 16, 10).cast("bigint")


def sample_key(seed, *ids: Column) -> Column:
    """Order key of a seeded draw: md5 text, independent of partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def uniform(key: Column) -> Column:
    """Uniform number in [0,1) from an md5 text."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def all_of(*conds: Column) -> Column:
    return reduce(lambda a, b: a & b, conds)
