"""Numeric expressions: gates, bounds, weights, vectors as arrays of doubles. Null inputs give null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The hard-concrete gate.
BETA, GAMMA, ZETA = 2.0 / 3.0, -0.1, 1.1


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(x)))


def open_probability(p, beta: float = BETA, gamma: float = GAMMA, zeta: float = ZETA) -> Column:
    """Probability that a hard-concrete gate of mean ``p`` is open; 0 and 1 at the ends, null outside [0, 1]."""
    p = _c(p)
    shift = beta * math.log(-gamma / zeta)
    return F.when(p == 0, 0.0).when(p == 1, 1.0).when((p > 0) & (p < 1), sigmoid(F.ln(p / (1.0 - p)) - shift))


def lower_positive_rate(positive, n, hypotheses, alpha: float = 0.05) -> Column:
    """Lower bound of a rate that holds for all hypotheses at once: Hoeffding with Bonferroni's share; null where n is 0."""
    n = _c(n).cast("double")
    each = F.greatest(_c(hypotheses).cast("double"), F.lit(1.0))
    return F.when(n > 0, _c(positive) / n - F.sqrt(F.ln(2.0 * each / alpha) / (2.0 * n)))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine of two vectors; 0 where one has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def manhattan(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)


def euclidean(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.pow(x.cast("double") - y, F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def _over(a: Column, by: Column) -> Column:
    """Elements of ``a`` over a number that is computed once, not once per element as it would be inside a lambda."""
    return F.zip_with(a, F.array_repeat(by, F.size(a)), lambda x, y: x.cast("double") / y)


def l2_normalize(a) -> Column:
    return _over(_c(a), F.greatest(norm(a), F.lit(1e-12)))


def softmax(a) -> Column:
    most = F.array_repeat(F.array_max(_c(a)), F.size(_c(a)))
    powers = F.zip_with(_c(a), most, lambda x, m: F.exp(x - m))
    return _over(powers, F.aggregate(powers, F.lit(0.0), lambda s, x: s + x))


def entropy(p) -> Column:
    return -F.aggregate(F.transform(_c(p), lambda x: x * F.ln(F.greatest(x, F.lit(1e-9)))), F.lit(0.0), lambda s, x: s + x)


def sum_vectors(vector, dims: int, weight=None) -> Column:
    """Aggregate: the element-wise sum of a group's vectors, as partial sums that Spark combines before the shuffle."""
    v = _c(vector)
    w = F.lit(1.0) if weight is None else _c(weight)
    return F.array(*[F.sum(v[i].cast("double") * w) for i in range(dims)])


def divide(vector, by, least: float) -> Column:
    """Elements over ``by``, which is taken for ``least`` if smaller."""
    d = F.greatest(_c(by).cast("double"), F.lit(least))
    return F.transform(_c(vector), lambda x: x / d)
