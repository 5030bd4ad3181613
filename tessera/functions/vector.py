"""Vector and numeric functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero denominator counts as one."""
    below = norm(a) * norm(b)
    return dot(a, b) / F.when(below == 0, 1.0).otherwise(below)


def euclid(a: Column, b: Column) -> Column:
    """Negative distance, so that more is nearer."""
    square = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return -F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def measure(name: str, a: Column, b: Column) -> Column:
    found = {"dot": dot, "cosine": cosine, "euclidean": euclid}.get(name)
    if found is None:
        raise ValueError(f"unknown measure: {name}")
    return found(a, b)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector is zero."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def relevance_cosine(r: Column) -> Column:
    """relevance to distance to cosine."""
    distance = F.lit(2.0**0.5) * (1 - r)
    return 1 - distance * distance / 2


def relevance_weight(r: Column, power: float) -> Column:
    """relevance to distance to cosine to (1 - sine) ^ power."""
    c = relevance_cosine(r)
    return F.pow(1 - F.sqrt(F.greatest(F.lit(0.0), 1 - c * c)), F.lit(power))


def linear_similarity(c: Column) -> Column:
    """A cosine as the share of the half circle that is left."""
    return 1 - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))) / F.lit(3.141592653589793)


def entropy(p: Column, eps: float = 1e-9) -> Column:
    """Of a coin with chance p, in nats; p is kept off 0 and 1 by eps."""
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return -(q * F.ln(q) + (1 - q) * F.ln(1 - q))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def token_band(t: Column) -> tuple[Column, Column]:
    """Lengths that match t words: t less or plus the larger of 8 and 15 %."""
    slack = F.greatest(F.lit(8), F.bround(t * 0.15).cast("int"))
    return F.greatest(F.lit(1), t - slack), t + slack


def cache_key(model: str, dim: int, mode: str, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(model), F.lit(str(dim)), F.lit(mode), F.sha2(text, 256)), 256)
