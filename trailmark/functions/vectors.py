"""Vector columns (array<double>): products, norms, cosine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import _c


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x * x))


def unit(a) -> Column:
    """The vector over its length; vectors shorter than 1e-12 stay."""
    n = norm(a)
    return F.transform(_c(a), lambda x: x / F.when(n < 1e-12, 1.0).otherwise(n))


def cosine(a, b) -> Column:
    """Cosine, 0 where a vector is shorter than 1e-12."""
    na, nb = norm(a), norm(b)
    return F.when((na < 1e-12) | (nb < 1e-12), 0.0).otherwise(dot(a, b) / (na * nb))


def cosine_padded(a, b) -> Column:
    """Cosine with 1e-9 added to the product of the lengths."""
    return dot(a, b) / (norm(a) * norm(b) + 1e-9)


def scaled(a, weight: float) -> Column:
    return F.transform(_c(a), lambda x: x * F.lit(float(weight)))


def entropy(p) -> Column:
    """Entropy of a probability vector, values below 1e-12 as 1e-12."""
    return -F.aggregate(_c(p), F.lit(0.0), lambda s, x: s + F.greatest(x, F.lit(1e-12)) * F.log(F.greatest(x, F.lit(1e-12))))
