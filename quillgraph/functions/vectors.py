"""Vector metrics as native expressions in double precision. Higher is nearer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """Of length 1; a zero vector stays as it is."""
    return F.when(norm(a) == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x / norm(a)))


def cosine(a: Column, b: Column) -> Column:
    """0 if a vector is zero."""
    return F.when((norm(a) == 0) | (norm(b) == 0), F.lit(0.0)).otherwise(dot(a, b) / (norm(a) * norm(b)))


def euclid(a: Column, b: Column) -> Column:
    """Minus the squared distance."""
    return 0.0 - F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


METRICS = {"cosine": cosine, "dot": dot, "euclid": euclid}


def score(metric: str, a: Column, query: list[float] | Column) -> Column:
    return METRICS[metric](a, query if isinstance(query, Column) else F.array(*(F.lit(float(x)) for x in query)))
