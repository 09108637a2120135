"""Column functions on vectors (arrays of numbers), in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tunespark.vocab import NORM_MIN


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column | str, b: Column | str, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine clipped to [-1, 1], as a float: ties are ties of floats. Null where the vectors differ in length or lack a component."""
    value = dot(a, b) / ((norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b))
    return F.when(value > 1, 1.0).when(value < -1, -1.0).otherwise(value).cast("float")


def usable(v: Column | str) -> Column:
    """Whether a vector can be compared: there, finite, and not shorter than NORM_MIN."""
    return F.coalesce(~has_non_finite(v) & (norm(v) >= NORM_MIN), F.lit(False))


def scaled(v: Column | str, by: Column) -> Column:
    return F.transform(v, lambda x: (x.cast("double") / by).cast("float"))


def has_non_finite(v: Column | str) -> Column:
    return F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
