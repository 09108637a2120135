"""Vector checks, normalising, pooling of excerpts, and the embedding space that vectors belong to."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunespark.functions.vectors import has_non_finite, norm, scaled
from tunespark.vocab import NORM_MIN, UNIT_TOLERANCE


class TunesparkError(ValueError):
    """Input that a job refuses."""


@dataclass(frozen=True)
class EmbeddingSpace:
    """What makes vectors comparable; the fingerprint stands on every vector row."""

    model: str
    revision: str
    dimension: int
    sample_rate: int
    window_seconds: float
    max_excerpts: int
    pooling: str = "mean"
    normalization: str = "l2"
    dtype: str = "float32"
    version: str = "1"

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def require_same_space(left: DataFrame, right: DataFrame) -> None:
    """Raises unless both sides hold vectors of one and the same space."""
    found = left.select("space_fingerprint").union(right.select("space_fingerprint")).distinct().limit(2).count()
    if found > 1:
        raise TunesparkError("vectors of different embedding spaces can't be compared")


def with_problem(df: DataFrame, dim: int, unit: bool = False, col: str = "vector") -> DataFrame:
    """df with `problem`: why its vector can't be used, or null."""
    n = norm(col)
    problem = (
        F.when(F.col(col).isNull(), "missing")
        .when(F.size(col) != dim, "dimension")
        .when(has_non_finite(col), "non-finite")
        .when(n < NORM_MIN, "zero")
        .when(F.lit(unit) & (F.abs(n - 1) > UNIT_TOLERANCE), "not unit length")
    )
    return df.withColumn("problem", problem)


def vector_problems(df: DataFrame, dim: int, unit: bool = False, key: str = "track_id") -> DataFrame:
    """(key, problem) of each row whose vector can't be used, and of each id that occurs more than once."""
    bad = with_problem(df, dim, unit).where("problem is not null").select(key, "problem")
    twice = df.groupBy(key).count().where("count > 1").select(key, F.lit("duplicate id").alias("problem"))
    return bad.unionByName(twice)


def l2_normalize(df: DataFrame, col: str = "vector") -> DataFrame:
    """df with unit vectors (floats). A zero vector becomes null; gate with with_problem() first."""
    n = norm(col)
    return df.withColumn(col, F.when(n >= NORM_MIN, scaled(F.col(col), n)))


def pool_excerpts(excerpts: DataFrame, key: str = "track_id", col: str = "vector") -> DataFrame:
    """One unit vector a key: excerpts at length 1, their mean by dimension, at length 1 again.

    Sums by (key, dimension) are made before the shuffle. A key whose excerpts all lack a usable vector doesn't appear.
    """
    unit = excerpts.withColumn("__n", norm(col)).where(F.col("__n") >= NORM_MIN)
    parts = unit.select(key, F.posexplode(F.transform(col, lambda x: x.cast("double"))).alias("pos", "x"), "__n").withColumn("x", F.col("x") / F.col("__n"))
    means = parts.groupBy(key, "pos").agg(F.avg("x").alias("x"))
    packed = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("parts"))
    pooled = packed.select(key, F.transform("parts", lambda p: p["x"]).alias(col))
    return l2_normalize(pooled, col)
