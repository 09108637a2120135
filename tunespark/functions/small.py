"""Joins against sides whose size is checked, and running totals without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast.
FEW_ROWS = 20_000
RANGES = 64


def few(df: DataFrame, most: int = FEW_ROWS) -> bool:
    """Whether df has at most so many rows; looks at no more than that."""
    return df.limit(most + 1).count() <= most


def maybe_broadcast(df: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    return F.broadcast(df) if few(df, most) else df


def pair_up(many: DataFrame, requests: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """Each request with each row of many, a stated request set against all rows: requests are broadcast in blocks of bounded size."""
    if few(requests, most):
        return many.crossJoin(F.broadcast(requests))
    blocks = -(-requests.count() // most)
    keyed = requests.withColumn("__block", F.pmod(F.xxhash64(*requests.columns), F.lit(2 * blocks)))
    out = None
    for b in range(2 * blocks):
        part = many.crossJoin(F.broadcast(keyed.where(F.col("__block") == b).drop("__block")))
        out = part if out is None else out.unionByName(part)
    return out


def ranges(df: DataFrame, value: str) -> Column:
    """Number of the range that a value falls in, by split points read off approximate quantiles (at most RANGES numbers)."""
    splits = sorted(set(df.approxQuantile(value, [i / RANGES for i in range(1, RANGES)], 0.005)))
    if not splits:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, splits)), lambda s: s < F.col(value)))


def counts_below(df: DataFrame, value: str) -> DataFrame:
    """(value, below, through, total) for each distinct non-null value: rows under it, rows up to it, all rows.

    Counts are summed by value first; running totals are taken inside ranges and shifted by the ranges' totals.
    """
    own = df.where(F.col(value).isNotNull())
    counted = own.groupBy(value).agg(F.count("*").alias("own")).withColumn("range", ranges(own, value))
    totals = {r["range"]: r["n"] for r in counted.groupBy("range").agg(F.sum("own").alias("n")).collect()}
    before, shift = 0, {}
    for k in sorted(totals):
        shift[k] = before
        before += totals[k]
    table = F.create_map(*[F.lit(x) for k, v in shift.items() for x in (k, v)]) if shift else F.create_map(F.lit(0), F.lit(0))
    running = F.sum("own").over(Window.partitionBy("range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    through = running + table[F.col("range")]
    return counted.select(value, (through - F.col("own")).alias("below"), through.alias("through"), F.lit(before).alias("total"))


def previous_value(df: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """df with `name`: the value of the row before, by order (a number), of the same key; null for the first.

    Rows are looked up inside value ranges of `order`; only the last value of each range and key is passed on, so that a key of any size is spread.
    """
    marked = df.withColumn("__range", ranges(df, order))
    lasts = marked.groupBy(key, "__range").agg(F.max_by(value, order).alias("__last"))
    handed = lasts.withColumn("__handed", F.lag("__last").over(Window.partitionBy(key).orderBy("__range"))).drop("__last")
    inside = F.lag(value).over(Window.partitionBy(key, "__range").orderBy(order))
    return marked.withColumn("__inside", inside).join(handed, [key, "__range"]).withColumn(name, F.coalesce("__inside", "__handed")).drop("__range", "__inside", "__handed")


def running_total(df: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """df with `name`: the sum of value over the rows of the same key before each row, by order (a number; rows of one key differ in it).

    Sums run inside value ranges of `order` and are shifted by the totals of the ranges before, so that a key of any size is spread.
    """
    marked = df.withColumn("__range", ranges(df, order))
    totals = marked.groupBy(key, "__range").agg(F.sum(value).alias("__total"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.withColumn("__shift", F.coalesce(F.sum("__total").over(before.partitionBy(key).orderBy("__range")), F.lit(0))).drop("__total")
    inside = F.coalesce(F.sum(value).over(before.partitionBy(key, "__range").orderBy(order)), F.lit(0))
    return marked.withColumn("__inside", inside).join(shifts, [key, "__range"]).withColumn(name, F.col("__inside") + F.col("__shift")).drop("__range", "__inside", "__shift")
