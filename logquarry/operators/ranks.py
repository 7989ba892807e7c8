"""Exact order statistics without one task that holds or orders all values.

Equal values are counted first. Of a whole table the counts are summed up in two phases, within
chunks that approximate percentiles bound, and over the totals of the chunks; of a key, its different
values are ordered by one window that can spill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .associate import running_sum

CHUNKS = 64


def _middle(value: str) -> Column:
    """The median of rows (value, upto: values up to and with this one, n: all)."""
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col(value)))
    return (at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2


def counted(x: DataFrame, value: str) -> DataFrame:
    """value, c, upto (rows with this value or a smaller one), n (all rows), for each value that is not null."""
    by = x.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    bounds = by.agg(F.percentile_approx(value, F.array(*[F.lit(i / CHUNKS) for i in range(1, CHUNKS)]), F.lit(1000)).alias("bounds"), F.sum("c").alias("n"))
    chunk = F.size(F.filter("bounds", lambda b: b < F.col(value)))
    return running_sum(by.crossJoin(F.broadcast(bounds)), "c", [value], chunk).withColumnRenamed("running", "upto").drop("bounds")


def median(x: DataFrame, value: str, name: str) -> DataFrame:
    return counted(x, value).agg(_middle(value).alias(name))


def element(x: DataFrame, value: str, share: float, name: str) -> DataFrame:
    """The element at index floor(share * n), counted from 0, n - 1 at most."""
    k = F.least(F.floor(F.lit(share) * F.col("n")), F.col("n") - 1)
    return counted(x, value).where(F.col("upto") > k).agg(F.min(value).alias(name))


def median_by(x: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The median of each key (null for keys without a value)."""
    by = x.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    n = by.groupBy(*keys).agg(F.sum("c").alias("n"))
    upto = F.sum("c").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return by.withColumn("upto", upto).join(n, keys).groupBy(*keys).agg(_middle(value).alias(name))
