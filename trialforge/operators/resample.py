"""Resampling whose random numbers follow from (seed, draw, cluster), so that draws are expressions and sums combine."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distribution of a Poisson number of mean 1 up to 11; beyond lies less than one in 2**32.
CUMULATED = [sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(12)]


def uniform(*parts: Column) -> Column:
    """A number from 0 to below 1 that depends on the parts alone: 32 bits of the MD5 of their text, joined by colons."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 2**32


def times(u: Column) -> Column:
    """How often a cluster is drawn: Poisson of mean 1, the limit of drawing as many clusters as there are with replacement."""
    out = F.lit(len(CUMULATED))
    for n in reversed(range(len(CUMULATED))):
        out = F.when(u < CUMULATED[n], n).otherwise(out)
    return out


def draws(rows: DataFrame, keys: list[str], cluster: str, value: str, n: int, seed: int) -> DataFrame:
    """keys, draw, mean: of each of n draws of clusters, the mean of value over the clusters drawn, a row per cluster.

    Each row is weighted by its cluster's number in the draw, so a draw is two sums, added up in the tasks first: no
    cluster meets another. A draw without clusters has no mean; null values don't count.
    """
    each = rows.filter(F.col(value).isNotNull()).select(*keys, cluster, value, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))
    w = times(uniform(F.lit(seed), F.col("draw"), F.col(cluster)))
    sums = each.withColumn("__w", w).filter("__w > 0").groupBy(*keys, "draw").agg(F.sum(F.col("__w") * F.col(value)).alias("__s"), F.sum("__w").alias("__n"))
    return sums.select(*keys, "draw", (F.col("__s") / F.col("__n")).alias("mean"))


def intervals(rows: DataFrame, keys: list[str], cluster: str, value: str, n: int, seed: int, level: float = 0.95) -> DataFrame:
    """keys, n, mean, lo, hi: the mean of value over its clusters and the percentile interval of n draws."""
    whole = rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    at = [(1 - level) / 2, (1 + level) / 2]
    ends = draws(rows, keys, cluster, value, n, seed).groupBy(*keys).agg(*[F.percentile("mean", q).alias(k) for k, q in zip(("lo", "hi"), at)])  # n numbers a key
    return whole.join(ends, keys, "left") if keys else whole.crossJoin(ends)
