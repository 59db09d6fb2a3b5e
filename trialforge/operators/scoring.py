"""Masked AR(1) scores, moments and calibration as window and aggregate expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import scan
from .windows import previous_valid

LEAST_VAR = 1e-12


def sigma(a: float, b: float, s: Column) -> Column:
    """sqrt(a^2 s^2 + b^2), s counting as 0 where unknown."""
    known = F.coalesce(F.when(F.isnan(s), None).otherwise(s), F.lit(0.0))
    return F.sqrt(F.lit(a * a) * known * known + F.lit(b * b))


def ar1_nll(rows: DataFrame, keys: list[str], order: list[str], value: str, valid: str, sd: Column, phi: float, nu: float | None = None) -> DataFrame:
    """keys, n, nll: exact negative log likelihood of the valid samples of a stationary AR(1), gaps bridged by phi^gap. A key has the
    few rows of a trace.

    nu: Student-t innovations of that many degrees of freedom with the same scale, else Gaussian.
    """
    out = previous_valid(rows, keys, order, value, valid, short=True).filter(F.col(valid)).withColumn("sd", sd)
    rho = F.when(F.col("gap").isNull(), 0.0).otherwise(F.pow(F.lit(phi), F.col("gap")))
    var = F.greatest(1 - rho * rho, F.lit(LEAST_VAR)) * F.col("sd") * F.col("sd")
    e = F.col(value) - rho * F.coalesce("prev_value", F.lit(0.0))
    if nu is None:
        one = 0.5 * (math.log(2 * math.pi) + F.log(var) + e * e / var)
    else:
        const = math.lgamma(nu / 2) - math.lgamma((nu + 1) / 2) + 0.5 * math.log(nu * math.pi)
        one = F.lit(const) + 0.5 * F.log(var) + (nu + 1) / 2 * F.log1p(e * e / (nu * var))
    return out.withColumn("one", one).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("one").alias("nll"))


def whiten(rows: DataFrame, keys: list[str], order: list[str], value: str, phi: float) -> DataFrame:
    """rows with z: the innovations of an AR(1) of unit variance, the first sample as it is."""
    out = scan(rows, keys, order, past={"__row": F.struct(F.col(value).alias("v"))})
    prev = F.col("__row.v")
    return out.withColumn("z", F.when(prev.isNull(), F.col(value)).otherwise((F.col(value) - phi * prev) / math.sqrt(1 - phi * phi))).drop("__row")


def segment_autocorr(rows: DataFrame, by: list[str], segment: list[str], order: str, value: str, valid: str, least: int = 2, short: bool = False) -> DataFrame:
    """by, segments, pairs, lag1: the lag-1 autocorrelation of segments of samples (their keys, beside by) that are valid
    throughout and have least samples or more, each less its own mean: summed products of neighbours over summed squares.
    short: segments are windows of few rows."""
    keys = [*by, *segment]
    whole = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.count_if(F.col(valid)).alias("__ok"), F.avg(value).alias("__m")).filter((F.col("__n") == F.col("__ok")) & (F.col("__n") >= least))
    x = rows.join(whole, keys).withColumn("__c", F.col(value) - F.col("__m"))
    x, row = x.select(*keys, order, "__c"), F.struct("__c")
    x = x.withColumn("__row", F.lag(row).over(Window.partitionBy(*keys).orderBy(order))) if short else scan(x, keys, [order], past={"__row": row})
    prev = F.col("__row.__c")
    return x.groupBy(*by).agg(F.count_if(prev.isNull()).alias("segments"), F.count(prev).alias("pairs"), (F.sum(F.col("__c") * prev) / F.nullif(F.sum(F.col("__c") * F.col("__c")), F.lit(0.0))).alias("lag1"))


def variance_components(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One row: n, groups, within and between variance by one-way random-effects ANOVA on unbalanced groups."""
    by = rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).filter("n > 0")
    tot = by.agg(F.sum("n").alias("__N"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("v")).alias("ssw"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    both = by.crossJoin(F.broadcast(tot)).groupBy("__N", "k", "ssw", "nn").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)).alias("ssb"))  # tot: one row
    msw = F.col("ssw") / F.nullif(F.col("__N") - F.col("k"), F.lit(0))
    msb = F.col("ssb") / F.nullif(F.col("k") - 1, F.lit(0))
    n0 = (F.col("__N") - F.col("nn") / F.col("__N")) / F.nullif(F.col("k") - 1, F.lit(0))
    return both.select(F.col("__N").alias("n"), F.col("k").alias("groups"), msw.alias("within"), F.greatest((msb - msw) / n0, F.lit(0.0)).alias("between"))


def coverage(rows: DataFrame, keys: list[str], z: Column, levels: dict[str, float]) -> DataFrame:
    """Share of |z| within each level's quantile, by name."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg((F.abs(z) <= q).cast("double")).alias(k) for k, q in levels.items()])


def weights(rows: DataFrame, nll: Column, bits: Column, temperature: float = 1.0) -> DataFrame:
    """rows with weight, proportional to exp(-nll / temperature - bits ln 2), shifted by the largest exponent."""
    x = -nll / temperature - bits * math.log(2)
    top = rows.agg(F.max(x).alias("__top"))
    shifted = rows.crossJoin(F.broadcast(top)).withColumn("__e", F.exp(x - F.col("__top")))
    total = shifted.agg(F.sum("__e").alias("__sum"))
    return shifted.crossJoin(F.broadcast(total)).withColumn("weight", F.col("__e") / F.col("__sum")).drop("__e", "__top", "__sum")
