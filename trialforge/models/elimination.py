"""Pairs' own kernels with nuisance weights shared by all, solved by block elimination over a distributed table of moments.

A pair's block of the normal equations meets the others in the shared weights alone. Each pair's part is eliminated where
its moments lie: what it leaves on the shared weights (its Schur complement, k x k) is summed over pairs, the small system
is solved once a case, and its solution goes back to the pairs. No task holds more than a pair's moments by animal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..tables import quantiles, scratch
from .kernels import EPS, RIDGES

REFIT = -1  # the split that trains on all of an outer fold's training animals


def _kinds(rows: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)


def split_moments(moments: DataFrame, folds: DataFrame, pair: list[str]) -> DataFrame:
    """outer, split, pair, stat, n: summed moments of each pair's training animals, for every inner split (all but its own
    fold, as the total minus the fold) and for the refit. A pair that a split doesn't see has no row.

    moments: animal, pair, stat, n; folds: outer, role, inner, animal.
    """
    ship(moments.sparkSession)
    train = folds.filter("role = 'train'").select("outer", "inner", "animal")
    splits = train.select("outer", "inner").distinct().groupBy("outer").agg(F.collect_set("inner").alias("splits"))  # a few numbers a fold
    rows = moments.join(train, "animal").join(splits, "outer").select("outer", "inner", "splits", *pair, "stat", "n")

    def work(p: pd.DataFrame) -> pd.DataFrame:
        key = [p["outer"].iloc[0], *[p[c].iloc[0] for c in pair]]
        stat, n, inner = np.stack(p["stat"]).astype(float), p["n"].to_numpy(), p["inner"].to_numpy()
        total, out = stat.sum(axis=0), [(REFIT, stat.sum(axis=0), int(n.sum()))]
        for i in sorted(map(int, p["splits"].iloc[0])):
            own = inner == i
            if not own.all():
                out.append((i, total - stat[own].sum(axis=0) if own.any() else total, int(n[~own].sum())))
        return pd.DataFrame([[key[0], s, *key[1:], a, m] for s, a, m in out], columns=["outer", "split", *pair, "stat", "n"])

    return rows.groupBy("outer", *pair).applyInPandas(work, f"outer int, split int, {_kinds(moments, pair)}, stat array<double>, n long")


def _blocks(stat: pd.Series, m: int, k: int) -> tuple[np.ndarray, ...]:
    a = np.stack(stat).reshape(-1, m + k + 1, m + k + 1)
    return a[:, :m, :m], a[:, :m, m : m + k], a[:, :m, -1]


def independent(sums: DataFrame, pair: list[str], m: int, k: int, ridges: tuple[float, ...] = RIDGES) -> tuple[DataFrame, DataFrame]:
    """(shared, own): outer, split, ridge, b: the nuisance weights; and these, pair, c: each pair's kernel, from split_moments.

    A relative ridge is times the median over the split's pairs of the trace of their G over m.
    """
    ship(sums.sparkSession)
    d = m + k + 1
    case = ["outer", "split"]
    trace = F.lit(0.0)
    for i in range(m):
        trace = trace + F.col("stat")[i * d + i]
    named = sums.withColumn("__case", F.concat_ws(":", *case))
    unit = quantiles(named.select("__case", (trace / m).alias("t")), "__case", "t", {"unit": 0.5}).select("__case", "unit")
    rows = scratch(named.join(unit, "__case").drop("__case"))
    places = [(m + i) * d + m + j for i in range(k) for j in range(k + 1)]  # Q and q, row by row
    whole = rows.groupBy(*case).agg(F.array(*[F.sum(F.col("stat")[at]) for at in places]).alias("whole"))
    grid = F.explode(F.array(*[F.lit(float(r)) for r in ridges]))

    def eliminate(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if not len(p):
                continue
            g, x, y = _blocks(p["stat"], m, k)
            for r in ridges:
                z = _solved(g, np.concatenate([x, y[..., None]], axis=2), r * p["unit"].to_numpy())
                left = np.einsum("pmk,pml->pkl", x, z).reshape(len(p), -1)
                yield p[case].assign(ridge=float(r), left=list(left))

    left = rows.select(*case, "stat", "unit").mapInPandas(eliminate, "outer int, split int, ridge double, left array<double>")
    left = left.groupBy(*case, "ridge").agg(F.array(*[F.sum(F.col("left")[i]) for i in range(k * (k + 1))]).alias("left"))

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                a = (np.stack(p["whole"]) - np.stack(p["left"])).reshape(len(p), k, k + 1)
                size = np.trace(a[:, :, :k], axis1=1, axis2=2) / max(1, k)
                b = np.linalg.solve(a[:, :, :k] + EPS * (1 + size)[:, None, None] * np.eye(k), a[:, :, k:])[..., 0]
                yield p[[*case, "ridge"]].assign(b=list(b))

    shared = scratch(left.join(whole, case).mapInPandas(solve, "outer int, split int, ridge double, b array<double>"))

    def back(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                g, x, y = _blocks(p["stat"], m, k)
                rest = y - np.einsum("pmk,pk->pm", x, np.stack(p["b"]))
                c = _solved(g, rest[..., None], (p["ridge"] * p["unit"]).to_numpy())[..., 0]
                yield p[[*case, "ridge", *pair, "b"]].assign(c=list(c))

    own = rows.join(shared, case).mapInPandas(back, f"outer int, split int, ridge double, {_kinds(sums, pair)}, b array<double>, c array<double>")
    return shared, own


def _solved(g: np.ndarray, right: np.ndarray, lam: np.ndarray) -> np.ndarray:
    return np.linalg.solve(g + (lam + EPS)[:, None, None] * np.eye(g.shape[1]), right)


def null(sums: DataFrame, m: int, k: int) -> DataFrame:
    """outer, split, b: the nuisance weights without any response."""
    d = m + k + 1
    whole = sums.groupBy("outer", "split").agg(F.array(*[F.sum(F.col("stat")[(m + i) * d + m + j]) for i in range(k) for j in range(k + 1)]).alias("whole"))

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if len(p):
                a = np.stack(p["whole"]).reshape(len(p), k, k + 1)
                size = np.trace(a[:, :, :k], axis1=1, axis2=2) / max(1, k)
                b = np.linalg.solve(a[:, :, :k] + EPS * (1 + size)[:, None, None] * np.eye(k), a[:, :, k:])[..., 0]
                yield p[["outer", "split"]].assign(b=list(b))

    return whole.mapInPandas(solve, "outer int, split int, b array<double>")


def fits(moments: DataFrame, folds: DataFrame, pair: list[str], m: int, k: int, families: tuple[str, ...], ridges: tuple[float, ...] = RIDGES) -> DataFrame:
    """outer, family, split, ridge, pair, c, b of the families null and independent; a row without a pair holds b alone."""
    sums = scratch(split_moments(moments, folds, pair))
    blank = [F.lit(None).cast(dict(moments.dtypes)[c]).alias(c) for c in pair]
    none = F.lit(None).cast("array<double>").alias("c")
    parts = []
    if "null" in families:
        parts.append(null(sums, m, k).select("outer", F.lit("null").alias("family"), "split", F.lit(0.0).alias("ridge"), *blank, none, "b"))
    if "independent" in families:
        shared, own = independent(sums, pair, m, k, ridges)
        parts.append(shared.select("outer", F.lit("independent").alias("family"), "split", "ridge", *blank, none, "b"))
        parts.append(own.select("outer", F.lit("independent").alias("family"), "split", "ridge", *pair, "c", "b"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
