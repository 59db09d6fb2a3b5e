"""Embedding whitening: MLlib's SVD of centred rows, singular values rescaled by the number of rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import scratch, table

#: Fixed by the contract: an entry c becomes floor(64 * c) + 1000000.
SCALE, SHIFT = 64, 1_000_000


@dataclass(frozen=True)
class Whitening:
    """n rows, their sums by dimension (whole numbers), components as columns, eigenvalues of the covariance, its trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float


def usable(vector: Column) -> Column:
    """Whether a vector has entries, and neither a null nor one that isn't finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(F.exists(vector, lambda x: bad(x.cast("double"))), F.lit(True))


def quantised(rows: DataFrame, vector: str = "embedding", x: str = "x") -> DataFrame:
    """The rows with a usable vector of the most frequent length (of equally frequent ones the greatest), and x, its
    entries as whole numbers; an entry of 2**57 or more is an error."""
    good = rows.filter(usable(F.col(vector)))
    size = good.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    good = good.filter(F.size(vector) == (size["d"] if size else 0))
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    return good.withColumn(x, F.when(usable(F.col(vector)), whole))  # a filter may be run after what it guards


def fit(rows: DataFrame, x: str = "x", most: int = 32) -> Whitening | None:
    """The first components, at most so many, of the column x of whole numbers (all of one length); None without rows.

    Means are exact sums over n; rows are centred before they are multiplied. MLlib's computeSVD gives singular values s
    of the centred rows: s * s / n is an eigenvalue of the covariance with divisor n. The trace is the sum of exact
    squared deviations. A component beyond the numerical rank (its eigenvalue under 1e-12 of the greatest, which a product
    of doubles doesn't tell from 0) isn't returned, so rows that are all equal have none. The driver holds a matrix of the dimension's square.
    """
    spark = rows.sparkSession
    by_place = rows.select(F.posexplode(x).alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).orderBy("i").collect()
    if not by_place:
        return None
    n, sums = by_place[0]["n"], [int(r["s"]) for r in by_place]
    ship(spark)
    held = rows.select(F.transform(F.arrays_zip(F.col(x).alias("v"), F.lit(sums).alias("s")), lambda e: (e["v"] * n - e["s"]).cast("double") / n).alias("row"))
    held = MLUtils.convertVectorColumnsFromML(held.select(array_to_vector("row").alias("row")), "row")
    total = sum(r["d"] for r in deviations(rows.select(x), sums, n, x).select(F.col("deviation").alias("v")).agg(F.sum("v").alias("d")).collect() if r["d"] is not None)
    trace = int(total) / n**3
    if not total:
        return Whitening(n, np.array(sums, dtype=object), np.zeros((len(sums), 0)), np.zeros(0), 0.0)
    found = RowMatrix(held, n, len(sums)).computeSVD(min(most, len(sums)), computeU=False)
    values = found.s.toArray() ** 2 / n
    told = values > 1e-12 * values.max()
    return Whitening(n, np.array(sums, dtype=object), found.V.toArray()[:, told], values[told], trace)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact: in 64 bits where they suffice, else in whole numbers of any size."""
    if (int(np.abs(x).max(initial=0)) + 1) * n + int(max(map(abs, sums), default=0)) < 2**63:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def deviations(rows: DataFrame, sums: list[int], n: int, x: str = "x") -> DataFrame:
    """The rows' exact squared deviations, sum of (n * x - sums) ** 2, as a decimal."""
    by = np.array(sums, dtype=object)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array(exact_squares(_centred(_matrix(b.column(0)), n, by)), pa.decimal128(38))], names=["deviation"])

    return rows.select(x).mapInArrow(work, "deviation decimal(38,0)")


def exact_squares(c: np.ndarray) -> list[int]:
    """The sum of squares of each row of whole numbers."""
    most = max(map(abs, (int(c.max(initial=0)), int(c.min(initial=0)))))
    return (c * c).sum(axis=1).tolist() if most * most * max(1, c.shape[1]) < 2**63 else (c.astype(object) ** 2).sum(axis=1).tolist()


def whiten(rows: DataFrame, model: Whitening, x: str = "x") -> DataFrame:
    """The rows without x, and deviation decimal (exact) and whitened array<double>, one entry a component. Nothing is shuffled."""
    names = [c for c in rows.columns if c != x]
    if taken := {"deviation", "whitened"} & set(names):
        raise ValueError(f"columns must be renamed first: {', '.join(sorted(taken))}")
    ship(rows.sparkSession)
    scaled = model.components / np.sqrt(model.values)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                c = _centred(_matrix(b.column(x)), model.n, model.sums)
                out = (c.astype(np.float64) / model.n) @ scaled
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1], pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([*[b.column(k) for k in names], pa.array(exact_squares(c), pa.decimal128(38)), flat], names=[*names, "deviation", "whitened"])

    kinds = dict((f.name, f.dataType.simpleString()) for f in rows.schema)
    return rows.select(*names, x).mapInArrow(work, ", ".join([*(f"`{k}` {kinds[k]}" for k in names), "deviation decimal(38,0)", "whitened array<double>"]))


def identity_error(whitened: DataFrame, column: str = "whitened") -> float:
    """The largest absolute entry of the covariance of column (divisor n, centred before multiplying) minus the identity; 0 without rows or entries."""
    n, size = whitened.agg(F.count("*"), F.max(F.size(column))).first()
    if not n or not size or size < 0:
        return 0.0
    means = np.array([r["m"] for r in whitened.select(F.posexplode(column).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").collect()])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in batches:
            y = _matrix(b.column(0)) - means
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], names=["i", "v"])

    products = whitened.select(column).mapInArrow(work, "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))
    return float(products.select(F.max(F.abs(F.col("v") / n - F.when(F.col("i") % (size + 1) == 0, 1.0).otherwise(0.0)))).first()[0])


def op12_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    rows = quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", "x")
    model = fit(rows)
    none = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return spark.createDataFrame([], none)
    white = scratch(whiten(rows, model))
    share = F.lit([float(v) for v in model.values / model.trace])
    out = white.select("vec_id", F.lit(model.n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("i", "whitened"), F.lit(identity_error(white)).alias("identity_error"))
    return out.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get(share, F.col("i")).alias("explained"), "identity_error")
