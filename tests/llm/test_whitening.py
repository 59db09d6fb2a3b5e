"""Whitening against numpy's eigenvectors of the exact covariance."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialforge.llm import whitening
from trialforge.llm.queries import queries


def run(spark, df, path):
    df.write.parquet(f"{path}/embeddings.parquet")
    return queries()["op12_embedding_whitening"](spark, str(path)).toPandas()


def expected(vectors):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    exact = n * x - sums
    centred = exact.astype(float) / n
    values, components = np.linalg.eigh(centred.T @ centred / n)
    values, components = values[::-1], components[:, ::-1]
    return n, (exact * exact).sum(axis=1), centred, values, components


def check(got, ids, vectors, most=32):
    n, deviation, centred, values, components = expected(vectors)
    k = min(most, len(values))
    assert len(got) == n * k and set(got.n) == {n}
    assert sorted(zip(got.vec_id, got.component)) == sorted((i, c + 1) for i in ids for c in range(k))
    dev = dict(zip(ids, deviation))
    assert all(dev[r.vec_id] == r.deviation for r in got.itertuples())
    trace = float(sum(map(int, deviation))) / n**3
    want = centred @ components[:, :k] / np.sqrt(values[:k])
    place = {i: j for j, i in enumerate(ids)}
    for c in range(k):
        part = got[got.component == c + 1]
        w = part.whitened.to_numpy()
        x = want[[place[i] for i in part.vec_id], c]
        assert min(np.abs(w - x).max(), np.abs(w + x).max()) < 1e-6
        assert np.allclose(part.explained, values[c] / trace, rtol=1e-6)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-8


def test_given_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    check(queries()["op12_embedding_whitening"](spark, sf).toPandas(), rows.vec_id.tolist(), rows.embedding.tolist())


def test_odd_rows(spark, tmp_path):
    """Nulls, entries that are null or not finite, another length and empty vectors go; repeated rows count; clashing names."""
    rng = np.random.default_rng(0)
    good = [(i, (rng.normal(size=5) * [5, 4, 3, 2, 1]).tolist()) for i in range(60)]
    bad = [(100, None), (101, []), (102, [None] * 5), (103, [1.0, float("nan"), 0.0, 0.0, 0.0]), (104, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (105, [1.0, 2.0]), (106, [0.0, None, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([*good, *bad], "vec_id long, embedding array<float>").withColumns({"x": F.lit(1), "deviation": F.lit("a")})
    got = run(spark, df, tmp_path)
    check(got, [i for i, _ in good], np.array([v for _, v in good], dtype=np.float32).tolist())


def test_more_dimensions_than_components(spark, tmp_path):
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(300, 130)) * np.linspace(9, 1, 130)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    check(run(spark, df, tmp_path), list(range(300)), v.tolist())


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (None, [1.0, 2.0])], [(1, None)]])
def test_without_variance(spark, rows, tmp_path):
    """No rows, one row or equal rows have no component: an empty result of the same columns."""
    got = run(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>"), tmp_path)
    assert not len(got) and sorted(got.columns) == ["component", "deviation", "explained", "identity_error", "n", "vec_id", "whitened"]


def test_rank_below_dimension(spark, tmp_path):
    rows = [(i, [float(i), 2.0 * i, 7.0]) for i in range(20)]
    got = run(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>"), tmp_path)
    assert set(got.component) == {1} and got.explained.iloc[0] == pytest.approx(1) and got.identity_error.iloc[0] < 1e-9


def test_exact_beyond_64_bits():
    x = np.array([[3_000_000_000, 5], [7, 9]], dtype=np.int64)
    n, sums = 4_000_000_000, np.array([10**19, 20], dtype=object)
    assert whitening.exact_squares(whitening._centred(x, n, sums)) == [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums)) for r in x]
