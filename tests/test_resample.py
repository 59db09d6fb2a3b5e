"""Draws by counters: their distribution, their intervals against a plain bootstrap, and permuted labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialforge.operators import annotation, resample
from trialforge.search import controls


def test_numbers_follow_from_their_parts(spark):
    x = spark.range(20_000).select(resample.uniform(F.lit(1), F.col("id")).alias("u"), resample.uniform(F.lit(2), F.col("id")).alias("v"))
    x = x.withColumn("t", resample.times(F.col("u"))).toPandas()
    assert x["u"].between(0, 1, inclusive="left").all() and abs(x["u"].mean() - 0.5) < 0.01 and abs(np.corrcoef(x["u"], x["v"])[0, 1]) < 0.03
    assert abs(x["t"].mean() - 1) < 0.03 and abs(x["t"].var() - 1) < 0.05
    top = spark.range(1).select(resample.times(F.lit(0.0)).alias("a"), resample.times(F.lit(1 - 2**-32)).alias("b")).first()
    assert (top.a, top.b) == (0, 12)


def test_intervals_are_those_of_a_bootstrap(spark):
    rng = np.random.default_rng(0)
    d = rng.normal(3, 2, 200)
    rows = spark.createDataFrame([("g", f"a{i}", float(x)) for i, x in enumerate(d)] + [("one", "a0", 5.0), ("none", "a1", None)], "k string, c string, v double")
    got = {r.k: r for r in resample.intervals(rows.repartition(5), ["k"], "c", "v", 2000, 7).collect()}
    means = d[rng.integers(0, 200, (5000, 200))].mean(axis=1)
    assert got["g"].n == 200 and got["g"].mean == pytest.approx(d.mean())
    assert got["g"].lo == pytest.approx(np.quantile(means, 0.025), abs=0.06) and got["g"].hi == pytest.approx(np.quantile(means, 0.975), abs=0.06)
    assert (got["one"].mean, got["one"].lo, got["one"].hi) == (5, 5, 5) and "none" not in got
    again = {r.k: r for r in resample.intervals(rows, ["k"], "c", "v", 2000, 7).collect()}
    assert again["g"].lo == pytest.approx(got["g"].lo) and resample.intervals(rows.limit(0), ["k"], "c", "v", 10, 7).count() == 0


def test_labels_stay_a_multiset_per_recording(spark):
    rows = spark.createDataFrame([(None if i % 5 == 0 else f"r{i % 3}", i, f"L{i % 7}" if i % 4 else None) for i in range(200)], "rec string, i int, label string")
    got = [controls.shuffle_labels(rows, "rec", "label", s).toPandas() for s in (5, 5, 6)]
    key = lambda d: sorted(zip(d["rec"].fillna("-"), d["label"].fillna("-")))
    full = lambda d: sorted(zip(d["rec"].fillna("-"), d["i"], d["label"].fillna("-")))
    source = rows.toPandas()
    assert all(key(g) == key(source) for g in got) and full(got[0]) == full(got[1]) != full(got[2]) and full(got[0]) != full(source)
    assert set(got[0][got[0]["label"].isna()]["i"]) == set(range(0, 200, 4))


def test_conflicts_between_bundles(spark):
    edges = spark.createDataFrame([
        ("x", "A", "B", "chemical", 3.0), ("x:w", "A", "B", "chemical", 4.5), ("x", "A", "C", "gap", 1.0), ("x:w", "B", "C", "gap", 2.0), ("x", "C", "A", "gap", 2.0), ("x:w", "C", "A", "gap", 2.0),
        ("x", "A", "D", "putative_mod", 1.0), ("y", "A", "B", "chemical", 9.0),
    ], "dataset string, pre string, post string, kind string, weight double")
    pairs = spark.createDataFrame([("x", "x:w"), ("x:w", "x"), ("y", "z"), ("x", None)], "a string, b string")
    assert sorted(tuple(r) for r in annotation.edge_conflicts(edges, pairs).collect()) == [
        ("edge_in_one_bundle_only", "A>C|gap", "1", "1@x,absent@x:w"), ("edge_in_one_bundle_only", "B>C|gap", "2", "2@x:w,absent@x"), ("synapse_count_differs", "A>B|chemical", "3,4.5", "3@x,4.5@x:w"),
    ]
    assert annotation.edge_conflicts(edges.limit(0), pairs).count() == 0
