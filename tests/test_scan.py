"""Segmented scans against pandas, on one long series over many blocks and tasks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialforge.operators import scan, scoring, windows

KINDS = "k string, t long, x double, ok boolean"


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(4)
    n = 3000
    df = pd.DataFrame({"k": ["hot"] * n + ["b"] * 7 + [None] * 5, "t": [*range(n), *range(7), *range(5)], "x": rng.normal(size=n + 12)})
    df["ok"] = rng.random(len(df)) < 0.4
    df.loc[200:1400, "ok"] = False  # a gap over many blocks
    df.loc[1700:2500, "ok"] = True  # a run over many blocks
    return df


def expected(df, f):
    return pd.concat([f(g.sort_values("t").reset_index(drop=True)) for _, g in df.groupby("k", dropna=False)])


def same(got, want, names):
    a, b = (d.assign(k=d["k"].fillna("-")).sort_values(["k", "t"]).reset_index(drop=True) for d in (got, want))
    for c in names:
        np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), atol=1e-9, err_msg=c)


@pytest.mark.parametrize("size", [1, 16, 4096])
def test_past_future_and_sums(spark, table, size):
    rows = spark.createDataFrame(table.astype(object).where(table.notna(), None), KINDS).repartition(7)
    good = F.when(F.col("ok"), F.col("x"))
    got = scan.scan(rows, ["k"], ["t"], {"a": good}, {"b": good}, {"s": F.col("ok").cast("int")}, size).toPandas()
    v = lambda g: g["x"].where(g["ok"])
    want = expected(table, lambda g: g.assign(a=v(g).shift().ffill(), b=v(g).shift(-1).bfill(), s=g["ok"].cumsum() - g["ok"]))
    same(got, want, ["a", "b", "s"])


def test_hot_series_is_spread(spark, table):
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        rows = spark.createDataFrame(table.astype(object).where(table.notna(), None), KINDS)
        out = scan.scan(rows, ["k"], ["t"], {"a": F.col("x")}, size=64)
        shares = [r["n"] for r in out.filter("k = 'hot'").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum("a")).collect()]
        assert len(shares) == 8 and max(shares) < 1000
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_operators_over_blocks(spark, table, monkeypatch):
    monkeypatch.setattr(scan.scan, "__defaults__", (None, None, None, 32))
    monkeypatch.setattr(scan, "BLOCK", 32)
    rows = spark.createDataFrame(table.astype(object).where(table.notna(), None), KINDS)
    prev = windows.previous_valid(rows, ["k"], ["t"], "x", "ok").toPandas()
    at = lambda g: g["t"].where(g["ok"]).shift().ffill()
    same(prev, expected(table, lambda g: g.assign(prev_value=g["x"].where(g["ok"]).shift().ffill(), gap=g["t"] - at(g))), ["prev_value", "gap"])
    short = windows.previous_valid(rows, ["k"], ["t"], "x", "ok", short=True).toPandas()
    same(prev, short, ["pos", "prev_value", "gap"])
    stamped = rows.withColumn("when", F.timestamp_seconds("t"))
    same(windows.previous_valid(stamped, ["k"], ["when"], "x", "ok").toPandas(), short, ["pos", "prev_value", "gap"])
    line = windows.interpolate(rows, ["k"], "t", "x", "ok").toPandas()
    same(line, expected(table, lambda g: g.assign(interp=np.interp(g["t"], g["t"][g["ok"]], g["x"][g["ok"]]) if g["ok"].any() else np.nan)), ["interp"])
    z = scoring.whiten(rows, ["k"], ["t"], "x", 0.6).toPandas()
    same(z, expected(table, lambda g: g.assign(z=((g["x"] - 0.6 * g["x"].shift()) / 0.8).fillna(g["x"]))), ["z"])
    numbered = scan.runs(rows, ["k"], "t", F.col("ok")).toPandas()
    new = lambda g: (g["ok"] & ~g["ok"].shift(fill_value=False)).cumsum().where(g["ok"])
    same(numbered, expected(table, lambda g: g.assign(run=new(g))), ["run"])


@pytest.mark.parametrize("tau", [0.1, 5.0, 20000.0])
def test_leaky_filter(spark, table, tau, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", 100)
    keep = np.exp(-1 / tau)

    def step(g):
        out = [g["x"][0]]
        for x in g["x"][1:]:
            out.append(x + (out[-1] - x) * keep)
        return g.assign(filtered=out)

    rows = spark.createDataFrame(table.astype(object).where(table.notna(), None), KINDS)
    same(scan.leaky(rows, ["k"], ["t"], "x", tau).toPandas(), expected(table, step), ["filtered"])


def test_segments_with_their_own_means(spark, table):
    rows = scan.runs(spark.createDataFrame(table.astype(object).where(table.notna(), None), KINDS), ["k"], "t", F.col("ok")).filter("run is not null and k is not null")
    got = scoring.segment_autocorr(rows, ["k"], ["run"], "t", "x", "ok", 3).toPandas().set_index("k")
    for k, g in table[table["k"].notna()].groupby("k"):
        run = (g["ok"] & ~g["ok"].shift(fill_value=False)).cumsum()[g["ok"]]
        parts = [p["x"].to_numpy() - p["x"].mean() for _, p in g[g["ok"]].groupby(run) if len(p) >= 3]
        if parts:
            assert got.loc[k, "segments"] == len(parts) and got.loc[k, "pairs"] == sum(len(p) - 1 for p in parts)
            assert got.loc[k, "lag1"] == pytest.approx(sum((p[1:] * p[:-1]).sum() for p in parts) / sum((p * p).sum() for p in parts))


def test_empty_and_repeated_rows(spark):
    none = spark.createDataFrame([], KINDS)
    assert scan.scan(none, ["k"], ["t"], {"a": F.col("x")}, {"b": F.col("x")}, {"s": F.col("x")}).count() == 0
    assert scan.leaky(none, ["k"], ["t"], "x", 3.0).count() == 0 and scan.runs(none, ["k"], "t", F.col("ok")).count() == 0
    tied = spark.createDataFrame([("a", 1, 2.0, True)] * 3, KINDS)
    assert sorted(r["s"] for r in scan.scan(tied, ["k"], ["t"], sums={"s": F.col("x")}).collect()) == [0.0, 2.0, 4.0]
    with pytest.raises(ValueError):
        scan.scan(tied, ["k"], ["t"], sums={"x": F.col("x")})
