"""Queries that run numeric tasks or streams; SQL only where it can say the same."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .. import tables
from ..models import benchmark, elimination, kernels, network, noise
from ..models.fit import Problem, fit_program, gaussian_loss
from ..operators import resample, splits, windows
from ..rules import compile_rule
from ..search import controls, plan, select
from ..sim.arrays import simulate
from ..streaming import online
from .base import read, series, with_series
from .trials import TRACE, _dff

RULE = """wrl 0.1
tier G1
state v : 1 = 0
state h : 1 = 0
param tau : s = 0.4 in [0.1, 3] trainable bits 10
param gain : 1 = 1 in [0, 4] trainable bits 10
next v = leaky_integrate(v, tanh(gain * (sum_in(v, exc) - sum_in(v, inh) + stimulus) - 0.3 * h), tau)
next h = leaky_integrate(h, relu(v), 2[s])
gap v
observe calcium_linear_v1(v, 0.5[s])
"""
BUDGET = {"tier": "G1", "max_nodes": 4, "max_depth": 4, "max_registers": 1, "ops": ["neg", "tanh", "add", "mul", "leaky_integrate", "const", "stimulus", "sum_in", "param"], "sum_in_selects": ["exc", "inh"], "constants": [1], "tau_constants": [0.5], "parameters": [{"unit": "s", "lower": 0.1, "upper": 2, "bits": 6}], "gap_variants": ["none", "unit"]}


def _graph(spark, d) -> dict:
    """A graph of the nations: what the suppliers of one sent to the customers of another, over all line items. An edge
    inhibits where more was returned than accepted."""
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("pre"))
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("post"))
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(c, "o_custkey")
    flag = lambda x: F.sum((F.col("l_returnflag") == x).cast("int"))
    x = read(spark, d, "lineitem").join(s, "l_suppkey").join(o, "l_orderkey").groupBy("pre", "post").agg(F.sum("l_quantity").alias("w"), (flag("R") > flag("A")).alias("back"))
    rows = sorted((r.pre, r.post, r.w, r.back) for r in x.collect() if r.pre != r.post)  # a row per two nations at most
    names, top = sorted({n for r in rows for n in r[:2]}), max((r[2] for r in rows), default=1.0)
    chem = [{"pre": f"s{a}", "post": f"s{b}", "weight": w / top, "sign": -1 if back else 1, "delay": b % 3} for a, b, w, back in rows]
    return {"neurons": [{"id": f"s{n}"} for n in names], "chemical": chem, "gap": [{"a": f"s{a}", "b": f"s{b}", "g": 0.2} for a, b in zip(names, names[1:])]}


def _spec(graph: dict, neuron: str, steps: int = 40) -> dict:
    return {"dt": 0.1, "n_steps": steps, "sample_ticks": list(range(0, steps + 1, 5)), "graph": graph, "stimulus": [{"neuron": neuron, "start": 2, "end": 12, "amplitude": 1.0}]}


def _each(spark, keys: list[str], work, schema: str):
    """work(key) to rows of schema, a task for each key."""
    rows = spark.createDataFrame([(k,) for k in keys], "key string")

    def run(parts):
        for p in parts:
            for k in p["key"]:
                yield work(k)

    return rows.repartition(max(1, len(keys)), "key").mapInPandas(run, schema)


def rule_simulation(spark, d):
    """The rule's observation at some ticks for a stimulus at each neuron."""
    graph = _graph(spark, d)

    def work(k):
        r = simulate(compile_rule(RULE), _spec(graph, k))
        return pd.DataFrame([(k, n, t, round(float(r.observation[i, j]), 9)) for i, t in enumerate(r.ticks) for j, n in enumerate(r.neurons)], columns=["stimulated", "neuron", "tick", "value"])

    return _each(spark, [n["id"] for n in graph["neurons"]], work, "stimulated string, neuron string, tick int, value double")


def response_kernels(spark, d):
    """Response at a few knots to a short pulse at each neuron."""
    graph = _graph(spark, d)

    def work(k):
        x = select.response_kernels(compile_rule(RULE), {"dt": 0.1, "n_steps": 1, "graph": graph}, k, 0.05, (0, 1, 2, 4, 6), 0.1)
        return pd.DataFrame([(k, n["id"], i, round(float(x[i, j]), 9)) for i in range(len(x)) for j, n in enumerate(graph["neurons"])], columns=["target", "responder", "knot", "response"])

    return _each(spark, [n["id"] for n in graph["neurons"]], work, "target string, responder string, knot int, response double")


def program_fit(spark, d):
    """Two parameters found again from traces made with known ones, from several starts."""
    graph = _graph(spark, d)
    spec = _spec(graph, graph["neurons"][0]["id"], 30)

    def work(k):
        p, rng = compile_rule(RULE), np.random.default_rng(int(k))
        y = simulate(p, spec, {"tau": 0.7, "gain": 1.5}).observation
        got, f = fit_program(Problem(p, [(spec, y + 0.01 * rng.normal(size=y.shape), np.ones(y.shape, bool))], gaussian_loss(0.01)), 1, rounds=30)
        return pd.DataFrame([(int(k), round(got["tau"], 4), round(got["gain"], 4), f.converged)], columns=["seed", "tau", "gain", "converged"])

    return _each(spark, ["1", "2", "3"], work, "seed int, tau double, gain double, converged boolean")


def noise_fit(spark, d):
    """AR(1) noise of each recording's dF/F, fitted in a task per recording."""
    rows = _dff(spark, d).filter("offset >= 0").select("recording_id", "trial_id", "offset", "dff", "dff_valid")

    def work(p: pd.DataFrame) -> pd.DataFrame:
        e = p.pivot(index="trial_id", columns="offset", values="dff").reindex(columns=range(60)).fillna(0.0).to_numpy()
        m = p.pivot(index="trial_id", columns="offset", values="dff_valid").reindex(columns=range(60)).eq(True).to_numpy()
        f = noise.fit_noise(e, m, np.full(len(e), 0.3)) if m.sum() >= 20 else noise.Noise(float("nan"), float("nan"), float("nan"))
        return pd.DataFrame([(p["recording_id"].iloc[0], int(m.sum()), f.a, f.b, f.phi)], columns=["recording_id", "n", "a", "b", "phi"])

    return rows.groupBy("recording_id").applyInPandas(work, "recording_id long, n long, a double, b double, phi double")


def animal_bootstrap(spark, d):
    """Per segment, the paired difference of spending in two statuses with its interval."""
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("a"), F.sum(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("b")).dropna()
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    x = o.join(c, "o_custkey").withColumn("d", F.col("a") - F.col("b"))
    return resample.intervals(x, ["segment"], "o_custkey", "d", 500, 7).select("segment", "n", *[F.round(k, 4).alias(k) for k in ("mean", "lo", "hi")])


def _sums(rows):
    """Moments per animal and pair of valid responses: recording_id, event_index, offset, dff."""
    x = rows.select(F.concat(F.lit("a"), F.col("recording_id") % 12).alias("animal"), F.concat(F.lit("p"), F.col("event_index") % 3).alias("pair"), F.array(F.exp(-F.col("offset") / 5.0), F.exp(-F.col("offset") / 20.0)).alias("x"), F.array(F.lit(1.0)).alias("z"), F.col("dff").alias("v"))
    return kernels.moments(x, ["animal", "pair"], 2, 1)


def _moments(spark, d):
    return _sums(_dff(spark, d).filter("offset >= 2 and dff_valid"))


def _traces(spark, d):
    """trial_id, recording_id, event_index and at: valid dF/F by offset from 2 on, 58 samples at most; written once.

    Windows meet samples by blocks of frames, so that a window is a row or two and not one for each of its frames, and
    only what dF/F is made from is dealt out by trace.
    """
    n = tables.mark()
    s = tables.scratch(series(spark, d))
    tables.release(spark)
    stimuli = s.filter("event_type = 'error'").select("recording_id", F.col("frame").alias("stim_frame"), "event_index")
    cut = windows.window_blocks(windows.schedule(stimuli).select(*TRACE, "stim_frame", "next_stim_frame"))
    met = windows.align_blocks(cut, windows.in_blocks(s.select("recording_id", "frame", "value", "valid")))
    x = windows.dff(met.filter(F.col("valid") & ~windows.masked(F.col("offset"))).select(*TRACE, "offset", "value", "valid"), TRACE)
    by = x.filter("offset >= 2 and dff_valid").groupBy(*TRACE).agg(F.map_from_entries(F.collect_list(F.struct("offset", "dff"))).alias("at"))
    out = tables.settle(by, n)
    tables.release(spark)
    return out


def kernel_moments(spark, d):
    """Sums of outer products per animal and pair, as rows (i, j)."""
    x = _moments(spark, d).select("animal", "pair", "n", F.posexplode("stat").alias("at", "value"))
    return x.select("animal", "pair", F.floor(F.col("at") / 4).alias("i"), (F.col("at") % 4).alias("j"), F.round("value", 5).alias("value"), "n")


def _animal_folds(m):
    return tables.scratch(splits.nested(m.select("animal").distinct(), "animal", 3, 3, 5))


def fold_moments(spark, d):
    """Moments of each pair's training animals, per outer fold and inner split (-1: all of them), as rows (i, j)."""
    m = tables.scratch(_moments(spark, d))
    x = elimination.split_moments(m, _animal_folds(m), ["pair"]).select("outer", "split", "pair", "n", F.posexplode("stat").alias("at", "value"))
    return x.select("outer", "split", "pair", F.floor(F.col("at") / 4).alias("i"), (F.col("at") % 4).alias("j"), F.round("value", 5).alias("value"), "n")


def independent_kernels(spark, d):
    """Each pair's kernel of two weights and the weight that all pairs share, for every split and ridge."""
    m = tables.scratch(_moments(spark, d))
    sums = tables.scratch(elimination.split_moments(m, _animal_folds(m), ["pair"]))
    own = elimination.independent(sums, ["pair"], 2, 1, (0.01, 1.0, 100.0))[1]
    return own.select("outer", "split", "ridge", "pair", *[F.round(F.col("c")[i], 6).alias(f"c{i}") for i in range(2)], F.round(F.col("b")[0], 6).alias("b"))


def kernel_folds(spark, d):
    """Nested choice of ridge by likelihood, and each animal's held-out likelihood, per outer fold and family."""
    by = _traces(spark, d)
    m = tables.scratch(_sums(by.select("recording_id", "event_index", F.explode("at").alias("offset", "dff"))))
    folds = _animal_folds(m)
    each = lambda f: F.transform(F.sequence(F.lit(2), F.lit(59)), f)
    value = lambda o: F.try_element_at("at", o)
    traces = by.select(
        F.col("trial_id").alias("trace"), F.concat(F.lit("a"), F.col("recording_id") % 12).alias("animal"), F.concat(F.lit("p"), F.col("event_index") % 3).alias("pair"), F.lit(0.3).alias("s"), each(lambda o: F.coalesce(value(o), F.lit(0.0))).alias("y"),
        each(lambda o: value(o).isNotNull()).alias("mask"), each(lambda o: F.array(F.exp(-o / 5.0), F.exp(-o / 20.0))).alias("x"), each(lambda o: F.array(F.lit(1.0))).alias("z"),
    )
    return benchmark.evaluate(traces, m, folds, ["pair"], 2, 1, ("null", "independent", "shared"), (0.01, 1.0, 100.0))


def network_kernels(spark, d):
    """Impulse responses of a linear network over the graph."""
    g = _graph(spark, d)
    net = network.Network.from_edges([(e["pre"], e["post"], e["weight"] * e["sign"]) for e in g["chemical"]], [(e["a"], e["b"], e["g"]) for e in g["gap"]])

    def work(k):
        pairs = [(k, n) for n in net.names]
        x = net.kernels(0.5, 0.6, 0.4, pairs, np.array([0.0, 0.5, 1.0, 2.0]))
        return pd.DataFrame([(k, n, j, round(float(x[i, j]), 9)) for i, n in enumerate(net.names) for j in range(4)], columns=["target", "responder", "knot", "value"])

    return _each(spark, net.names, work, "target string, responder string, knot int, value double")


def indicator_fit(spark, d):
    """Rise and decay of each recording's mean response."""
    x = _dff(spark, d).filter("offset >= 2 and dff_valid").groupBy("recording_id", "offset").agg(F.avg("dff").alias("y"))

    def work(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("offset")
        f = network.fit_indicator(p["offset"].to_numpy(float), p["y"].to_numpy()) if len(p) >= 6 else {"amplitude": float("nan"), "rise": float("nan"), "decay": float("nan")}
        return pd.DataFrame([(p["recording_id"].iloc[0], f["amplitude"], f["rise"], f["decay"])], columns=["recording_id", "amplitude", "rise", "decay"])

    return x.groupBy("recording_id").applyInPandas(work, "recording_id long, amplitude double, rise double, decay double")


def label_shuffle(spark, d):
    rows = read(spark, d, "events").select("user_id", "event_id", "event_type")
    return controls.shuffle_labels(rows, "user_id", "event_type", 11)


def intervention_gain(spark, d):
    """Which neuron to stimulate to tell three parameter settings apart."""
    graph = _graph(spark, d)
    settings = [{"tau": 0.3, "gain": 1.0}, {"tau": 0.9, "gain": 1.0}, {"tau": 0.3, "gain": 2.0}]

    def work(k):
        means = np.stack([simulate(compile_rule(RULE), _spec(graph, k), v).observation.ravel() for v in settings])
        return pd.DataFrame([(k, round(plan.information_gain(np.ones(3) / 3, means, 0.5, 500, 3)[0], 6))], columns=["neuron", "gain"])

    return _each(spark, [n["id"] for n in graph["neurons"]], work, "neuron string, gain double")


def _stream(spark, d):
    return spark.readStream.schema(read(spark, d, "events").schema).parquet(f"{d}/events.parquet*")


def _drained(df, mode: str):
    """All a stream gives, by way of files in the shared folder; in complete mode the last table."""
    spark = df.sparkSession
    path, state = tables.new_path(spark), tables.new_path(spark)
    if mode == "complete":  # files are only appended to; each trigger replaces the table
        q = df.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path)).trigger(availableNow=True).start()
    else:
        q = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def stream_windows(spark, d):
    """Counts and sums per hour and type, from a stream with a watermark."""
    x = _drained(online.windowed_counts(_stream(spark, d), "10000 days", "1 hour"), "complete")
    return x.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_filter(spark, d):
    """A first-order filter per user with its history as state."""
    return _drained(online.leaky_history(_stream(spark, d)), "append").select("user_id", "event_id", F.round("filtered", 9).alias("filtered"), F.round("delayed", 9).alias("delayed"))


QUERIES = {f.__name__: (f, None) for f in (
    rule_simulation, response_kernels, program_fit, noise_fit, animal_bootstrap, kernel_moments, kernel_folds, network_kernels, indicator_fit, label_shuffle, intervention_gain, stream_filter,
)}
QUERIES["kernel_moments"] = (kernel_moments, with_series(""", x AS (SELECT 'a' || (recording_id % 12) AS animal, 'p' || (event_index % 3) AS pair, [exp(-o / 5.0::DOUBLE), exp(-o / 20.0::DOUBLE), 1.0::DOUBLE, dff] AS a FROM dff WHERE o >= 2 AND ok)
SELECT animal, pair, i, j, round(sum(a[i + 1] * a[j + 1]), 5) AS value, count(*) AS n FROM x, range(4) r(i), range(4) c(j) GROUP BY ALL"""))
_SPLIT_SUMS = """, x AS (SELECT 'a' || (recording_id % 12) AS animal, 'p' || (event_index % 3) AS pair, [exp(-o / 5.0::DOUBLE), exp(-o / 20.0::DOUBLE), 1.0::DOUBLE, dff] AS a FROM dff WHERE o >= 2 AND ok),
f AS (SELECT animal, (row_number() OVER (ORDER BY sha256('5:outer:' || animal)) - 1) % 3 AS fold FROM (SELECT DISTINCT animal FROM x)),
t AS (SELECT o.fold AS "outer", f.animal FROM f JOIN (SELECT DISTINCT fold FROM f) o ON o.fold <> f.fold),
i AS (SELECT "outer", animal, (row_number() OVER (PARTITION BY "outer" ORDER BY sha256('5:inner' || "outer" || ':' || animal)) - 1) % 3 AS "inner" FROM t),
parts AS (SELECT i."outer", s.split, i.animal FROM i JOIN (SELECT DISTINCT "outer", "inner" AS split FROM i UNION ALL SELECT DISTINCT "outer", -1 FROM i) s ON s."outer" = i."outer" AND s.split <> i."inner"),
sums AS (SELECT "outer", split, pair, i, j, sum(a[i + 1] * a[j + 1]) AS value, count(*) AS n FROM x JOIN parts USING (animal), range(4) r(i), range(4) c(j) GROUP BY ALL)
"""
QUERIES["fold_moments"] = (fold_moments, with_series(_SPLIT_SUMS + 'SELECT "outer", split, pair, i, j, round(value, 5) AS value, n FROM sums'))
QUERIES["independent_kernels"] = (independent_kernels, with_series(_SPLIT_SUMS + """, w AS (SELECT "outer", split, pair, max(value) FILTER (WHERE i = 0 AND j = 0) AS g00, max(value) FILTER (WHERE i = 0 AND j = 1) AS g01, max(value) FILTER (WHERE i = 1 AND j = 1) AS g11,
  max(value) FILTER (WHERE i = 0 AND j = 2) AS x0, max(value) FILTER (WHERE i = 1 AND j = 2) AS x1, max(value) FILTER (WHERE i = 0 AND j = 3) AS y0, max(value) FILTER (WHERE i = 1 AND j = 3) AS y1, max(value) FILTER (WHERE i = 2 AND j = 2) AS q, max(value) FILTER (WHERE i = 2 AND j = 3) AS u FROM sums GROUP BY ALL),
l AS (SELECT *, median((g00 + g11) / 2) OVER (PARTITION BY "outer", split) AS unit FROM w),
r AS (SELECT * REPLACE (g00 + ridge * unit + 1e-9 AS g00, g11 + ridge * unit + 1e-9 AS g11) FROM l CROSS JOIN (VALUES (0.01::DOUBLE), (1.0), (100.0)) v(ridge)),
s AS (SELECT *, (g11 * x0 - g01 * x1) / (g00 * g11 - g01 * g01) AS ix0, (g00 * x1 - g01 * x0) / (g00 * g11 - g01 * g01) AS ix1, (g11 * y0 - g01 * y1) / (g00 * g11 - g01 * g01) AS iy0, (g00 * y1 - g01 * y0) / (g00 * g11 - g01 * g01) AS iy1 FROM r),
z AS (SELECT *, sum(q - x0 * ix0 - x1 * ix1) OVER c AS a, sum(u - x0 * iy0 - x1 * iy1) OVER c AS h FROM s WINDOW c AS (PARTITION BY "outer", split, ridge)),
b AS (SELECT *, h / (a + 1e-9 * (1 + a)) AS b FROM z)
SELECT "outer", split, ridge, pair, round(iy0 - ix0 * b, 6) AS c0, round(iy1 - ix1 * b, 6) AS c1, round(b, 6) AS b FROM b"""))
_TIMES = "CASE " + " ".join(f"WHEN u < {c!r} THEN {n}" for n, c in enumerate(resample.CUMULATED)) + f" ELSE {len(resample.CUMULATED)} END"
QUERIES["animal_bootstrap"] = (animal_bootstrap, f"""WITH o AS (SELECT o_custkey, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') - sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS d FROM orders GROUP BY o_custkey),
x AS (SELECT o_custkey, c_mktsegment AS segment, d FROM o JOIN customer ON c_custkey = o_custkey WHERE d IS NOT NULL),
u AS (SELECT segment, d, draw, CAST(('0x' || substr(md5('7:' || draw || ':' || o_custkey), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM x CROSS JOIN range(500) r(draw)),
m AS (SELECT segment, draw, sum(d * t) / sum(t) AS mean FROM (SELECT *, {_TIMES} AS t FROM u) GROUP BY ALL)
SELECT segment, n, round(w.mean, 4) AS mean, round(lo, 4) AS lo, round(hi, 4) AS hi FROM (SELECT segment, count(*) AS n, avg(d) AS mean FROM x GROUP BY segment) w JOIN (SELECT segment, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM m GROUP BY segment) q USING (segment)""")
QUERIES["label_shuffle"] = (label_shuffle, """WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id, event_type) AS r FROM events),
k AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY sha256('11:' || user_id || ':' || event_id || ':' || event_type), event_id) AS r FROM events)
SELECT user_id, event_id, event_type FROM p JOIN k USING (user_id, r)""")
QUERIES["stream_windows"] = (stream_windows, "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
