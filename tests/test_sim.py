"""Runs against closed forms, and the one-tick columns against the arrays."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialforge.operators import graph
from trialforge.rules import RuleError, compile_rule
from trialforge.sim.arrays import simulate
from trialforge.sim.columns import tick_columns

OBS = "\nobserve identity_v1(v)\n"


def run(body, spec, tier="G1"):
    return simulate(compile_rule(f"wrl 0.1\ntier {tier}\n{body}{OBS if 'observe' not in body else ''}"), spec)


def nodes(*names):
    return [{"id": n} for n in names]


def test_leak_and_calcium():
    spec = {"dt": 0.1, "n_steps": 20, "graph": {"neurons": nodes("A")}, "initial_state": {"v": {"A": 1.0}}}
    r = run("state v : 1 = 0\nnext v = decay(v, 0.5[s])", spec)
    assert np.allclose(r.registers["v"][:, 0], np.exp(-0.2 * np.arange(21)))
    r = run("state v : 1 = 0\nnext v = stimulus\nobserve calcium_linear_v1(v, 0.5[s])", spec | {"initial_state": {}, "stimulus": [{"neuron": "A", "start": 0, "end": 20, "amplitude": 1.0}]})
    assert np.allclose(r.observation[:, 0], 1 - np.exp(-0.2 * np.arange(21)))


def test_euler_converges():
    errors = []
    for dt in (0.1, 0.05, 0.025):
        r = run("dt_max 0.1\nstate v : 1 = 1\nnext v = euler_leak(v, 0, 0.5[s])", {"dt": dt, "n_steps": round(1 / dt), "graph": {"neurons": nodes("A")}})
        errors.append(abs(r.registers["v"][-1, 0] - math.exp(-2)))
    assert errors[1] < 0.6 * errors[0] and errors[2] < 0.6 * errors[1]


def test_delays_signs_and_history():
    g = {"neurons": nodes("A", "B"), "chemical": [{"pre": "A", "post": "B", "weight": 2.0, "sign": -1, "delay": 3}, {"pre": "A", "post": "B", "weight": 0.5, "delay": 0}]}
    spec = {"dt": 1, "n_steps": 6, "graph": g, "initial_state": {"v": {"A": 10.0}}}
    r = run("state v : 1 = 0\nstate w : 1 = 0\nnext v = v + type_mask(generic)\nnext w = sum_in(v, all)\nobserve identity_v1(w)", spec)
    a = lambda t: 10.0 + max(t, 0)
    assert r.registers["w"][1:, 1].tolist() == [0.5 * a(t) - 2 * a(t - 3) for t in range(6)]
    r = run("state v : 1 = 0\nstate w : 1 = 0\nnext v = v + 1\nnext w = delay(v, 4) + sum_in(v, inh)\nobserve identity_v1(w)", spec)
    assert r.registers["w"][1:, 1].tolist() == [max(t - 4, 0) + 2 * a(t - 3) for t in range(6)]


def test_gap():
    g = {"neurons": nodes("A", "B", "C"), "gap": [{"a": "A", "b": "B", "g": 2.0}, {"a": "B", "b": "C", "g": 1.0}]}
    r = run("state v : 1 = 0.7\ngap v", {"dt": 0.3, "n_steps": 50, "graph": g})
    assert np.allclose(r.registers["v"], 0.7)
    r = run("state v : 1 = 0\ngap v", {"dt": 0.5, "n_steps": 1, "graph": g, "initial_state": {"v": [4.0, 1.0, 0.0]}})
    assert np.allclose(r.registers["v"][1], [(4 + 0.5 * 2) / 2, (1 + 0.5 * 8) / 2.5, 0.5 / 1.5])


def test_rule_90():
    n = 16
    g = {"neurons": nodes(*map(str, range(n))), "chemical": [{"pre": str((i + d) % n), "post": str(i), "weight": 1.0} for i in range(n) for d in (-1, 1)]}
    r = run("state v : 1 = 0\nnext v = lut(count_in(v, 1), [0, 1, 0])", {"dt": 1, "n_steps": 8, "graph": g, "initial_state": {"v": {"8": 1}}}, "G0")
    x = np.eye(n)[8]
    for t in range(9):
        assert (r.registers["v"][t] == x).all()
        x = np.mod(np.roll(x, 1) + np.roll(x, -1), 2)


def test_permuted_neurons():
    rng = np.random.default_rng(2)
    names = [f"n{i}" for i in range(6)]
    chem = [{"pre": str(rng.choice(names)), "post": str(rng.choice(names)), "weight": float(rng.random()), "sign": int(rng.choice([1, -1])), "delay": int(rng.integers(0, 3))} for _ in range(14)]
    spec = {"dt": 0.1, "n_steps": 15, "graph": {"neurons": nodes(*names), "chemical": chem, "gap": [{"a": "n0", "b": "n3", "g": 1.0}]}, "stimulus": [{"neuron": "n1", "start": 2, "end": 9, "amplitude": 0.5}]}
    body = "state v : 1 = 0.1\nnext v = leaky_integrate(v, tanh(sum_in(v, exc) - sum_in(v, inh) + stimulus), 0.4[s])\ngap v"
    a = run(body, spec)
    other = spec | {"graph": spec["graph"] | {"neurons": nodes(*names[::-1])}}
    assert np.allclose(run(body, other).observation, a.observation[:, ::-1], atol=1e-14)


def test_input_errors():
    ok = {"dt": 0.1, "n_steps": 2, "graph": {"neurons": nodes("A", "B")}}
    body = "dt_max 0.2\nstate v : 1 = 0\nparam g : 1 = 1 in [0, 2] trainable bits 3\nnext v = v * g"
    for code, change in (
        ("E_INPUT", {"dt": 0.3}), ("E_INPUT", {"n_steps": -1}), ("E_INPUT", {"sample_ticks": [2, 1]}), ("E_INPUT", {"params": {"g": 3}}), ("E_INPUT", {"params": {"x": 1}}), ("E_INPUT", {"observed": ["Z"]}),
        ("E_GRAPH", {"graph": {"neurons": nodes("A", "A")}}), ("E_GRAPH", {"graph": {"neurons": nodes("A"), "gap": [{"a": "A", "b": "A", "g": 1}]}}), ("E_GRAPH", {"edits": {"delete_gap": [["A", "Z"]]}}),
        ("E_GRAPH", {"graph": {"neurons": nodes("A"), "chemical": [{"pre": "A", "post": "A", "weight": -1}]}}),
    ):
        with pytest.raises(RuleError) as e:
            run(body, ok | change)
        assert e.value.code == code, change
    with pytest.raises(RuleError) as e:
        run("state v : 1 = 2\nnext v = v * v * v", {"dt": 1, "n_steps": 30, "graph": {"neurons": nodes("A")}})
    assert e.value.code == "E_RUNTIME"


def test_columns_agree_with_arrays(spark):
    rng = np.random.default_rng(1)
    names = [f"n{i}" for i in range(8)]
    chem = [{"pre": str(rng.choice(names)), "post": str(rng.choice(names)), "weight": float(rng.random()), "sign": int(rng.choice([1, -1])), "delay": 0} for _ in range(20)]
    gap = [{"a": "n0", "b": "n1", "g": 0.5}, {"a": "n1", "b": "n4", "g": 1.5}]
    init = {n: float(x) for n, x in zip(names, rng.normal(size=8))}
    body = "state v : 1 = 0\nparam k : 1 = 0.5 fixed\nnext v = leaky_integrate(v, min(sigmoid(sum_in(v, all)), k, relu(v)) + abs(neg(v)) * threshold(v, 0.1), 0.3[s])\ngap v"
    want = run(body, {"dt": 0.1, "n_steps": 1, "graph": {"neurons": nodes(*names), "chemical": chem, "gap": gap}, "initial_state": {"v": init}}).registers["v"][1]
    edges = spark.createDataFrame([(e["pre"], e["post"], e["weight"], e["sign"], e["delay"]) for e in chem], "pre string, post string, weight double, sign int, delay int")
    state = spark.createDataFrame([(n, 0, x) for n, x in init.items()], "node string, tick int, value double")
    s = graph.sum_in(edges, state, 0, "all").withColumnRenamed("value", "s")
    x = state.join(s, state["node"] == s["post"], "left").fillna(0.0, ["s"])
    cols = tick_columns(f"wrl 0.1\ntier G1\n{body}{OBS}", 0.1, {"v": F.col("value")}, {("v", "all"): F.col("s")})
    w = x.select("node", F.col("value").alias("old"), cols["v"].alias("w"))
    got = {r.node: r.next for r in graph.gap_step(w, spark.createDataFrame([(g["a"], g["b"], g["g"]) for g in gap], "a string, b string, g double"), 0.1).collect()}
    assert np.allclose([got[n] for n in names], want, atol=1e-12)
