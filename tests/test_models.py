"""Numeric models against closed forms and known truths."""

import math

import numpy as np
import pandas as pd
import pytest

from trialforge.models import benchmark as B
from trialforge.models import kernels as K
from trialforge.models.fit import Problem, fit_program, from_raw, gaussian_loss, quantise, standard_errors, starts, to_raw
from trialforge.models.network import Network, bandwidth, fit_indicator, fit_network, impulse, synthetic
from trialforge.models.noise import Noise, block_moments, drop_one, fit_noise, paired_bootstrap, trace_nll
from trialforge.models.optimize import expm, least_squares, logsumexp, minimise
from trialforge.rules import compile_rule
from trialforge.sim.arrays import simulate


def test_optimisers():
    rosen = lambda x: 100 * (x[1] - x[0] ** 2) ** 2 + (1 - x[0]) ** 2
    assert np.allclose(minimise(rosen, np.array([-1.2, 1.0]), rounds=500).x, 1, atol=1e-3)
    assert np.allclose(minimise(rosen, np.array([-1.2, 0.2]), [(-2, 0.5), (-1, 2)], rounds=500).x, [0.5, 0.25], atol=1e-4)
    t = np.linspace(0, 3, 40)
    assert np.allclose(least_squares(lambda z: z[0] * np.exp(-z[1] * t) - 2 * np.exp(-0.7 * t), np.array([1.0, 1.0])).x, [2, 0.7], atol=1e-6)
    a = np.array([[0.0, -2.0], [2.0, 0.0]])
    assert np.allclose(expm(a), [[math.cos(2), -math.sin(2)], [math.sin(2), math.cos(2)]]) and np.allclose(expm(np.diag([1.0, -30.0])), np.diag(np.exp([1.0, -30.0])))
    assert logsumexp(np.array([1000.0, 1000.0])) == pytest.approx(1000 + math.log(2))


def test_masked_nll_is_the_marginal_gaussian():
    rng = np.random.default_rng(0)
    n, noise, s = 12, Noise(1.0, 0.1, 0.6), 0.3
    e, mask = rng.normal(size=(1, n)), rng.random((1, n)) < 0.6
    at = np.flatnonzero(mask[0])
    cov = noise.sd(np.array([s]))[0] ** 2 * 0.6 ** np.abs(np.subtract.outer(at, at))
    x = e[0, at]
    want = 0.5 * (len(at) * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + x @ np.linalg.solve(cov, x))
    assert trace_nll(e, mask, np.array([s]), noise)[0] == pytest.approx(want)
    wide = trace_nll(e, mask, np.array([s]), Noise(1.0, 0.1, 0.6, 1e7))[0]
    assert wide == pytest.approx(want, abs=1e-4)


def test_noise_recovery_and_blocks():
    rng = np.random.default_rng(1)
    s = rng.uniform(0.1, 0.3, 300)
    e = rng.normal(size=(300, 60))
    for t in range(1, 60):
        e[:, t] = 0.5 * e[:, t - 1] + math.sqrt(0.75) * e[:, t]
    e *= np.sqrt(1.0 * s**2 + 0.1**2)[:, None]
    fit = fit_noise(e, rng.random(e.shape) < 0.8, s)
    assert fit.phi == pytest.approx(0.5, abs=0.03) and fit.a == pytest.approx(1.0, abs=0.1) and fit.b == pytest.approx(0.1, abs=0.03)
    count, var = block_moments(np.array([[True, True, False, True]]), 0.5, 2)
    assert count.tolist() == [[2, 1]] and var.tolist() == [[(2 + 2 * 0.5) / 4, 1.0]]


def test_bootstrap():
    a = {f"a{i}": float(i) for i in range(20)}
    b = {k: v - 1 for k, v in a.items()}
    r = paired_bootstrap(a, b, 3)
    assert r["mean"] == r["lo"] == r["hi"] == 1.0 and r == paired_bootstrap(a, b, 3)
    with pytest.raises(ValueError):
        paired_bootstrap(a, {"x": 1.0}, 0)
    assert drop_one({"a": 1.0, "b": 3.0}) == {"a": 3.0, "b": 1.0}


def stats(rng, shared, p=8, m=5, k=2, n=200):
    """Rows of a made-up linear truth, as moments per pair."""
    base, b, rows = rng.normal(size=m), rng.normal(size=k), []
    for i in range(p):
        c = rng.normal() * base if shared else rng.normal(size=m)
        x, z = rng.normal(size=(n, m)), rng.normal(size=(n, k))
        a = np.column_stack([x, z, x @ c + z @ b + 0.1 * rng.normal(size=n)])
        rows.append({"pair": i, "stat": (a.T @ a).ravel(), "n": n, "c": c})
    return pd.DataFrame(rows), b


def test_kernel_families():
    rng = np.random.default_rng(5)
    rows, b = stats(rng, False)
    s = K.stack(rows, ["pair"], 5, 2)
    f = K.fit_independent(s, 1e-6)
    assert np.allclose(f.c, np.stack(rows["c"]), atol=0.05) and np.allclose(f.b, b, atol=0.05)
    lam = f.extra["lam"]
    base = K.loss(s, f.c, f.b, lam)
    for _ in range(20):
        assert K.loss(s, f.c + 0.01 * rng.normal(size=f.c.shape), f.b + 0.01 * rng.normal(size=2), lam) > base
    shared, _ = stats(rng, True)
    t = K.stack(shared, ["pair"], 5, 2)
    one, own, flat = K.fit_shared(t, 1e-4), K.fit_independent(t, 1e-4), K.fit_null(t)
    assert K.loss(t, one.c, one.b) / t.n < 0.011 and K.loss(t, flat.c, flat.b) > 10 * K.loss(t, one.c, one.b)
    assert np.linalg.matrix_rank(one.c, tol=1e-8) == 1 and K.loss(s, *(lambda g: (g.c, g.b))(K.fit_shared(s, 1e-4))) > 5 * K.loss(s, f.c, f.b)
    two = K.fit_low_rank(t, 1e-4, 2)
    assert np.linalg.matrix_rank(two.c, tol=1e-8) <= 2 and K.loss(t, two.c, two.b) <= K.loss(t, one.c, one.b) * 1.001
    assert (own.kernel(t, "never seen") == 0).all()


def test_kernels_by_target():
    """Two targets with a kernel each: one shared kernel can't hold both, a kernel per target does; no loss per pair grows."""
    rng = np.random.default_rng(8)
    shapes, rows = rng.normal(size=(2, 5)), []
    for target in range(2):
        for j in range(5):
            c, x, z = rng.normal() * shapes[target], rng.normal(size=(200, 5)), rng.normal(size=(200, 1))
            a = np.column_stack([x, z, x @ c + 0.3 * z[:, 0] + 0.1 * rng.normal(size=200)])
            rows.append({"target": f"t{target}", "responder": j, "stat": (a.T @ a).ravel(), "n": 200, "c": c})
    rows = pd.DataFrame(rows)
    s = K.stack(rows, ["target", "responder"], 5, 1)
    f = K.fit_shared(s, 1e-6)
    assert np.allclose(f.c, np.stack(rows["c"]), atol=0.06) and f.extra["kernels"].shape == (2, 5)
    together = K.fit_shared(s, 1e-6, groups=np.zeros(10, int))
    assert K.loss(s, together.c, together.b) > 3 * K.loss(s, f.c, f.b)
    for t in range(2):
        assert np.linalg.matrix_rank(f.c[5 * t : 5 * t + 5], tol=1e-8) == 1
    losses = [K.loss(s, *(lambda g: (g.c, g.b))(K.FAMILIES[k](s, 1e-6))) for k in ("rank1", "rank2", "rank4", "independent")]
    assert all(x >= y - 1e-6 for x, y in zip(losses, losses[1:])) and losses[1] < 1.1 * losses[3]
    warm = K.fit_shared(s, 1e-6, start=f.extra["kernels"])
    assert np.allclose(warm.c, f.c, atol=1e-4)


def test_delays():
    knots = np.arange(9)
    s3 = K.shift(9, knots, 2)
    assert np.allclose(s3 @ np.arange(9.0), [0, 0, 0, 1, 2, 3, 4, 5, 6])
    assert np.allclose(K.shift(9, knots, 0), np.eye(9))


def test_moments_and_folds(spark):
    rng = np.random.default_rng(7)
    rows, truth = [], rng.normal(size=(2, 3))
    for animal in range(6):
        for pair in range(2):
            for _ in range(15):
                x, z = rng.normal(size=3), np.ones(1)
                rows.append((f"a{animal}", pair, x.tolist(), z.tolist(), float(x @ truth[pair] + 0.5 + 0.1 * rng.normal())))
    df = spark.createDataFrame(rows, "animal string, pair int, x array<double>, z array<double>, v double")
    m = K.moments(df, ["animal", "pair"], 3, 1)
    got = {(r.animal, r.pair): np.array(r.stat).reshape(5, 5) for r in m.collect()}
    for key, a in got.items():
        part = np.array([[*r[2], *r[3], r[4]] for r in rows if (r[0], r[1]) == key])
        assert np.allclose(a, part.T @ part)
    s = K.stack(m.toPandas(), ["pair"], 3, 1)
    null, own = K.fit_null(s), K.fit_independent(s, 0.01)
    assert K.loss(s, own.c, own.b) < 0.1 * K.loss(s, null.c, null.b)


def test_benchmark_by_plain_loops(spark):
    """Ridges by inner likelihood with refitted noise, and test scores, against loops over folds, ridges and traces."""
    rng = np.random.default_rng(3)
    truth, t = rng.normal(size=(3, 2)), np.arange(12)
    traces, rows = [], []
    for animal in range(6):
        for pair in range(3):
            for j in range(3):
                if pair == 2 and animal > 3:
                    continue
                x = np.stack([np.exp(-t / 3.0), np.exp(-t / 9.0)], axis=1) * rng.uniform(0.5, 2)
                y = x @ truth[pair] + 0.3 + 0.2 * rng.normal(size=12)
                mask = rng.random(12) < 0.9
                traces.append((f"{animal}-{pair}-{j}", f"a{animal}", f"p{pair}", float(rng.uniform(0.1, 0.3)), y.tolist(), mask.tolist(), x.tolist(), np.ones((12, 1)).tolist()))
                rows += [(f"a{animal}", f"p{pair}", x[i].tolist(), [1.0], float(y[i])) for i in np.flatnonzero(mask)]
    df = spark.createDataFrame(traces, "trace string, animal string, pair string, s double, y array<double>, mask array<boolean>, x array<array<double>>, z array<array<double>>")
    m = K.moments(spark.createDataFrame(rows, "animal string, pair string, x array<double>, z array<double>, v double"), ["animal", "pair"], 2, 1)
    split = [(o, "test" if i % 2 == o else "train", (i // 2) % 2 if i % 2 != o else None, f"a{i}") for o in range(2) for i in range(6)]
    folds, ridges, families = spark.createDataFrame(split, "outer int, role string, inner int, animal string"), (0.01, 100.0), ("null", "independent", "shared", "rank1")
    got = {(r.outer, r.family, r.animal): (r.ridge, r.nll, r.samples, r.traces) for r in B.evaluate(df, m, folds, ["pair"], 2, 1, families, ridges).collect()}
    table = m.toPandas()
    want = {}

    def fit(animals, family, r):
        s = K.stack(table[table["animal"].isin(animals)], ["pair"], 2, 1)
        f = K.FAMILIES[family](s, r)
        c = dict(zip([p[0] if isinstance(p, tuple) else p for p in s.pairs], f.c))
        left = {x[0]: np.array(x[4]) - np.array(x[6]) @ c.get(x[2], np.zeros(2)) - np.array(x[7]) @ f.b for x in traces}
        pick = lambda names: [x for x in traces if x[1] in names]
        parts = lambda xs: (np.stack([left[x[0]] for x in xs]), np.array([x[5] for x in xs]), np.array([x[3] for x in xs]))
        return lambda names: (lambda xs: dict(zip([x[0] for x in xs], trace_nll(*parts(xs), fit_noise(*parts(pick(animals)))))))(pick(names))

    for o in range(2):
        train = {x[3]: x[2] for x in split if x[0] == o and x[1] == "train"}
        test = [x[3] for x in split if x[0] == o and x[1] == "test"]
        for family in families:
            grid = (0.0,) if family == "null" else ridges
            score = {r: sum(sum(fit([a for a in train if train[a] != i], family, r)([a for a in train if train[a] == i]).values()) for i in (0, 1)) for r in grid}
            best = min(grid, key=lambda r: (score[r], r))
            nll = fit(list(train), family, best)(test)
            for a in test:
                mine = [x for x in traces if x[1] == a]
                want[o, family, a] = (best, sum(nll[x[0]] for x in mine), sum(sum(x[5]) for x in mine), len(mine))
    assert set(got) == set(want)
    for key, w in want.items():
        assert got[key][0] == w[0] and got[key][1] == pytest.approx(w[1], rel=2e-3, abs=0.05) and got[key][2:] == w[2:]
    assert sum(got[o, "independent", a][1] for o, f, a in got if f == "null") < sum(got[k][1] for k in got if k[1] == "null")


def test_network_and_indicator():
    net = Network.from_edges([("A", "B", 1.0), ("B", "C", 2.0), ("C", "A", -1.0)], [("A", "C", 1.0)])
    t = np.linspace(0, 5, 12)
    pairs = [("A", "B"), ("A", "C"), ("B", "C"), ("A", "Z")]
    k = net.kernels(0.8, 0.6, 0.5, pairs, t)
    assert (k[3] == 0).all() and np.allclose(k[0], [expm(net.system(0.8, 0.6, 0.5) * x)[1, 0] for x in t])
    found, _ = fit_network(net, pairs, t, 3.0 * k)
    assert found["tau"] == pytest.approx(0.8, rel=0.05) and found["chem"] == pytest.approx(0.6, rel=0.05) and found["gain"] == pytest.approx(3.0, rel=0.05)
    x = np.linspace(0, 30, 2000)
    y = impulse(x, 0.5, 3.0)
    assert y.max() == pytest.approx(1.0, abs=1e-4)
    f = fit_indicator(x, 2 * y)
    assert f["amplitude"] == pytest.approx(2, rel=1e-3) and f["rise"] == pytest.approx(0.5, rel=1e-2) and f["decay"] == pytest.approx(3.0, rel=1e-2)
    assert bandwidth(y[::20], 0.3, 0.1, 4) < bandwidth(y[::20], 0.3, 0.1, 400)
    a, b = synthetic(1, True), synthetic(1, True)
    assert all((a[k] == b[k]).all() for k in a) and len(a["y"]) == 16 * 4 * 6 * 2 and abs(a["mask"].mean() - 0.8) < 0.01
    assert np.linalg.matrix_rank(a["kernels"], tol=1e-8) == 1 < np.linalg.matrix_rank(synthetic(1, False)["kernels"], tol=1e-8)


RULE = "wrl 0.1\ntier G1\nstate v : 1 = 0\nparam tau : s = 1 in [0.1, 3] trainable bits 8\nparam gain : 1 = 1 in [0, 5] trainable bits 8\nnext v = leaky_integrate(v, gain * stimulus + 0.5 * sum_in(v, exc), tau)\nobserve identity_v1(v)\n"


def test_parameter_recovery():
    p = compile_rule(RULE)
    spec = {"dt": 0.1, "n_steps": 60, "graph": {"neurons": [{"id": "A"}, {"id": "B"}], "chemical": [{"pre": "A", "post": "B", "weight": 0.8}]}, "stimulus": [{"neuron": "A", "start": 5, "end": 30, "amplitude": 1.0}]}
    rng = np.random.default_rng(3)
    y = simulate(p, spec, {"tau": 0.35, "gain": 1.6}).observation
    y = y + 0.02 * rng.normal(size=y.shape)
    mask = rng.random(y.shape) < 0.9
    prob = Problem(p, [(spec, y, mask)], gaussian_loss(0.02))
    got, found = fit_program(prob, 2)
    se = standard_errors(prob, got)
    assert found.converged and abs(got["tau"] - 0.35) < 4 * se["tau"] and abs(got["gain"] - 1.6) < 4 * se["gain"]
    q = p.params[0]
    assert from_raw(q, to_raw(q, 0.7)) == pytest.approx(0.7) and quantise(q, q.upper) == q.upper
    z = starts(prob, 5, 1)
    assert len(z) == 5 and np.allclose(z[0], [to_raw(x, x.value) for x in prob.free])
