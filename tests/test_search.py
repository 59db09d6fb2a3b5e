"""Enumeration against brute force, selection, locks, controls, planning."""

import itertools
import json
from itertools import product

import numpy as np
import pandas as pd
import pytest

from trialforge.operators import splits
from trialforge.rules import RuleError, compile_rule
from trialforge.search import controls, plan
from trialforge.search import enumerate as en
from trialforge.search import select

TINY = {"name": "t", "tier": "G1", "max_nodes": 4, "max_depth": 3, "max_registers": 1, "ops": ["neg", "add", "mul", "max", "threshold", "leaky_integrate", "const", "stimulus", "sum_in", "param"], "sum_in_selects": ["exc"], "constants": [0, 1], "tau_constants": [0.5], "parameters": [{"unit": "s", "lower": 0.1, "upper": 2, "bits": 6}], "gap_variants": ["none", "unit"]}


def brute(c):
    """Every tree as text, grown without any order or pruning, compiled: the set of hashes."""
    leaves = ["r0", "stimulus", "sum_in(r0, exc)", "0e0", "1e0"]
    by = {1: [(x, 1) for x in leaves]}
    for n in range(2, c["max_nodes"] + 1):
        out = [(f"neg({x})", d + 1) for x, d in by[n - 1]]
        for op in ("add", "mul", "max", "threshold"):
            for a in range(1, n - 1):
                out += [(f"{op}({x}, {y})", max(d, e) + 1) for (x, d), (y, e) in product(by[a], by[n - 1 - a])]
        for a in range(1, n - 2):
            out += [(f"leaky_integrate({x}, {y}, {t})", max(d, e) + 1) for (x, d), (y, e) in product(by[a], by[n - 2 - a]) for t in ("5e-1[s]", "p0")]
        by[n] = out
    found = set()
    for x, d in (t for n in by for t in by[n]):
        if d <= c["max_depth"]:
            for gap in ("", "gap r0\n"):
                try:
                    found.add(compile_rule(f"wrl 0.1\ntier G1\nstate r0 : 1 = 0\nparam p0 : s in [0.1, 2] trainable bits 6\nnext r0 = {x}\n{gap}observe identity_v1(r0)\n").hash)
                except RuleError:
                    pass
    return found


def test_enumeration_is_complete(spark):
    found = en.enumerate_programs(spark, TINY).collect()
    ok = [r for r in found if r.outcome == "ok"]
    assert {r.hash for r in ok} == brute(TINY) and len({r.hash for r in ok}) == len(ok)
    n = en.summary(en.enumerate_programs(spark, TINY))
    assert n["generated"] == len(found) == n["unique"] + n["duplicates"] + sum(n["rejected"].values()) and n["unique"] == len(ok)
    assert all(compile_rule(r.source).hash == r.hash for r in ok[:50])


def test_enumeration_limits():
    bad = [
        {"max_nodes": 13}, {"max_nodes": 0}, {"max_depth": 0}, {"max_registers": 4}, {"max_parameters": -1}, {"tier": "G9"}, {"ops": ["divide"]}, {"ops": ["lut"]}, {"tier": "G0", "ops": ["tanh"]}, {"tier": "G0", "ops": ["param"], "gap_variants": ["none"]},
        {"gap_variants": ["scaled"]}, {"gap_variants": []}, {"gap_variants": ["unit", "unit"]}, {"gap_variants": ["half"]}, {"gap_scale": {"unit": "s", "lower": 0, "upper": 1, "bits": 4}}, {"gap_scale": {"unit": "1", "lower": 2, "upper": 1, "bits": 4}},
        {"sum_in_selects": ["some"]}, {"lut": {"sizes": [9], "values": [0]}}, {"lut": {"sizes": [2], "values": []}}, {"parameters": [{"unit": "s"}]}, {"delays": [0.5]}, {"constants": ["x"]}, {"tier": "G0", "ops": ["add"], "gap_variants": ["unit"]},
    ]
    for change in bad:
        with pytest.raises(RuleError):
            en.validate(TINY | change)
    assert not en.faults(TINY) and not en.faults(G0) and not en.faults(G1) and len(en.faults({"max_nodes": 99, "tier": "x", "ops": ["q"]})) == 3


def test_gates_and_kernels():
    ok = compile_rule("wrl 0.1\ntier G1\nstate v : 1 = 0\nnext v = leaky_integrate(v, stimulus + sum_in(v, exc), 1[s])\nobserve identity_v1(v)\n")
    deaf = compile_rule("wrl 0.1\ntier G1\nstate v : 1 = 0\nnext v = sum_in(v, exc)\nobserve identity_v1(v)\n")
    alone = compile_rule("wrl 0.1\ntier G1\nstate v : 1 = 0\nnext v = stimulus\nobserve identity_v1(v)\n")
    wild = compile_rule("wrl 0.1\ntier G1\nstate v : 1 = 1\nnext v = 3 * v + stimulus + sum_in(v, exc)\nobserve identity_v1(v)\n")
    assert [select.structure_gate(p) for p in (ok, deaf, alone)] == [None, "ignores the stimulus", "doesn't couple"]
    spec = {"dt": 0.5, "n_steps": 20, "graph": {"neurons": [{"id": "A"}, {"id": "B"}], "chemical": [{"pre": "A", "post": "B", "weight": 1.0}]}}
    assert select.dynamics_gate(ok, spec) is None and select.dynamics_gate(wild, spec) == "too large"
    k = select.response_kernels(ok, spec, "A", 0.05, (0, 1, 2, 4), 0.5)
    assert np.allclose(k[:, 0], (1 - np.exp(-0.5)) * np.exp(-0.5 * np.array([0, 1, 2, 4])))


def test_rank_pareto_and_locks(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a", 1.0, 9), (0, "b", 1.0, 8), (0, "c", 0.5, 20), (1, "a", 2.0, 1), (0, "d", 3.0, 30), (0, "e", 1.0, 8)], "outer int, key string, inner_nll double, l_total int")
    assert [(r.outer, r.key) for r in select.rank(rows).orderBy("outer", "place").collect()] == [(0, "c"), (0, "b"), (0, "e"), (0, "a"), (0, "d"), (1, "a")]
    assert {r.key for r in select.pareto(rows.filter("outer = 0"), "inner_nll", "l_total", "outer").collect()} == {"b", "c", "e"}
    select.freeze_selection(tmp_path / "s.json", {"folds": {"0": "c"}, "key": "c"})
    with pytest.raises(FileExistsError):
        select.freeze_selection(tmp_path / "s.json", {"folds": {}})
    lock = select.Locked(tmp_path / "s.json", tmp_path / "locks", lambda s, f: 1.5)
    assert lock.score(0) == 1.5
    with pytest.raises(PermissionError):
        lock.score(0)
    with pytest.raises(ValueError):
        lock.score(7)
    data = json.loads((tmp_path / "s.json").read_text())
    (tmp_path / "s.json").write_text(json.dumps(data | {"key": "d"}))
    with pytest.raises(ValueError):
        select.Locked(tmp_path / "s.json", tmp_path / "locks", lambda s, f: 0)


def test_folds_and_views(spark):
    animals = spark.createDataFrame([(f"a{i}", f"s{i // 2}") for i in range(24)], "animal string, session string")
    folds = splits.nested(animals, "animal", 4, 3, 7)
    assert not any(splits.leaks(folds, "animal").values())
    import hashlib

    order = sorted((f"a{i}" for i in range(24)), key=lambda a: hashlib.sha256(f"7:outer:{a}".encode()).hexdigest())
    got = {r.animal: r.outer for r in folds.filter("role = 'test'").collect()}
    assert got == {a: i % 4 for i, a in enumerate(order)}
    bad = folds.union(folds.filter("role = 'test' and outer = 0").withColumn("role", folds["role"].substr(1, 0)).limit(0)).unionByName(spark.createDataFrame([(0, "train", 1, order[0])], "outer int, role string, inner int, animal string"))
    with pytest.raises(ValueError):
        splits.check(bad, "animal")
    with pytest.raises(ValueError):
        splits.check(folds, "animal", animals.select("session", "animal"))
    v = select.Views.of(animals, folds, 2)
    assert v.train.intersect(v.test).count() == 0 and v.train.count() + v.test.count() == 24


def test_controls(spark):
    rows = spark.createDataFrame([(f"r{i % 3}", i, f"L{i}") for i in range(60)], "rec string, i int, label string")
    a, b = (sorted(tuple(r) for r in controls.shuffle_labels(rows, "rec", "label", 5).collect()) for _ in range(2))
    assert a == b and {(x[0], x[2]) for x in a} == {(r.rec, r.label) for r in rows.collect()} and a != sorted(tuple(r) for r in rows.collect())
    some = spark.createDataFrame([("r", i, f"L{i}" if i % 2 else None) for i in range(20)], "rec string, i int, label string")
    assert {r.i for r in controls.shuffle_labels(some, "rec", "label", 1).collect() if r.label is None} == set(range(0, 20, 2))


def scores(gain, day=lambda i: f"d{i % 4}"):
    n = len(gain)
    return pd.DataFrame({
        "animal": [f"a{i:02d}" for i in range(n)], "day": [day(i) for i in range(n)], "rule": 10.0 - np.array(gain), "baseline": 10.0, "nothing": 12.0, "rule_trimmed": 5.0 - np.array(gain) / 2, "baseline_trimmed": 5.0,
        "null_rule": 1.0, "null_baseline": 1.0, "null_samples": 100,
    })


def test_verdict():
    fair = pd.DataFrame({"level": [0.5, 0.9], "rule": [0.51, 0.9], "baseline": [0.5, 0.91]})
    good = [1.0 + 0.1 * (i % 3) for i in range(12)]
    v = controls.verdict(scores(good), fair)
    assert v["holds"] and v["gain"]["estimate"] == pytest.approx(np.mean(good)) and v["gain"]["lo"] > 0.9
    assert v["gap_closed"]["estimate"] == pytest.approx((2 * 12 + sum(good)) / 24) and v["null_margin"]["estimate"] == 0
    assert v["least_without"]["animal"][0] == pytest.approx((sum(good) - 1.2) / 11)
    one_day = [5.0 if i % 4 == 0 else -0.5 for i in range(12)]
    v = controls.verdict(scores(one_day), fair)
    assert v["parts"]["robust"] is False and v["least_without"]["day"] == (pytest.approx(-0.5), "d0")
    assert not controls.verdict(scores([-1.0] * 12), fair)["parts"]["improves"]
    assert not controls.verdict(scores(good), fair.assign(rule=[0.6, 0.9]))["parts"]["harmless"]
    assert not controls.verdict(scores(good).assign(null_rule=3.0), fair)["parts"]["harmless"]
    assert np.isnan(controls.verdict(scores(good, lambda i: "d"), fair)["least_without"]["day"][0])
    full = {f"a{i}": 1.0 for i in range(9)}
    assert plan.necessity(full, {k: 1.5 + 0.01 * i for i, k in enumerate(full)}, 0.4)["necessary"]
    assert not plan.necessity(full, {k: 1.3 for k in full}, 0.4)["necessary"]


def test_planning():
    w = plan.posterior({"a": 10.0, "b": 10.0, "c": 12.0}, {"a": 5, "b": 6, "c": 5})
    assert w["a"] == pytest.approx(2 * w["b"]) and w["c"] == pytest.approx(w["a"] * np.exp(-2)) and sum(w.values()) == pytest.approx(1)
    assert plan.top_diverse(w, lambda x, y: 0.0 if {x, y} == {"a", "b"} else 1.0, 2, 0.5) == ["a", "c"]
    two = np.array([0.5, 0.5])
    assert plan.information_gain(two, np.array([[0.0], [100.0]]), 1.0, 500, 0)[0] == pytest.approx(np.log(2), abs=1e-6)
    assert plan.information_gain(two, np.array([[1.0], [1.0]]), 1.0, 500, 0) == (pytest.approx(0, abs=1e-9), pytest.approx(0, abs=1e-9))
    # two traces under AR(1) noise: as many units apart as the whitened difference has, with one or many equal particles
    a, b = np.zeros((1, 2, 6)), np.tile(np.arange(6.0), (1, 2, 1))
    g, err = plan.information_gain(two, [a, b], np.array([2.0, 3.0]), 4000, 1, phi=0.6)
    d = np.concatenate([b[..., :1], (b[..., 1:] - 0.6 * b[..., :-1]) / 0.8], axis=-1) / np.array([2.0, 3.0])[:, None]
    near, _ = plan.information_gain(two, np.array([[0.0], [float(np.sqrt((d**2).sum()))]]), 1.0, 4000, 2)
    assert abs(g - near) < 4 * err + 0.01 and 0 < err < 0.02
    many, _ = plan.information_gain(two, [np.repeat(a, 5, axis=0), np.repeat(b, 5, axis=0)], np.array([2.0, 3.0]), 4000, 3, phi=0.6)
    assert abs(g - many) < 0.04
    r = plan.rank_interventions(two, {"none": np.array([[1.0], [1.0]]), "tell": np.array([[0.0], [3.0]]), "dear": np.array([[0.0], [3.0]])}, 1.0, {"dear": 5.0})
    assert [k for k, _ in r] == ["tell", "dear", "none"]
    p = {"a": {"i": np.zeros(5)}, "b": {"i": np.full(5, 0.01)}, "c": {"i": np.ones(5)}}
    d = plan.distances(p, 1.0, 0.0)
    assert d["a", "c"] == pytest.approx(2.5) and plan.equivalence_classes(d, 0.1) == [["a", "b"], ["c"]]
    e = {frozenset(x) for x in ((1, 2), (2, 3), (1, 3), (3, 4))}
    assert plan.cliques([1, 2, 3, 4, 5], e) == [[1, 2, 3], [3, 4], [5]]


#: Two budgets whose numbers of candidates, programs and rejects are known.
G0 = {
    "tier": "G0", "max_nodes": 5, "max_depth": 4, "max_registers": 1, "max_parameters": 0, "ops": ["lut", "add", "mul", "count_in", "stimulus", "const"],
    "constants": [2], "count_values": [1], "lut": {"sizes": [3], "values": [0, 1]}, "register_init": [0],
}
G1 = {
    "tier": "G1", "max_nodes": 6, "max_depth": 4, "max_registers": 1, "max_parameters": 2, "ops": ["neg", "relu", "tanh", "add", "mul", "leaky_integrate", "euler_leak", "stimulus", "sum_in", "const", "param"],
    "constants": [1], "tau_constants": [0.1], "sum_in_selects": ["exc", "inh"], "dt_max": 0.05, "register_init": [0],
    "parameters": [{"unit": "1", "lower": 0, "upper": 2, "bits": 8}, {"unit": "s", "lower": 0.1, "upper": 5, "bits": 8}, {"unit": "s", "lower": 0.01, "upper": 5, "bits": 8}],
}


def test_known_counts(spark):
    n = en.summary(en.enumerate_programs(spark, G0))
    assert (n["generated"], n["unique"], n["duplicates"]) == (9368, 3921, 5447)
    n = en.summary(en.enumerate_programs(spark, G1))
    assert (n["generated"], n["unique"], n["rejected"]["stability"]) == (32682, 21858, 3240)


def test_numbered_trees():
    """The text of each number against all texts made in order."""
    c = TINY | {"max_nodes": 5, "max_depth": 3, "max_registers": 2, "ops": ["neg", "add", "min", "threshold", "clamp", "lut", "leaky_integrate", "const", "stimulus"], "constants": [1, 2], "tau_constants": [0.1, 1], "lut": {"sizes": [2], "values": [0, 1]}, "register_init": [0, 1]}
    t = en.Trees(c, 1)

    def every(nodes, depth):
        if nodes == 1:
            return list(t.leaves)
        out = []
        for op, sizes, last, _ in t.blocks(nodes, depth):
            pools = [every(k, depth - 1) for k in sizes]
            same = op in en.N_ARY and len(sizes) == 2 and sizes[0] == sizes[1]
            combos = itertools.combinations_with_replacement(pools[0], 2) if same else itertools.product(*pools)
            out += [f"{op}({', '.join([*x, *([y] if y else [])])})" for x in combos for y in last]
        return out

    for nodes in range(1, 6):
        want = every(nodes, 3)
        assert [t.text(nodes, 3, i) for i in range(t.count(nodes, 3))] == want
    space = en.Space(c | {"ops": [o for o in c["ops"] if o != "lut"]})
    texts = [space[i] for i in range(0, len(space), 97)]
    assert len(set(texts)) == len(texts) and all(x.startswith("wrl 0.1") for x in texts)
