"""The rule language: errors, normal form, price."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trialforge.rules import RuleError, compile_rule
from trialforge.rules.program import constant, from_json, gamma
from trialforge.rules.units import number_text

HEAD = "wrl 0.1\ntier G1\n"


def rule(body, tier="G1"):
    return compile_rule(f"wrl 0.1\ntier {tier}\n{body}\n")


V = "state v : 1 = 0\n"
OBS = "\nobserve identity_v1(v)"

BAD = {
    "E_SYNTAX": [V + "next v = v / 2" + OBS, V + "next v = (v" + OBS, V + "bogus" + OBS, V + "next v = 2x" + OBS, V + "next v = v $ 1" + OBS],
    "E_NAME": [V + "next v = w" + OBS, V + "next v = v", V + V + "next v = v" + OBS, "state tanh : 1 = 0\nobserve identity_v1(tanh)", V + "next v = nope(v)" + OBS],
    "E_UNIT": ["state v : V = 0\nnext v = v + 1" + OBS, V + "next v = v + 1[s]" + OBS, "state v : V = 0\nnext v = tanh(v)" + OBS, V + "next v = decay(v, 1)" + OBS],
    "E_TYPE": [V + "next v = tanh(v, v)" + OBS, V + "next v = clamp(v, 2, 1)" + OBS, V + "param p : 1 = 5 in [0, 1] trainable bits 4" + OBS, V + "param p : 1 in [0, 1] trainable bits 40" + OBS, V + "next v = decay(v, v)" + OBS],
    "E_TIER": [V + "next v = lut(v, [0, 1])" + OBS, V + "next v = count_in(v, 1)" + OBS],
    "E_STABILITY": [V + "param t : s in [0, 1] trainable bits 4\nnext v = decay(v, t)" + OBS, V + "next v = euler_leak(v, 0, 1[s])" + OBS, "dt_max 2\n" + V + "next v = euler_leak(v, 0, 1[s])" + OBS],
    "E_LIMIT": [f"state {'x' * 65} : 1 = 0\nobserve identity_v1(v)", V + "next v = " + "(" * 40 + "v" + ")" * 40 + OBS, V + "next v = " + " + ".join(["v"] * 70) + OBS],
}


@pytest.mark.parametrize("code,body", [(c, b) for c, bodies in BAD.items() for b in bodies])
def test_errors(code, body):
    with pytest.raises(RuleError) as e:
        rule(body)
    assert e.value.code == code


def test_g0_errors():
    for body in (V + "next v = relu(v)" + OBS, V + "next v = v + 0.5" + OBS, V + "gap v" + OBS, V + "param p : 1 = 1 fixed" + OBS, "state v : s = 0" + OBS, V + "observe calcium_linear_v1(v, 1[s])"):
        with pytest.raises(RuleError) as e:
            rule(body, "G0")
        assert e.value.code == "E_TIER"


def same(a, b):
    return rule(V + f"next v = {a}" + OBS).hash == rule(V + f"next v = {b}" + OBS).hash


def test_identities():
    for a, b in (
        ("v + stimulus", "stimulus + v"), ("v + (stimulus + 1)", "add(1, stimulus, v)"), ("v + (-v) + stimulus", "stimulus"), ("v + 0", "v"), ("1 * v", "v"), ("0 * v", "0"), ("-1 * v", "-v"),
        ("-(-v)", "v"), ("abs(abs(v))", "abs(v)"), ("abs(-v)", "abs(v)"), ("relu(relu(v))", "relu(v)"), ("max(0, v)", "relu(v)"), ("min(v, v)", "v"), ("select(stimulus, v, v)", "v"),
        ("select(1, v, stimulus)", "v"), ("leaky_integrate(v, v, 1[s])", "v"), ("delay(v, 0)", "v"), ("2 + v + 3", "v + 5"), ("2 * v * 3", "6 * v"), ("v - stimulus", "v + neg(stimulus)"), ("threshold(2, 1) * v", "v"), ("clamp(5, 0, 1) * v", "v"),
    ):
        assert same(a, b), (a, b)
    for a, b in (("tanh(0) * v", "0 * v"), ("v + 1", "v"), ("min(v, 1)", "max(v, 1)"), ("delay(v, 1)", "v"), ("sum_in(v, exc)", "sum_in(v, inh)")):
        assert not same(a, b), (a, b)


def test_names_order_and_dead_code():
    a = rule("state v : 1 = 0\nstate h : 1 = 1\nparam g : 1 = 2 in [0, 4] trainable bits 5\nparam k : 1 = 1 fixed\nnext v = g * h + k\nnext h = v" + OBS)
    b = rule("param one : 1 = 1 fixed\nstate b : 1 = 1\nparam unused : s = 1 fixed\nstate v : 1 = 0\nstate dead : 1 = 9\nparam gain : 1 = 3 in [0, 4] trainable bits 5\nlet x = gain * b\nnext b = v\nnext v = one + x\nnext dead = v" + OBS)
    assert a.hash == b.hash and b.dropped == {"registers": ["dead"], "parameters": ["unused"]}
    assert a.bits["params"] == 5


def test_price_by_hand():
    assert [gamma(n) for n in (1, 2, 3, 4, 8)] == [1, 3, 3, 5, 7]
    assert constant(0.25) == 1 + gamma(2) + 8 + gamma(2) and constant(0.0) == 1 + 1 + 4 + 1
    p = rule(V + "next v = stimulus" + OBS)
    # 3 + 1 + unit(2); gamma(1) + unit + constant(0); gamma0(0); gamma0(1) + 8; gamma(1); 1; 1 + gamma0(0)
    assert p.bits["parts"] == {"header": 6, "registers": 1 + 2 + 7, "parameters": 1, "instructions": 3 + 8, "writes": 1, "gap": 1, "observation": 2}
    assert p.bits["total"] == sum(p.bits["parts"].values())


def test_numbers():
    assert [number_text(x) for x in (0.25, 1, 0, -0.0, 1e-7, 123456, -1.5e300)] == ["2.5e-1", "1e0", "0e0", "0e0", "1e-7", "1.23456e5", "-1.5e300"]


EXPR = st.recursive(
    st.sampled_from(["v", "h", "stimulus", "1.5", "0", "-2", "p", "sum_in(v, exc)", "sum_in(h, mod)", "delay(v, 2)", "type_mask(a)"]),
    lambda x: st.one_of(st.builds("({} + {})".format, x, x), st.builds("({} * {})".format, x, x), st.builds("({} - {})".format, x, x), st.builds("min({}, {}, 1)".format, x, x), st.builds("max({}, 0)".format, x), st.builds("abs({})".format, x), st.builds("tanh({})".format, x), st.builds("select({}, {}, {})".format, x, x, x), st.builds("leaky_integrate({}, {}, tau)".format, x, x)),
    max_leaves=10,
)


@settings(max_examples=150, deadline=None)
@given(EXPR, EXPR)
def test_normal_form_is_a_fixed_point(a, b):
    p = rule(f"state v : 1 = 0\nstate h : 1 = 1\nparam p : 1 in [0, 1] trainable bits 3\nparam tau : s = 1 fixed\nnext v = {a}\nnext h = {b}" + OBS)
    again = compile_rule(p.text)
    assert again.text == p.text and again.hash == p.hash and again.bits == p.bits


def test_json_round_trip():
    p = rule("dt_max 0.5\nstate v : V = 0\nparam g : V^-1 in [0, 2] trainable bits 6\nparam tau : s = 1 fixed\nnext v = euler_leak(v, tanh(g * delay(v, 3)) * 1[V], tau)\ngap v\nobserve calcium_linear_v1(v, 0.5[s])")
    data = json.loads(json.dumps(p.to_json()))
    q = from_json(data)
    assert q.text == p.text and q.bits == p.bits and q.observe == p.observe
    for bad in (data | {"program_hash": "0"}, data | {"instructions": [{"id": 1}]}, {}, data | {"writes": [{"register": 0, "value": 99}]}):
        with pytest.raises(RuleError) as e:
            from_json(bad)
        assert e.value.code == "E_JSON"


def test_noise_never_crashes():
    rnd = random.Random(3)
    text = HEAD + "state v : 1 = 0\nparam t : s in [0.1, 2] trainable bits 4\nlet d = v * 2 + stimulus\nnext v = leaky_integrate(v, tanh(d), t)\nobserve identity_v1(v)\n"
    for _ in range(400):
        s = list(text)
        for _ in range(rnd.randrange(1, 5)):
            s[rnd.randrange(len(s))] = rnd.choice("()[],:=+-*/ \nabv01s#")
        try:
            compile_rule("".join(s))
        except RuleError:
            pass
