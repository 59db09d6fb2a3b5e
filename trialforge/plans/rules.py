"""The rules that the queries rule_tick, rule_tick_delays and rule_tick_table run."""

TICK_RULE = """wrl 0.1
tier G1
state v : 1 = 0
state a : 1 = 0
param tau : s = 0.25 fixed
input exc = sum_in(v, exc)
input inh = sum_in(v, inh)
let drive = tanh(1.5 * exc - inh) + type_mask(PROMO) * 0.25
next v = select(threshold(v, 0.5), leaky_integrate(v, drive + stimulus - a, tau), clamp(drive, -1, 1))
next a = leaky_integrate(a, v * 0.5, 2.0[s])
observe identity_v1(v)
"""

DELAY_RULE = """wrl 0.1
tier G1
dt_max 0.1
state v : 1 = 0
state w : 1 = 0
param gain : 1 = 0.75 in [0, 2] trainable bits 8
let past = delay(v, 2)
let soft = sigmoid(neg(w) + gain * past)
let bent = min(abs(past - 0.5), relu(w - 1), 2)
next v = max(euler_leak(v, soft, 0.5[s]), bent)
next w = euler_leak(w, neg(relu(v - soft)), 2[s])
observe calcium_linear_v1(v, 0.5[s])
"""

TABLE_RULE = """wrl 0.1
tier G0
state v : 1 = 0
next v = lut(count_in(v, 2) + stimulus, [0, 1, 2, 1])
observe identity_v1(v)
"""
