"""One tick of a compiled rule as column expressions, inside code generation, for neighbourhood sums already joined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import compile_rule


def tick_columns(source: str, dt: float, registers: dict[str, Column], sums: dict[tuple[str, str], Column] | None = None, counts: dict[tuple[str, int], Column] | None = None, delays: dict[tuple[str, int], Column] | None = None, stimulus: Column | None = None, node_type: Column | None = None, params: dict[str, float] | None = None) -> dict[str, Column]:
    """The next value of each register, by its name in source. sums, counts and delays: by (register, selector or number).

    A gap coupling is not applied here; see operators.graph.gap_step.
    """
    p = compile_rule(source)
    names = [r.name for r in p.registers]
    theta = [float((params or {}).get(q.name, q.value)) for q in p.params]
    made: dict = {}
    for n in p.nodes:
        a = [made[x] for x in n.args]
        name = names[n.index] if n.op in ("state", "sum_in", "count_in", "delay") else ""
        pick = {
            "const": lambda: F.lit(n.value), "param": lambda: F.lit(theta[n.index]), "state": lambda: registers[name], "stimulus": lambda: stimulus, "type_mask": lambda: F.when(node_type == n.kind, 1.0).otherwise(0.0),
            "sum_in": lambda: sums[name, n.select], "count_in": lambda: counts[name, n.k], "delay": lambda: delays[name, n.k],
            "add": lambda: reduce(lambda x, y: x + y, a), "mul": lambda: reduce(lambda x, y: x * y, a), "min": lambda: F.least(*a), "max": lambda: F.greatest(*a), "neg": lambda: -a[0], "abs": lambda: F.abs(a[0]),
            "clamp": lambda: F.least(F.greatest(a[0], a[1]), a[2]), "relu": lambda: F.when(a[0] > 0, a[0]).otherwise(0.0), "tanh": lambda: F.tanh(a[0]), "sigmoid": lambda: 1 / (1 + F.exp(-a[0])),
            "threshold": lambda: F.when(a[0] >= a[1], 1.0).otherwise(0.0), "select": lambda: F.when(a[0] != 0, a[1]).otherwise(a[2]),
            "lut": lambda: F.element_at(F.array(*map(F.lit, n.table)), F.least(F.greatest(F.floor(a[0]), F.lit(0)), F.lit(len(n.table) - 1)).cast("int") + 1),
            "leaky_integrate": lambda: a[1] + (a[0] - a[1]) * F.exp(-(dt / a[2])), "euler_leak": lambda: a[0] + dt / a[2] * (a[1] - a[0]),
        }
        made[n] = pick[n.op]()
    return {name: made[w] for name, w in zip(names, p.writes)}


def observed(source: str, dt: float, new: dict[str, Column], carried: Column | None = None, params: dict[str, float] | None = None) -> Column:
    """What the rule reports after a tick: the new value of its register, or a first-order filter of it, from its carried
    value."""
    p = compile_rule(source)
    op, register, tau = p.observe
    value = new[p.registers[register].name]
    if op == "identity_v1":
        return value
    seconds = float((params or {}).get(p.params[tau].name, p.params[tau].value)) if isinstance(tau, int) else tau
    return value + (carried - value) * F.exp(F.lit(-dt / seconds))
