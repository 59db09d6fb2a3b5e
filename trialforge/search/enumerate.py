"""All rules within a budget, each canonical program once, in a fixed order."""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, combinations, product
from math import prod

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rules import RuleError, compile_rule
from ..rules.compiler import OPERATORS, TIERS
from ..rules.program import N_ARY
from ..rules.units import number_text
from ..session import ship

#: Fixed value: the order in which operators are tried.
INNER = ("neg", "abs", "relu", "tanh", "sigmoid", "add", "mul", "min", "max", "threshold", "clamp", "select", "lut", "leaky_integrate", "euler_leak")
UNARY, TERNARY = ("neg", "abs", "relu", "tanh", "sigmoid"), ("clamp", "select")


#: Ranges of the budget's numbers, and what lists may hold.
RANGES = {"max_nodes": (1, 12), "max_depth": (1, None), "max_registers": (1, 3), "max_parameters": (0, None)}
LEAVES, SELECTORS, GAPS = ("const", "param", "stimulus", "sum_in", "count_in", "delay", "type_mask"), ("exc", "inh", "all", "mod"), ("none", "unit", "scaled")


def faults(c: dict) -> list[str]:
    """What is wrong with a budget, in words; nothing if it can be enumerated."""
    out = []

    def expect(good: bool, message: str) -> None:
        if not good:
            out.append(message)

    for key, (lo, hi) in RANGES.items():
        n = c.get(key, lo)
        expect(isinstance(n, int) and n >= lo and (hi is None or n <= hi), f"{key} must be at least {lo}" + (f" and at most {hi}" if hi else ""))
    tier, ops = c.get("tier"), list(c.get("ops", []))
    expect(tier in TIERS, f"unknown tier {tier}")
    strange = sorted(set(ops) - set(INNER) - set(LEAVES))
    expect(not strange, f"unknown operators {strange}")
    foreign = sorted(o for o in ops if tier in TIERS and o in OPERATORS and o not in TIERS[tier])
    expect(not foreign, f"operators {foreign} are not in tier {tier}")
    expect(not (tier == "G0" and "param" in ops), "G0 has no parameters")
    expect(set(c.get("sum_in_selects", [])) <= set(SELECTORS), "unknown selector of sum_in")
    for key in ("constants", "tau_constants"):
        expect(all(isinstance(x, (int, float)) for x in c.get(key, [])), f"{key} must be numbers")
    for key in ("count_values", "delays"):
        expect(all(isinstance(x, int) for x in c.get(key, [])), f"{key} must be whole numbers")
    if "lut" in c:
        expect(all(1 <= n <= 8 for n in c["lut"].get("sizes", [])), "sizes of tables must be from 1 to 8")
        expect(1 <= len(c["lut"].get("values", [])) <= 4, "tables must be made of 1 to 4 values")
    expect(all({"unit", "lower", "upper", "bits"} <= set(p) for p in c.get("parameters", [])), "a parameter needs unit, lower, upper and bits")
    gaps, scale = c.get("gap_variants", ["none"]), c.get("gap_scale")
    expect(0 < len(gaps) == len(set(gaps)) and set(gaps) <= set(GAPS), f"gap variants must be different ones of {GAPS}")
    expect(set(gaps) <= {"none"} or tier == "G1", "gap variants need tier G1")
    expect("scaled" not in gaps or scale is not None, "the variant scaled needs gap_scale")
    expect(scale is None or scale.get("unit") == "1" and 0 <= scale.get("lower", -1) < scale.get("upper", -1), "gap_scale must have unit 1 and 0 <= lower < upper")
    return out


def validate(c: dict) -> None:
    """Raise where a budget has faults."""
    if bad := faults(c):
        raise RuleError("E_INPUT", "; ".join(bad))


def _leaves(c: dict, registers: int) -> list[str]:
    ops = set(c["ops"])
    names = [f"r{i}" for i in range(registers)]
    out = list(names)
    out += ["stimulus"] * ("stimulus" in ops)
    out += [f"sum_in({r}, {s})" for r in names for s in c.get("sum_in_selects", [])] if "sum_in" in ops else []
    out += [f"count_in({r}, {k})" for r in names for k in c.get("count_values", [])] if "count_in" in ops else []
    out += [f"delay({r}, {k})" for r in names for k in c.get("delays", [])] if "delay" in ops else []
    out += [f"type_mask({t})" for t in c.get("type_names", [])] if "type_mask" in ops else []
    out += [number_text(x) for x in c.get("constants", [])] if "const" in ops else []
    out += [f"p{i}" for i, p in enumerate(c.get("parameters", [])) if p["unit"] != "s"] if "param" in ops else []
    return out


class Trees:
    """All expressions of exactly so many nodes and at most some depth, numbered in a fixed order: how many there are, and
    the text of the one with a given number, without making those before it."""

    def __init__(self, c: dict, registers: int):
        self.ops = [o for o in INNER if o in c["ops"]]
        self.taus = [f"p{i}" for i, p in enumerate(c.get("parameters", [])) if p["unit"] == "s"] + [f"{number_text(x)}[s]" for x in c.get("tau_constants", [])]
        lut = c.get("lut", {})
        self.tables = ["[" + ", ".join(map(number_text, t)) + "]" for n in lut.get("sizes", []) for t in product(lut.get("values", []), repeat=n)]
        self.leaves = _leaves(c, registers)
        self.blocks, self.count = cache(self._blocks), cache(self._count)

    def _blocks(self, nodes: int, depth: int) -> list[tuple[str, tuple[int, ...], tuple[str, ...], int]]:
        """(operator, nodes of its arguments, texts of its last argument, number) in order."""
        if depth <= 1:
            return []
        out = []
        for op in self.ops:
            last = self.tables if op == "lut" else self.taus if op in ("leaky_integrate", "euler_leak") else [""]
            if op in UNARY or op == "lut":
                splits = [(nodes - 1,)]
            elif op in TERNARY:
                splits = [(a, b, nodes - 1 - a - b) for a in range(1, nodes - 2) for b in range(1, nodes - 1 - a)]
            elif op in ("leaky_integrate", "euler_leak"):
                splits = [(a, nodes - 2 - a) for a in range(1, nodes - 2)]
            else:
                splits = [(a, nodes - 1 - a) for a in range(1, nodes - 1) if op not in N_ARY or a <= nodes - 1 - a]
            for sizes in splits:
                ns = [self.count(k, depth - 1) for k in sizes]
                n = ns[0] * (ns[0] + 1) // 2 if op in N_ARY and len(sizes) == 2 and sizes[0] == sizes[1] else prod(ns)
                out.append((op, sizes, tuple(last), n * len(last)))
        return out

    def _count(self, nodes: int, depth: int) -> int:
        return len(self.leaves) if nodes == 1 else sum(b[3] for b in self.blocks(nodes, depth))

    def text(self, nodes: int, depth: int, i: int) -> str:
        if nodes == 1:
            return self.leaves[i]
        for op, sizes, last, n in self.blocks(nodes, depth):
            if i < n:
                break
            i -= n
        i, tail = divmod(i, len(last))
        ns = [self.count(k, depth - 1) for k in sizes]
        if op in N_ARY and len(sizes) == 2 and sizes[0] == sizes[1]:  # pairs of one pool, the second not before the first
            m = ns[0]
            x = int(m + 0.5 - ((m + 0.5) ** 2 - 2 * i) ** 0.5)
            while x * m - x * (x - 1) // 2 > i:
                x -= 1
            while (x + 1) * m - (x + 1) * x // 2 <= i:
                x += 1
            picked = [x, x + i - (x * m - x * (x - 1) // 2)]
        else:
            picked = _digits(i, ns)
        parts = [self.text(k, depth - 1, j) for k, j in zip(sizes, picked)]
        return f"{op}({', '.join(parts + [last[tail]] * (last[tail] != ''))})"


def _digits(i: int, sizes: list[int]) -> list[int]:
    """Mixed-radix digits of i, the last running fastest."""
    out = []
    for n in reversed(sizes):
        i, d = divmod(i, n)
        out.append(d)
    return out[::-1]


def _splits(total: int, parts: int) -> Iterator[tuple[int, ...]]:
    for cuts in combinations(range(1, total), parts - 1):
        edges = (0, *cuts, total)
        yield tuple(b - a for a, b in zip(edges, edges[1:]))


class Space:
    """All candidates of a budget, numbered: by registers and their initial values, then nodes, then how these are split,
    then the trees, then junctions. The text of each follows from its number."""

    def __init__(self, c: dict):
        validate(c)
        self.depth, self.variants = c.get("max_depth", 12), list(c.get("gap_variants", ["none"]))
        self.head = ["wrl 0.1", f"tier {c['tier']}"] + ([f"dt_max {number_text(c['dt_max'])}"] if c.get("dt_max") else [])
        self.pars = [f"param p{i} : {p['unit']} in [{number_text(p['lower'])}, {number_text(p['upper'])}] trainable bits {p['bits']}" for i, p in enumerate(c.get("parameters", []))]
        gap = c.get("gap_scale", {})
        self.tails = {"none": [], "unit": ["gap r0"], "scaled": [f"param pg : 1 in [{number_text(gap.get('lower', 0))}, {number_text(gap.get('upper', 1))}] trainable bits {gap.get('bits', 8)}", "gap r0 scale pg"]}
        first = c.get("register_init", 0)
        first = first if isinstance(first, list) else [first]
        self.parts = []
        for registers in range(1, c.get("max_registers", 1) + 1):
            trees = Trees(c, registers)
            for inits in product(first, repeat=registers):
                for total in range(registers, c["max_nodes"] + 1):
                    for sizes in _splits(total, registers):
                        ns = [trees.count(n, self.depth) for n in sizes]
                        self.parts.append((trees, inits, sizes, ns, prod(ns) * len(self.variants)))
        self.ends = list(accumulate(p[4] for p in self.parts))

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def __getitem__(self, i: int) -> str:
        at = bisect_right(self.ends, i)
        trees, inits, sizes, ns, n = self.parts[at]
        *picked, v = _digits(i - (self.ends[at] - n), [*ns, len(self.variants)])
        states = [f"state r{k} : 1 = {number_text(x)}" for k, x in enumerate(inits)]
        exprs = [f"next r{k} = {trees.text(m, self.depth, j)}" for k, (m, j) in enumerate(zip(sizes, picked))]
        return "\n".join([*self.head, *states, *self.pars, *exprs, *self.tails[self.variants[v]], "observe identity_v1(r0)"]) + "\n"


def candidates(c: dict) -> Iterator[str]:
    """Source texts in order."""
    space = Space(c)
    return (space[i] for i in range(len(space)))


def judge(source: str, c: dict) -> tuple[str, str, str, int, int]:
    """(outcome, hash, canonical text, structure bits, parameter bits) of one candidate."""
    try:
        p = compile_rule(source)
    except RuleError as e:
        return ("stability" if e.code == "E_STABILITY" else "type_or_unit"), "", "", 0, 0
    if len(p.registers) > c.get("max_registers", 3) or len(p.params) > c.get("max_parameters", 99):
        return "budget", "", "", 0, 0
    return "ok", p.hash, p.text, p.bits["total"], p.bits["params"]


def enumerate_programs(spark: SparkSession, c: dict, part: int = 2000) -> DataFrame:
    """index, outcome (ok, duplicate, type_or_unit, stability, budget), hash, source, l_struct, l_params of every candidate.

    The driver counts the candidates; tasks make the texts from their numbers and compile them. Of equal programs the
    first is ok.
    """
    n = len(Space(c))
    ship(spark)

    def work(parts):
        space = Space(c)
        for p in parts:
            for at in range(0, len(p), part):
                index = p["id"].iloc[at : at + part]
                out = [judge(space[int(i)], c) for i in index]
                yield pd.DataFrame({"index": index, **{k: [o[i] for o in out] for i, k in enumerate(("outcome", "hash", "source", "l_struct", "l_params"))}})

    rows = spark.range(0, n, 1, max(1, -(-n // part)))
    done = rows.mapInPandas(work, "index long, outcome string, hash string, source string, l_struct long, l_params long")
    first = done.filter("outcome = 'ok'").groupBy("hash").agg(F.min("index").alias("first"))
    x = done.join(first, "hash", "left")
    return x.withColumn("outcome", F.when((F.col("outcome") == "ok") & (F.col("index") != F.col("first")), "duplicate").otherwise(F.col("outcome"))).drop("first")


def summary(found: DataFrame) -> dict[str, int]:
    n = Counter({r.outcome: r["count"] for r in found.groupBy("outcome").count().collect()})  # at most five rows
    return {"generated": sum(n.values()), "rejected": {k: n[k] for k in ("type_or_unit", "stability", "budget")}, "duplicates": n["duplicate"], "unique": n["ok"]}
