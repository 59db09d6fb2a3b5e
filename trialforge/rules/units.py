"""Units as integer powers of seconds and volts, and the decimal form of numbers."""

from __future__ import annotations

import re
from typing import NamedTuple

from .errors import RuleError

MOST_EXPONENT = 8


class Unit(NamedTuple):
    s: int = 0
    v: int = 0

    def times(self, other: "Unit", sign: int = 1) -> "Unit":
        out = Unit(self.s + sign * other.s, self.v + sign * other.v)
        if max(abs(out.s), abs(out.v)) > MOST_EXPONENT:
            raise RuleError("E_LIMIT", "unit exponent beyond 8")
        return out

    def __str__(self) -> str:
        parts = [n if e == 1 else f"{n}^{e}" for n, e in (("V", self.v), ("s", self.s)) if e]
        return "*".join(parts) or "1"


NONE, TIME = Unit(), Unit(1, 0)
BASES = {"s": Unit(1, 0), "V": Unit(0, 1), "1": NONE, "dimensionless": NONE}


def parse_unit(words: list[str], at: tuple[int, int] | None = None) -> Unit:
    """From tokens: terms joined by * or /, each a base with an optional ^exponent."""
    out, sign, i = NONE, 1, 0
    bad = RuleError("E_UNIT", f"not a unit: {' '.join(words) or 'nothing'}", at)
    while True:
        if i >= len(words) or words[i] not in BASES:
            raise bad
        base, power, i = BASES[words[i]], 1, i + 1
        if i < len(words) and words[i] == "^":
            minus = i + 1 < len(words) and words[i + 1] == "-"
            i += 1 + minus
            if i >= len(words) or not words[i].isdigit():
                raise bad
            power, i = int(words[i]) * (-1 if minus else 1), i + 1
            if abs(power) > MOST_EXPONENT:
                raise RuleError("E_LIMIT", "unit exponent beyond 8", at)
        out = out.times(Unit(base.s * power, base.v * power), sign)
        if i == len(words):
            return out
        if words[i] not in "*/":
            raise bad
        sign, i = (1 if words[i] == "*" else -1), i + 1


def decimal_parts(x: float) -> tuple[bool, str, int]:
    """(negative, significant digits, exponent of the first) of the shortest decimal that reads back as x."""
    text = repr(abs(float(x)))
    mantissa, _, e = text.partition("e")
    whole, _, part = mantissa.partition(".")
    digits = whole + part
    lead = len(digits) - len(digits.lstrip("0"))
    stripped = digits.strip("0")
    if not stripped:
        return False, "0", 0
    return x < 0, stripped, len(whole) - 1 - lead + int(e or 0)


def number_text(x: float) -> str:
    """d[.ddd]e<exp>; minus zero is zero."""
    negative, digits, e = decimal_parts(x)
    return f"{'-' * negative}{digits[0]}{'.' * (len(digits) > 1)}{digits[1:]}e{e}"


NUMBER = re.compile(r"(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
