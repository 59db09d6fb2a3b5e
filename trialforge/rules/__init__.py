"""A small typed language for local update rules: parse, check units, bring to a normal form, hash and price."""

from .compiler import compile_rule
from .errors import RuleError

__all__ = ["RuleError", "compile_rule"]
