"""One kind of error, with a stable code and a place."""

from __future__ import annotations

#: The codes that callers match on.
CODES = ("E_SYNTAX", "E_NAME", "E_UNIT", "E_TYPE", "E_TIER", "E_STABILITY", "E_LIMIT", "E_GRAPH", "E_INPUT", "E_RUNTIME", "E_JSON", "E_IO")


class RuleError(Exception):
    def __init__(self, code: str, message: str, at: tuple[int, int] | None = None):
        assert code in CODES
        super().__init__(f"{code}{f' at {at[0]}:{at[1]}' if at else ''}: {message}")
        self.code, self.at = code, at
