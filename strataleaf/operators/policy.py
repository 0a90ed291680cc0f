"""Rules over columns, compiled to one expression."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_COMPARE = {
    "EQ": lambda c, v: c.eqNullSafe(F.lit(v)), "NE": lambda c, v: ~c.eqNullSafe(F.lit(v)), "GT": lambda c, v: c > v, "LT": lambda c, v: c < v,
    "GTE": lambda c, v: c >= v, "LTE": lambda c, v: c <= v, "IN": lambda c, v: c.isin(*v), "NOT_IN": lambda c, v: ~c.isin(*v),
    "CONTAINS": lambda c, v: c.contains(v), "STARTS_WITH": lambda c, v: c.startswith(v), "ENDS_WITH": lambda c, v: c.endswith(v),
}


@dataclass(frozen=True)
class Rule:
    field: str
    operator: str
    value: Any

    def column(self) -> Column:
        """True or false, never null; an unknown operator raises ValueError when compiled."""
        if self.operator not in _COMPARE:
            raise ValueError(f"unknown operator {self.operator}")
        return F.coalesce(_COMPARE[self.operator](F.col(self.field), self.value), F.lit(False))


def condition(rules: list[Rule], match: str = "ALL") -> Column:
    """ALL or ANY of the rules (another word counts as ALL); no rules are always met."""
    if not rules:
        return F.lit(True)
    any_ = match == "ANY"
    return reduce(lambda a, b: a | b if any_ else a & b, [r.column() for r in rules])
