"""Filters as data: a tree that serialises to JSON and compiles to a column, so Catalyst pushes it to the scan.

A row whose field is missing matches no comparison, and neither does its negation by an operator of its own (not_equals, not_in, not_between); `not_` turns a whole subtree,
where a missing field counts as not matched. `now` is always given, so a filter means the same each time.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from dataclasses import field as _field
from datetime import date, datetime, timedelta
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _day(c: Column) -> Column:
    return F.to_date(c)


def _like(method: str) -> Callable:
    def build(c: Column, v: str, case_sensitive: bool = True) -> Column:
        c, v = (c, v) if case_sensitive else (F.lower(c), v.lower())
        return getattr(c, method)(v)

    return build


def _between(c: Column, low: Any, high: Any, inclusive: bool = True) -> Column:
    return (c >= low) & (c <= high) if inclusive else (c > low) & (c < high)


def _shift(now: datetime, n: int, unit: str) -> datetime:
    if unit in ("days", "weeks"):
        return now + timedelta(**{unit: n})
    months = now.year * 12 + now.month - 1 + n * (12 if unit == "years" else 1)
    year, month = divmod(months, 12)
    last = (date(year + (month == 11), (month + 1) % 12 + 1, 1) - timedelta(days=1)).day
    return now.replace(year=year, month=month + 1, day=min(now.day, last))


def _this(c: Column, now: datetime, unit: str) -> Column:
    """The week (from Monday), month or year of now, its last day whole."""
    start = F.date_trunc(unit, F.lit(now))
    end = start + F.expr({"week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH", "year": "INTERVAL 1 YEAR"}[unit])
    return (c >= start) & (c < end)


OPERATORS: dict[str, Callable[..., Column]] = {
    "equals": lambda c, v: c == v, "not_equals": lambda c, v: c != v, "in": lambda c, v: c.isin(list(v)), "not_in": lambda c, v: ~c.isin(list(v)),
    "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v,
    "between": _between, "not_between": lambda c, low, high: (c < low) | (c > high),
    "contains": _like("contains"), "starts_with": _like("startswith"), "ends_with": _like("endswith"),
    "exists": lambda c: c.isNotNull(), "not_exists": lambda c: c.isNull(),
    "is_integer": lambda c: c == F.floor(c), "is_decimal": lambda c: c != F.floor(c),
    "divisible_by": lambda c, v: F.lit(True) if v == 0 else c % v == 0,
    "is_positive": lambda c, include_zero=False: c >= 0 if include_zero else c > 0, "is_negative": lambda c, include_zero=False: c <= 0 if include_zero else c < 0,
    "near": lambda c, v, tolerance: _between(c, v - tolerance, v + tolerance),
    "before": lambda c, v, inclusive=False: c <= v if inclusive else c < v, "after": lambda c, v, inclusive=False: c >= v if inclusive else c > v,
    "on_date": lambda c, v: _day(c) == F.lit(v), "today": lambda c, now: _day(c) == F.lit(now.date()),
    "yesterday": lambda c, now: _day(c) == F.lit(now.date() - timedelta(days=1)), "tomorrow": lambda c, now: _day(c) == F.lit(now.date() + timedelta(days=1)),
    "in_last": lambda c, n, unit, now, inclusive=True: c >= F.lit(_shift(now, -n, unit)) if inclusive else c > F.lit(_shift(now, -n, unit)),
    "in_next": lambda c, n, unit, now, inclusive=True: c <= F.lit(_shift(now, n, unit)) if inclusive else c < F.lit(_shift(now, n, unit)),
    "this_week": lambda c, now: _this(c, now, "week"), "this_month": lambda c, now: _this(c, now, "month"), "this_year": lambda c, now: _this(c, now, "year"),
    "contains_all": lambda c, v: F.size(F.array_intersect(c, F.array(*map(F.lit, v)))) == len(set(v)), "contains_any": lambda c, v: F.arrays_overlap(c, F.array(*map(F.lit, v))),
}
#: Other names of operators.
ALIASES = {"eq": "equals", "==": "equals", "neq": "not_equals", "!=": "not_equals", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte", "like": "contains"}


@dataclass(frozen=True)
class Pred:
    """A comparison (op, field, args), or and, or, not over others. Pred() matches all."""

    op: str = "and"
    field: str = ""
    args: dict[str, Any] = _field(default_factory=dict)
    parts: tuple[Pred, ...] = ()

    def __and__(self, other: Pred) -> Pred:
        return Pred("and", parts=(self, other))

    def __or__(self, other: Pred) -> Pred:
        return Pred("or", parts=(self, other))

    def __invert__(self) -> Pred:
        return Pred("not", parts=(self,))

    def column(self, of: Callable[[str], Column] = F.col) -> Column:
        """The condition; of(name) gives a field's column, for fields inside maps or JSON."""
        if self.op == "not":
            return ~F.coalesce(self.parts[0].column(of), F.lit(False))
        if self.op in ("and", "or"):
            out = F.lit(self.op == "and" or not self.parts)
            for p in self.parts:
                c = p.column(of)
                out = out & c if self.op == "and" else out | c
            return out
        return OPERATORS[ALIASES.get(self.op, self.op)](of(self.field), **self.args)

    def to_dict(self) -> dict:
        if self.op in ("and", "or", "not"):
            return {self.op: [p.to_dict() for p in self.parts]}
        return {"op": self.op, "field": self.field, "args": {k: {"time": v.isoformat()} if isinstance(v, date) else v for k, v in self.args.items()}}

    @staticmethod
    def from_dict(d: dict) -> Pred:
        for op in ("and", "or", "not"):
            if op in d:
                return Pred(op, parts=tuple(map(Pred.from_dict, d[op])))

        def value(v):
            if isinstance(v, dict):
                return datetime.fromisoformat(v["time"]) if "T" in v["time"] else date.fromisoformat(v["time"])
            return v

        return Pred(d["op"], d["field"], {k: value(v) for k, v in d["args"].items()})

    def json(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True)


def where(name: str, op: str, v: Any = None, **args: Any) -> Pred:
    return Pred(op, name, ({} if v is None else {"v": v}) | args)


#: Names of comparisons in filters of the form {field, operator, value} (fixed values).
COMPARISONS = {"eq": "equals", "==": "equals", "=": "equals", "neq": "not_equals", "!=": "not_equals", "gt": "gt", ">": "gt", "gte": "gte", ">=": "gte", "lt": "lt", "<": "lt", "lte": "lte", "<=": "lte", "in": "in", "not in": "not_in"}
#: How a store's expressions write them (fixed values).
EXPRESSIONS = {"equals": "==", "not_equals": "!=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "in": "in", "not_in": "not in"}
#: How a store's operator trees name them (fixed values).
TREES = {"eq": "Equal", "==": "Equal", "=": "Equal", "neq": "NotEqual", "!=": "NotEqual", "gt": "GreaterThan", ">": "GreaterThan", "gte": "GreaterThanEqual", ">=": "GreaterThanEqual", "lt": "LessThan", "<": "LessThan", "lte": "LessThanEqual", "<=": "LessThanEqual", "like": "Like", "contains": "ContainsAll", "in": "ContainsAny"}


def _operands(d: dict, name: str) -> list | None:
    return d.get(name.upper(), d.get(name)) if name.upper() in d or name in d else None


def from_filter(d: dict) -> Pred:
    """A filter {field, operator, value}, or AND / OR over a list of them, as a Pred; an unknown operator compares for equality, an empty filter matches all.

    contains asks for all values of an array, like for a pattern's text.
    """
    if {"field", "operator", "value"} <= d.keys():
        op, value = str(d["operator"]).lower(), d["value"]
        if op in ("contains", "like"):
            return where(d["field"], "contains", value.strip("%*")) if op == "like" else where(d["field"], "contains_all", value if isinstance(value, list) else [value])
        return where(d["field"], COMPARISONS.get(op, "equals"), value)
    for name in ("and", "or"):
        if (parts := _operands(d, name)) is not None:
            return Pred(name, parts=tuple(map(from_filter, parts)))
    return Pred()


def expression_of(d: dict) -> str:
    """The same filter as a boolean expression: `a == "x"`, `b in [1, 2]`, joined by && and ||; empty for an empty or unreadable one."""
    if {"field", "operator", "value"} <= d.keys():
        text = lambda v: '"' + v.replace('"', '\\"') + '"' if isinstance(v, str) else str(v)
        op, value = EXPRESSIONS[COMPARISONS.get(str(d["operator"]).lower(), "equals")], d["value"]
        if isinstance(value, list):
            return f"{d['field']} {op} [{', '.join(map(text, value))}]" if op in ("in", "not in") else ""
        return f"{d['field']} {op} {text(value)}"
    for name, joined in (("and", " && "), ("or", " || ")):
        if parts := _operands(d, name):
            return joined.join(f"({x})" for x in map(expression_of, parts) if x)
    return ""


def tree_of(d: dict) -> dict:
    """The same filter as an operator tree {path, operator, value...} with And / Or operands. Booleans are told from numbers."""
    if {"field", "operator", "value"} <= d.keys():
        value = d["value"]
        kinds = ((bool, "valueBoolean"), (str, "valueString"), (int, "valueInt"), (float, "valueNumber"))
        kind = next((n for t, n in kinds if isinstance(value, t)), "valueStringArray" if isinstance(value, list) and all(isinstance(v, str) for v in value) else None)
        if kind:
            return {"path": [d["field"]], "operator": TREES.get(str(d["operator"]).lower(), d["operator"]), kind: value}
    for name, op in (("and", "And"), ("or", "Or")):
        if (parts := _operands(d, name)) is not None:
            return {"operator": op, "operands": [tree_of(x) for x in parts]}
    return d


def json_equals(metadata: Column, wanted: dict[str, Any]) -> Column:
    """Whether a JSON text holds each key with the value given, compared as JSON, so 1 is not "1"."""
    out = F.lit(True)
    for k, v in wanted.items():
        held = F.variant_get(F.try_parse_json(metadata), f"$['{k}']", "variant")
        out = out & F.coalesce(F.to_json(held) == F.lit(json.dumps(v, separators=(",", ":"), ensure_ascii=False)), F.lit(False))
    return out
