"""Alert rules: a tree of AND / OR / NOT over comparisons, compiled to one Column. Nothing is evaluated per row in Python."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other names of the comparators.
ALIASES = {
    "greaterThan": ">",
    "lessThan": "<",
    "greaterOrEqual": ">=",
    "lessOrEqual": "<=",
    "equals": "==",
    "=": "==",
    "notEquals": "!=",
    "crosses_above": "crossesAbove",
    "crosses_below": "crossesBelow",
    "crossAbove": "crossesAbove",
    "crossBelow": "crossesBelow",
    "inRange": "between",
    "betweenInclusive": "between",
    "outside": "outsideRange",
    "outside_range": "outsideRange",
    "percent_change_above": "percentChangeAbove",
    "percent_change_below": "percentChangeBelow",
    "changePercentAbove": "percentChangeAbove",
    "changePercentBelow": "percentChangeBelow",
}
PLAIN = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "==": operator.eq, "!=": operator.ne}


def _number(c: Column) -> Column:
    """NaN counts as missing."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def _constant(value) -> Column:
    try:
        return F.lit(float(value))
    except (TypeError, ValueError):
        return F.lit(None).cast("double")


def previous(name: str) -> str:
    """The column that holds a field's value at the bar before."""
    return f"previous_{name}"


def fields(expression: dict) -> set[str]:
    """All fields that an expression reads."""
    children = [c for c in expression.get("conditions") or expression.get("children") or [] if isinstance(c, dict)]
    if expression.get("child"):
        children.append(expression["child"])
    own = {expression["left"]} if expression.get("left") else set()
    right = expression.get("right")
    if isinstance(right, dict) and right.get("type") in ("field", "indicator", "priceField"):
        own.add(right.get("value") or right.get("field"))
    return own.union(*map(fields, children)) if children else own


def _operands(expression: dict, columns: set[str]) -> tuple:
    def read(name: str, before: bool) -> Column:
        name = previous(name) if before else name
        return _number(F.col(name)) if name in columns else F.lit(None).cast("double")

    right = expression.get("right")

    def other(before: bool) -> Column:
        if isinstance(right, dict):
            if right.get("type") in ("field", "indicator", "priceField"):
                return read(str(right.get("value") or right.get("field") or ""), before)
            return _constant(right.get("value"))
        return _constant(right)

    left = str(expression.get("left") or "")
    return read(left, False), read(left, True), other, right


def percent_change(before: Column, now: Column) -> Column:
    return F.when(before != 0, (now - before) / F.abs(before) * 100)


def crosses(before: Column, before_other: Column, now: Column, other: Column, above: bool) -> Column:
    return ((before <= before_other) & (now > other)) if above else ((before >= before_other) & (now < other))


def _leaf(expression: dict, columns: set[str]) -> Column:
    name = str(expression.get("comparator") or expression.get("operator") or "").strip()
    name = ALIASES.get(name, name)
    now, before, other, right = _operands(expression, columns)
    if name in ("between", "outsideRange"):
        right = right if isinstance(right, dict) else {}
        lo, hi = right.get("min"), right.get("max")
        if (lo is None or hi is None) and isinstance(right.get("value"), list) and len(right["value"]) > 1:
            lo, hi = right["value"][:2]
        if lo is None or hi is None:
            return F.lit(False)
        inside = now.between(F.lit(float(min(lo, hi))), F.lit(float(max(lo, hi))))
        test = inside if name == "between" else ~inside
    elif name in ("percentChangeAbove", "percentChangeBelow"):
        change = percent_change(before, now)
        test = change > other(False) if name.endswith("Above") else change < other(False)
    elif name in PLAIN:
        test = PLAIN[name](now, other(False))
    elif name in ("crossesAbove", "crossesBelow"):
        test = crosses(before, other(True), now, other(False), name == "crossesAbove")
    else:
        return F.lit(False)
    return F.coalesce(test, F.lit(False))


def _children(expression: dict) -> list[dict]:
    found = expression.get("conditions") or expression.get("children") or []
    return [c for c in found if isinstance(c, dict)]


def compile_alert(expression: dict, columns: set[str]) -> Column:
    """The rule as a boolean Column that is never null. AND of nothing is true, OR of nothing false, NOT of nothing true."""
    kind = str(expression.get("type") or expression.get("op") or "").upper()
    if kind in ("AND", "OR"):
        parts = [compile_alert(c, columns) for c in _children(expression)]
        return reduce(operator.and_ if kind == "AND" else operator.or_, parts, F.lit(kind == "AND"))
    if kind == "NOT":
        child = expression.get("child") or next(iter(_children(expression)), None)
        return ~compile_alert(child, columns) if child else F.lit(True)
    return _leaf(expression, columns)


def alert_trace(expression: dict, columns: set[str], path: str = "0") -> list[Column]:
    """One struct per node in depth-first order: its path, what it is, its outcome, and its operands' values."""
    kind = str(expression.get("type") or expression.get("op") or "").upper()
    children = _children(expression) or ([expression["child"]] if expression.get("child") else [])
    name = kind if kind in ("AND", "OR", "NOT") else str(expression.get("comparator") or expression.get("operator") or "")
    nothing = F.lit(None).cast("double")
    now, before, other, _ = _operands(expression, columns) if name not in ("AND", "OR", "NOT") else (nothing, nothing, lambda b: nothing, None)
    own = F.struct(F.lit(path).alias("path"), F.lit(name).alias("node"), compile_alert(expression, columns).alias("outcome"), now.alias("left"), other(False).alias("right"), before.alias("left_before"))
    return [own, *(x for i, c in enumerate(children) for x in alert_trace(c, columns, f"{path}.{i}"))]
