"""Model formulas as Spark columns: response ~ terms, with inline functions and factors."""

from __future__ import annotations

import ast
import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FUNCTIONS = {"log": F.log, "exp": F.exp, "sqrt": F.sqrt, "sin": F.sin, "cos": F.cos, "abs": F.abs, "I": lambda c: c}
_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: lambda a, b: F.pow(a, b)}


def _build(node: ast.AST, used: set[str]):
    if isinstance(node, ast.Name):
        used.add(node.id)
        return F.col(node.id)
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
        return F.lit(float(node.value))
    if isinstance(node, ast.BinOp) and type(node.op) in _OPERATORS:
        return _OPERATORS[type(node.op)](_build(node.left, used), _build(node.right, used))
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        return -_build(node.operand, used)
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS and len(node.args) == 1:
        return FUNCTIONS[node.func.id](_build(node.args[0], used))
    raise ValueError("unsupported expression in a formula")


def expression(text: str) -> tuple[Column, set[str]]:
    """Column of an arithmetic expression and the table columns it uses."""
    used: set[str] = set()
    return _build(ast.parse(text.strip().replace("^", "**"), mode="eval").body, used), used


def _terms(text: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "+" and not depth:
            out.append(text[start:i])
            start = i + 1
    return [t.strip() for t in (*out, text[start:]) if t.strip()]


@dataclass
class Design:
    """Columns of a one-sided formula: names, expressions, and the table columns used. The first is the intercept."""

    names: list[str]
    columns: list[Column]
    used: set[str]
    levels: dict[str, list[str]]


@dataclass
class Formula:
    response: str | None
    terms: list[str]

    @classmethod
    def parse(cls, text: str) -> Formula:
        left, tilde, right = text.partition("~")
        if not tilde:
            raise ValueError("a formula needs ~")
        terms = _terms(right)
        if "0" in terms or re.search(r"-\s*1\b", right):
            raise ValueError("a formula needs its intercept")
        return cls(left.strip() or None, [t for t in terms if t != "1"])

    def response_column(self) -> tuple[Column, set[str]]:
        if self.response is None:
            raise ValueError("a formula needs a response")
        return expression(self.response)

    def used(self) -> set[str]:
        out: set[str] = set()
        for t in [*self.terms, *([self.response] if self.response else [])]:
            out |= expression(t)[1]
        return out

    def design(self, df: DataFrame, levels: dict[str, list[str]] | None = None) -> Design:
        """Intercept, then each term; a string column becomes indicators of all its sorted levels but the first."""
        kinds, levels = dict(df.dtypes), dict(levels or {})
        names, columns, used = ["(Intercept)"], [F.lit(1.0)], set()
        for t in self.terms:
            c, own = expression(t)
            used |= own
            if kinds.get(t) == "string":
                if t not in levels:
                    levels[t] = [r[0] for r in df.select(t).where(F.col(t).isNotNull()).distinct().orderBy(t).limit(1001).collect()]
                    if len(levels[t]) > 1000:
                        raise ValueError(f"factor {t} has more than 1000 levels")
                for v in levels[t][1:]:
                    names.append(f"{t}{v}")
                    columns.append((F.col(t) == v).cast("double"))
            else:
                names.append(t)
                columns.append(c.cast("double"))
        return Design(names, columns, used, levels)
