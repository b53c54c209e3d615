"""Declarative lists of expressions: inputs are inferred, order follows from dependencies."""

from __future__ import annotations

import ast
import graphlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FUNCTIONS = {"sin": F.sin, "cos": F.cos, "tan": F.tan, "tanh": F.tanh, "exp": F.exp, "log": F.ln, "sqrt": F.sqrt, "abs": F.abs, "floor": F.floor, "min": F.least, "max": F.greatest}
COMPARE = {ast.Gt: "__gt__", ast.GtE: "__ge__", ast.Lt: "__lt__", ast.LtE: "__le__", ast.Eq: "__eq__", ast.NotEq: "__ne__"}
ARITHMETIC = {ast.Add: "__add__", ast.Sub: "__sub__", ast.Mult: "__mul__", ast.Div: "__truediv__", ast.Mod: "__mod__"}


def names_in(expression: str) -> set[str]:
    tree = ast.parse(expression, mode="eval")
    called = {n.func.id for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name)}
    return {n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} - called


def to_column(expression: str) -> Column:
    """A Column for arithmetic, comparisons, ``**``, ``where(cond, a, b)`` and FUNCTIONS."""

    def build(n) -> Column:
        if isinstance(n, ast.Constant):
            return F.lit(n.value)
        if isinstance(n, ast.Name):
            return F.col(n.id)
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.USub):
            return -build(n.operand)
        if isinstance(n, ast.BinOp):
            a, b = build(n.left), build(n.right)
            return F.pow(a, b) if isinstance(n.op, ast.Pow) else getattr(a, ARITHMETIC[type(n.op)])(b)
        if isinstance(n, ast.Compare) and len(n.ops) == 1:
            return getattr(build(n.left), COMPARE[type(n.ops[0])])(build(n.comparators[0]))
        if isinstance(n, ast.BoolOp):
            parts = [build(v) for v in n.values]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(n.op, ast.And) else out | p
            return out
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name):
            args = [build(a) for a in n.args]
            if n.func.id == "where":
                return F.when(args[0], args[1]).otherwise(args[2])
            return FUNCTIONS[n.func.id](*args)
        raise ValueError(f"not supported: {ast.dump(n)}")

    return build(ast.parse(expression, mode="eval").body)


def evaluate(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """``df`` with a column per expression, computed in dependency order whatever order they come in.

    Expressions of one layer share a projection. A cycle raises graphlib.CycleError.
    """
    wanted = {k: names_in(e) & set(expressions) for k, e in expressions.items()}
    missing = set().union(*map(names_in, expressions.values())) - set(expressions) - set(df.columns)
    if missing:
        raise ValueError(f"unknown names: {sorted(missing)}")
    order = graphlib.TopologicalSorter(wanted)
    order.prepare()
    while order.is_active():
        ready = sorted(order.get_ready())
        df = df.withColumns({k: to_column(expressions[k]) for k in ready})
        order.done(*ready)
    return df
