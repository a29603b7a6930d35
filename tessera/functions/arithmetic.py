"""Arithmetic expressions over `value`, compiled to Columns at plan time.

Only numbers, the name `value`, operators, comparisons, a conditional, and calls of
int, float, str, round and abs are let through. Semantics are Python's: // and %
floor, round goes to the even neighbour. Division by zero is null.
"""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _divide(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


_BINARY: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: _divide,
    ast.FloorDiv: lambda a, b: F.floor(_divide(a, b)).cast("double"),
    ast.Mod: lambda a, b: a - F.floor(_divide(a, b)) * b,
    ast.Pow: F.pow,
}
_COMPARE: dict[type, Callable[[Column, Column], Column]] = {
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
}


def compile_arithmetic(expression: str) -> Callable[[Column], Column]:
    """A function from the value's Column to the result's."""
    tree = ast.parse(expression, mode="eval").body
    return lambda value: build(tree, value)


def build(node: ast.AST, value: Column) -> Column:
    number = lambda n: build(n, value)
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
        return F.lit(float(node.value))
    if isinstance(node, ast.Constant) and isinstance(node.value, (str, bool)):
        return F.lit(node.value)
    if isinstance(node, ast.Name) and node.id == "value":
        return value.try_cast("double")
    if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
        return _BINARY[type(node.op)](number(node.left), number(node.right))
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        return -number(node.operand) if isinstance(node.op, ast.USub) else number(node.operand)
    if isinstance(node, ast.Compare) and all(type(op) in _COMPARE for op in node.ops):
        sides = [number(n) for n in (node.left, *node.comparators)]
        out = F.lit(True)
        for op, a, b in zip(node.ops, sides, sides[1:]):
            out = out & _COMPARE[type(op)](a, b)
        return out
    if isinstance(node, ast.IfExp):
        return F.when(number(node.test), number(node.body)).otherwise(number(node.orelse))
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
        args, name = [number(a) for a in node.args], node.func.id
        if name == "abs" and len(args) == 1:
            return F.abs(args[0])
        if name == "float" and len(args) == 1:
            return args[0].try_cast("double")
        if name == "int" and len(args) == 1:
            x = args[0].try_cast("double")
            return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")
        if name == "str" and len(args) == 1:
            return args[0].cast("string")
        if name == "round" and len(args) in (1, 2):
            places = int(node.args[1].value) if len(args) == 2 and isinstance(node.args[1], ast.Constant) else 0
            return F.bround(args[0], places)
    raise ValueError(f"not allowed in arithmetic: {ast.unparse(node)}")
