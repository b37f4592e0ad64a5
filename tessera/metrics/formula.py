"""Arithmetic formulas over references ``measure:name`` and ``metric:name``, with safe division."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import Refusal

_REFERENCE = re.compile(r"\b(measure|metric):([A-Za-z_]\w*)")


def references(formula: str) -> list[tuple[str, str]]:
    """(kind, name) of each reference in order, once."""
    return list(dict.fromkeys(_REFERENCE.findall(formula)))


def _parse(formula: str) -> tuple[ast.expr, dict[str, tuple[str, str]]]:
    names = {f"__ref{k}": r for k, r in enumerate(references(formula))}
    text = formula
    for name, (kind, ref) in names.items():
        text = re.sub(rf"\b{kind}:{ref}\b", name, text)
    try:
        return ast.parse(text.strip(), mode="eval").body, names
    except SyntaxError:
        raise Refusal("METRIC_FORMULA_INVALID", formula) from None


def check(formula: str) -> None:
    """Only + - * /, parentheses, numbers and references are allowed."""
    tree, names = _parse(formula)

    def walk(node: ast.expr) -> None:
        if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Sub, ast.Mult, ast.Div)):
            walk(node.left)
            walk(node.right)
        elif isinstance(node, ast.Name) and node.id in names or isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return
        else:
            raise Refusal("METRIC_FORMULA_INVALID", f"{ast.unparse(node)} in {formula}")

    walk(tree)


def build(formula: str, value: Callable[[str, str], Column]) -> Column:
    """The formula as a Column; value(kind, name) gives the references'. A division by zero is null."""
    check(formula)
    tree, names = _parse(formula)

    def make(node: ast.expr) -> Column:
        if isinstance(node, ast.Name):
            return value(*names[node.id])
        if isinstance(node, ast.Constant):
            return F.lit(node.value)
        left, right = make(node.left), make(node.right)
        if isinstance(node.op, ast.Div):
            return F.try_divide(left.cast("double"), right.cast("double"))
        return left + right if isinstance(node.op, ast.Add) else left - right if isinstance(node.op, ast.Sub) else left * right

    return make(tree)
