"""What an expression's text says, by the standard parser: one Arrow-batched function gives all of it in a struct.

Texts repeat a lot in facts, so a worker remembers the newest ones. A text that does not parse has null fields and
empty lists.
"""

from __future__ import annotations

import ast
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields of ``details``. ``kind``: comparison, membership, identity, truthiness, call_result, compound or unknown.
DETAILS = (
    "kind string, operator string, left string, right string, literal string, is_literal boolean, names array<string>, "
    "call_target string, components array<string>, operands array<string>, pairs array<struct<target:string,value:string>>, values array<string>"
)
_NAMES = [c.strip().split(" ")[0] for c in "kind,operator,left,right,literal,is_literal,names,call_target,components,operands,pairs,values".split(",")]
#: HTTP methods.
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD")


def kind_of_operator(operator: str) -> str:
    """The kind of condition that a comparison's operator makes."""
    return "membership" if operator in ("In", "NotIn") else "identity" if operator in ("Is", "IsNot") else "comparison"


def _classified(node: ast.expr) -> tuple[str, str | None, str | None, str | None]:
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        kind, _, left, right = _classified(node.operand)
        return kind, "Not", left, right
    if isinstance(node, ast.Compare) and len(node.ops) == 1:
        name = type(node.ops[0]).__name__
        return kind_of_operator(name), name, ast.unparse(node.left), ast.unparse(node.comparators[0])
    if isinstance(node, (ast.BoolOp, ast.Compare)):
        return "compound", type(node.op).__name__ if isinstance(node, ast.BoolOp) else None, None, None
    if isinstance(node, ast.Call):
        return "call_result", None, ast.unparse(node), None
    if isinstance(node, (ast.Name, ast.Attribute, ast.Subscript)):
        return "truthiness", None, ast.unparse(node), None
    return "unknown", None, None, None


def _components(node: ast.expr) -> list[ast.expr]:
    """Operands that a value is made of: of containers, operators, formatted strings and choices."""
    if isinstance(node, (ast.Tuple, ast.List, ast.Set)):
        parts = node.elts
    elif isinstance(node, ast.Dict):
        parts = node.values
    elif isinstance(node, ast.BinOp):
        parts = [node.left, node.right]
    elif isinstance(node, ast.BoolOp):
        parts = node.values
    elif isinstance(node, ast.IfExp):
        parts = [node.body, node.orelse]
    elif isinstance(node, ast.JoinedStr):
        parts = [v.value for v in node.values if isinstance(v, ast.FormattedValue)]
    else:
        return [] if isinstance(node, ast.Constant) else [node]
    return [x for p in parts for x in _components(p.value if isinstance(p, ast.Starred) else p)]


def _pairs(node: ast.expr) -> list[dict]:
    """A walrus aside, ``a, b = x, y`` is not an expression: texts ``(a, b) == (x, y)`` stand for it."""
    if isinstance(node, ast.Compare) and isinstance(node.left, ast.Tuple) and isinstance(node.comparators[0], ast.Tuple):
        left, right = node.left.elts, node.comparators[0].elts
        if len(left) == len(right):
            return [{"target": ast.unparse(a), "value": ast.unparse(b)} for a, b in zip(left, right, strict=True)]
    return []


@lru_cache(maxsize=8192)
def parsed(text: str) -> tuple:
    """The fields of ``DETAILS`` for one expression."""
    try:
        node = ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return (None, None, None, None, None, None, [], None, [], [], [], [])
    kind, operator, left, right = _classified(node)
    literal = node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None
    names = list(dict.fromkeys(n.id for n in sorted((n for n in ast.walk(node) if isinstance(n, ast.Name)), key=lambda n: (n.lineno, n.col_offset))))
    target = ast.unparse(node.func) if isinstance(node, ast.Call) else None
    components = list(dict.fromkeys(ast.unparse(c) for c in _components(node) if c is not node))
    operands: list[str] = []
    if isinstance(node, ast.Call):
        given = [*(a.value if isinstance(a, ast.Starred) else a for a in node.args), *(k.value for k in node.keywords)]
        receiver = [node.func.value] if isinstance(node.func, ast.Attribute) else []
        operands = list(dict.fromkeys(ast.unparse(x) for x in [*receiver, *given] if not isinstance(x, ast.Constant)))
    side = node.comparators[0] if isinstance(node, ast.Compare) else None
    listed = side.elts if isinstance(side, (ast.Tuple, ast.List, ast.Set)) else [side] if side is not None else []
    values = [e.value for e in listed if isinstance(e, ast.Constant) and isinstance(e.value, str)]
    return (kind, operator, left, right, literal, literal is not None, names, target, components, operands, _pairs(node), values)


def _fields(expression: pd.Series) -> pd.DataFrame:
    rows = [parsed(e) if e is not None else parsed("(") for e in expression]
    return pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(_NAMES)})


def details(expression: Column) -> Column:
    """The struct ``DETAILS`` of an expression's text."""
    return F.pandas_udf(_fields, DETAILS)(expression)  # type: ignore[call-overload]  made late, as its type needs a session


def unpacked(targets: Column, values: Column) -> Column:
    """``array<struct<target,value>>`` of an unpacking assignment's two comma lists; empty where their lengths differ."""
    return details(F.concat(F.lit("("), targets, F.lit(",) == ("), values, F.lit(",)")))["pairs"]


def method_directions(found: Column) -> Column:
    """Of a condition's ``details``: ``array<struct<method,arm>>``, the arm that a request of each method takes.

    Understands tests of ``request.method`` (or any ``….method``) against one literal or a list of them; else empty.
    """
    about = F.coalesce(found["left"].rlike(r"(^|\.)method$"), F.lit(False)) & (F.size(found["values"]) > 0)
    positive = found["operator"].isin("Eq", "In")
    usable = about & found["operator"].isin("Eq", "NotEq", "In", "NotIn")
    each = F.transform(F.array(*(F.lit(m) for m in METHODS)), lambda m: F.struct(m.alias("method"), (F.array_contains(found["values"], m) == positive).alias("arm")))
    return F.when(usable, each).otherwise(F.array().cast("array<struct<method:string,arm:boolean>>"))
