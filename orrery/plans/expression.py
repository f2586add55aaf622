"""Python expressions over columns, translated to one native Column."""

from __future__ import annotations

import ast
import io
import tokenize
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import arithmetic

_INTEGERS = ("tinyint", "smallint", "int", "bigint")
_BINARY = {ast.Add: "add", ast.Sub: "sub", ast.Mult: "mul", ast.Div: "truediv", ast.FloorDiv: "floordiv", ast.Mod: "mod", ast.Pow: "pow", ast.BitAnd: "and", ast.BitOr: "or", ast.BitXor: "xor"}
_COMPARE = {ast.Eq: "eq", ast.NotEq: "ne", ast.Lt: "lt", ast.LtE: "le", ast.Gt: "gt", ast.GtE: "ge"}
_EXTERNAL = "__external_"


def _parse(expr: str) -> ast.expr:
    """``@name`` is read as a name of its own kind."""
    tokens, after = [], False
    for t in tokenize.generate_tokens(io.StringIO(expr.strip()).readline):
        if t.type == tokenize.OP and t.string == "@":
            after = True
        elif after:
            if t.type != tokenize.NAME:
                raise SyntaxError("@ must be followed by a name")
            tokens.append((tokenize.NAME, _EXTERNAL + t.string))
            after = False
        else:
            tokens.append((t.type, t.string))
    return ast.parse(tokenize.untokenize(tokens).strip(), mode="eval").body


class _Translator(ast.NodeVisitor):
    """Each visit gives a Column and its kind: int, float, bool or other."""

    def __init__(self, types: Mapping[str, str], env: Mapping[str, object]) -> None:
        self.types, self.env, self.used = types, env, set()

    def visit_Name(self, node: ast.Name) -> tuple[Column, str]:
        if node.id.startswith(_EXTERNAL):
            name = node.id[len(_EXTERNAL) :]
            if name not in self.env:
                raise NameError(f"name {name!r} is not defined")
            return self._literal(self.env[name])
        if node.id not in self.types:
            raise NameError(f"name {node.id!r} is not a column")
        self.used.add(node.id)
        t = self.types[node.id]
        kind = "int" if t in _INTEGERS else "bool" if t == "boolean" else "float" if t in ("float", "double") else "other"
        return F.col(f"`{node.id}`"), kind

    def _literal(self, value: object) -> tuple[Column, str]:
        value = value.item() if hasattr(value, "item") else value
        if isinstance(value, bool):
            return F.lit(value), "bool"
        if isinstance(value, (int, float)):
            return F.lit(value), "int" if isinstance(value, int) else "float"
        if isinstance(value, str):
            return F.lit(value), "other"
        raise TypeError(f"{value!r} is not a scalar")

    def visit_Constant(self, node: ast.Constant) -> tuple[Column, str]:
        return self._literal(node.value)

    def visit_UnaryOp(self, node: ast.UnaryOp) -> tuple[Column, str]:
        c, kind = self.visit(node.operand)
        if isinstance(node.op, ast.Not):
            return ~c, "bool"
        if isinstance(node.op, ast.Invert):
            return arithmetic.invert(c, kind == "bool"), kind
        return (-c if isinstance(node.op, ast.USub) else c), kind

    def visit_BinOp(self, node: ast.BinOp) -> tuple[Column, str]:
        (a, x), (b, y) = self.visit(node.left), self.visit(node.right)
        op = _BINARY.get(type(node.op))
        if op is None:
            raise SyntaxError(f"operator {type(node.op).__name__} is not supported")
        integral = x == y == "int"
        kind = "float" if op == "truediv" or not integral else "int"
        if op in ("and", "or", "xor"):
            kind = x
        return arithmetic.binary(op, a, b, integral=integral, boolean=x == "bool", result="bigint" if integral else "double"), kind

    def visit_Compare(self, node: ast.Compare) -> tuple[Column, str]:
        parts = [self.visit(n)[0] for n in (node.left, *node.comparators)]
        out = None
        for op, a, b in zip(node.ops, parts[:-1], parts[1:], strict=True):
            if type(op) not in _COMPARE:
                raise SyntaxError(f"operator {type(op).__name__} is not supported")
            one = {"eq": a == b, "ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[_COMPARE[type(op)]]
            out = one if out is None else out & one
        return out, "bool"

    def visit_BoolOp(self, node: ast.BoolOp) -> tuple[Column, str]:
        out = None
        for n in node.values:
            c = self.visit(n)[0]
            out = c if out is None else (out & c if isinstance(node.op, ast.And) else out | c)
        return out, "bool"

    def generic_visit(self, node: ast.AST) -> tuple[Column, str]:
        raise SyntaxError(f"{type(node).__name__} is not supported in a query")


def translate(expr: str, types: Mapping[str, str], env: Mapping[str, object]) -> tuple[Column, set[str]]:
    """The condition, and the columns that it names."""
    visitor = _Translator(types, env)
    cond, kind = visitor.visit(_parse(expr))
    return (cond if kind == "bool" else cond != 0), visitor.used
