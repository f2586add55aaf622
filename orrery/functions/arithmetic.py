"""Arithmetic and bitwise operators. NULL in, NULL out; nothing raises on zero; signs go as in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _nonzero(b: Column) -> Column:
    """``b``, but NULL for zero: under ANSI mode a division must not see the zero."""
    return F.when(b != 0, b)


def _over_zero(a: Column) -> Column:
    a = a.cast("double")
    return F.when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))


def truediv(a: Column, b: Column) -> Column:
    """Double. Over zero: NaN, inf or -inf by the dividend's sign."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b == 0, _over_zero(a)).otherwise(a / _nonzero(b))


def mod(a: Column, b: Column, integral: bool) -> Column:
    """The remainder with the divisor's sign. Over zero: NULL for integers, NaN for floats."""
    d = _nonzero(b)
    rest = ((a % d) + d) % d
    return rest if integral else F.when(a.isNotNull() & (b == 0), F.lit(float("nan"))).otherwise(rest)


def floordiv(a: Column, b: Column, integral: bool) -> Column:
    """Rounded towards minus infinity. Over zero: NULL for integers, as ``truediv`` for floats."""
    if integral:
        d = _nonzero(b)
        return F.call_function("div", (a - mod(a, b, True)).cast("bigint"), d.cast("bigint"))
    quotient = truediv(a, b)
    # From 2 ** 53 on a double has no fraction; a zero keeps its sign.
    return F.when(F.isnan(quotient) | (F.abs(quotient) >= 2.0**53) | (quotient == 0), quotient).otherwise(F.floor(F.when(F.abs(quotient) < 2.0**53, quotient)).cast("double"))


def power(a: Column, b: Column, result: str = "double") -> Column:
    return F.pow(a, b).cast(result)


def bitwise(op: str, a: Column, b: Column, boolean: bool) -> Column:
    """and, or, xor on booleans or integers."""
    if boolean:
        return {"and": a & b, "or": a | b, "xor": a != b}[op]
    return {"and": a.bitwiseAND(b), "or": a.bitwiseOR(b), "xor": a.bitwiseXOR(b)}[op]


def invert(c: Column, boolean: bool) -> Column:
    return ~c if boolean else F.bitwise_not(c)


def binary(op: str, a: Column, b: Column, integral: bool = False, boolean: bool = False, result: str = "double") -> Column:
    """Any arithmetic or bitwise operator by its method name; a leading ``r`` swaps the operands."""
    from .missing import compare

    plain = {"add", "sub", "mul", "truediv", "floordiv", "mod", "pow", "and", "or", "xor"}
    if op in ("eq", "ne", "lt", "gt", "le", "ge"):
        return compare(op, a, b)
    if op not in plain:
        if op[:1] != "r" or op[1:] not in plain:
            raise ValueError(f"no operator {op!r}")
        op, a, b = op[1:], b, a
    if op in ("and", "or", "xor"):
        return bitwise(op, a, b, boolean)
    if op == "truediv":
        return truediv(a, b)
    if op == "floordiv":
        return floordiv(a, b, integral)
    if op == "mod":
        return mod(a, b, integral)
    if op == "pow":
        return power(a, b, result)
    return {"add": a + b, "sub": a - b, "mul": a * b}[op]
