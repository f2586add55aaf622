"""Missing values: NULL is the only one. Sources turn NaN into NULL; comparisons never give NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOATS = ("double", "float")


def nan_to_null(df: DataFrame) -> DataFrame:
    """``df`` with NULL for NaN in its floating-point columns."""
    floats = {c: F.nanvl(F.col(f"`{c}`"), F.lit(None).cast(t)) for c, t in df.dtypes if t in FLOATS}
    return df.withColumns(floats) if floats else df


def compare(op: str, a: Column, b: Column) -> Column:
    """eq, ne, lt, gt, le or ge. A NULL operand gives False, and True for ne."""
    result = {"eq": a == b, "ne": a != b, "lt": a < b, "gt": a > b, "le": a <= b, "ge": a >= b}[op]
    return F.coalesce(result, F.lit(op == "ne"))


def where(c: Column, cond: Column, other: Column | None = None) -> Column:
    """``c`` where ``cond`` is True, else ``other`` (NULL by default). A NULL condition counts as False."""
    kept = F.when(F.coalesce(cond, F.lit(False)), c)
    return kept if other is None else kept.otherwise(other)


def mask(c: Column, cond: Column, other: Column | None = None) -> Column:
    """``c`` where ``cond`` is False or NULL, else ``other``."""
    return where(c, ~F.coalesce(cond, F.lit(False)), other)


def count_present(columns: list[Column]) -> Column:
    """How many of ``columns`` are not NULL."""
    return reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns], F.lit(0))
