"""Reductions of whole columns and of groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .projection import quoted

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
#: For each operation the column types that it takes.
TAKES = {
    "sum": NUMBERS, "prod": NUMBERS, "mean": NUMBERS, "var": NUMBERS, "std": NUMBERS, "any": (*NUMBERS, "boolean"), "all": (*NUMBERS, "boolean"),
    "min": (*NUMBERS, "boolean", "string", "timestamp_ntz"), "max": (*NUMBERS, "boolean", "string", "timestamp_ntz"),
    "count": None, "size": None,
}


def _truth(c: Column, kind: str) -> Column:
    return c if kind == "boolean" else c != 0


def aggregate(op: str, c: Column, kind: str, grouped: bool) -> Column:
    """One aggregate. NULL is passed over; a whole column without values gives 0, 1, False or True, a group gives NULL (sum, prod)."""
    if op not in TAKES:
        raise ValueError(f"no reduction {op!r}")
    if TAKES[op] is not None and kind not in TAKES[op]:
        raise TypeError(f"{op} does not take {kind} columns")
    if op == "sum":
        return F.sum(c) if grouped else F.coalesce(F.sum(c), F.lit(0))
    if op == "prod":
        return F.product(c.cast("double")) if grouped else F.coalesce(F.product(c.cast("double")), F.lit(1.0))
    if op == "any":
        return F.coalesce(F.bool_or(_truth(c, kind)), F.lit(False))
    if op == "all":
        return F.coalesce(F.bool_and(_truth(c, kind)), F.lit(True))
    if op == "size":
        return F.count(F.lit(1))
    return {"mean": F.avg, "var": F.var_samp, "std": F.stddev_samp, "min": F.min, "max": F.max, "count": F.count}[op](c)


def reduce_columns(df: DataFrame, op: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One row with ``op`` of each column that it takes, or of those named."""
    types = dict(df.dtypes)
    names = list(columns) if columns is not None else [c for c in df.columns if TAKES[op] is None or types[c] in TAKES[op]]
    return df.agg(*[aggregate(op, quoted(c), types[c], False).alias(c) for c in names])


def reduce_long(df: DataFrame, op: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The same with a row for each column: label, value."""
    wide = reduce_columns(df, op, columns)
    return wide.unpivot([], [quoted(c) for c in wide.columns], "label", "value") if len(wide.columns) > 0 else wide


def _specification(df: DataFrame, keys: Sequence[str], ops: object) -> list[tuple[str, str, str]]:
    """Column, operation and name of each result."""
    rest = [c for c in df.columns if c not in keys]
    types = dict(df.dtypes)
    if isinstance(ops, str):
        return [(c, ops, c) for c in rest if TAKES[ops] is None or types[c] in TAKES[ops]]
    if isinstance(ops, Mapping):
        out = []
        for c, o in ops.items():
            out += [(c, o, c)] if isinstance(o, str) else [(c, x, f"{c}_{x}") for x in o]
        return out
    return [(c, o, f"{c}_{o}") for c in rest for o in ops if TAKES[o] is None or types[c] in TAKES[o]]


def groupby(df: DataFrame, keys: Sequence[str], ops: object, sort: bool = False) -> DataFrame:
    """``ops`` is an operation, a list of them, or a dictionary from column to either. Groups with a NULL key are dropped."""
    types = dict(df.dtypes)
    if missing := [k for k in keys if k not in types]:
        raise KeyError(f"no columns {missing}")
    present = df.filter(_all_present(keys))
    results = [aggregate(o, quoted(c), types[c], True).alias(name) for c, o, name in _specification(df, keys, ops)]
    out = present.groupBy(*[quoted(k) for k in keys]).agg(*results)
    return out.orderBy(*[quoted(k) for k in keys]) if sort else out


def group_sizes(df: DataFrame, keys: Sequence[str], name: str = "size") -> DataFrame:
    return df.filter(_all_present(keys)).groupBy(*[quoted(k) for k in keys]).agg(F.count(F.lit(1)).alias(name))


def _all_present(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & quoted(k).isNotNull()
    return out
