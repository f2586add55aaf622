"""Row filters and missing values."""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import count_present
from ..plans.expression import translate
from .projection import quoted


def where_rows(df: DataFrame, cond: Column) -> DataFrame:
    """Rows where ``cond`` is True; NULL selects nothing."""
    return df.filter(cond)


def query(df: DataFrame, expr: str, env: Mapping[str, object] | None = None) -> DataFrame:
    """Rows for which a Python expression over the columns is true; ``@name`` is the caller's variable.

    A row with NULL in any column that the expression names is left out.
    """
    if env is None:
        frame = sys._getframe(1)
        env = {**frame.f_globals, **frame.f_locals}
    cond, used = translate(expr, dict(df.dtypes), env)
    present = [quoted(c).isNotNull() for c in sorted(used)]
    for p in present:
        cond = cond & p
    return df.filter(cond)


def dropna(df: DataFrame, how: str = "any", thresh: int | None = None, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows with at least ``thresh`` values present in ``subset``: by default all of them (any), or one (all)."""
    if how not in ("any", "all"):
        raise ValueError(f"invalid how option: {how}")
    names = list(df.columns if subset is None else subset)
    least = thresh if thresh is not None else (len(names) if how == "any" else 1)
    return df.filter(count_present([quoted(c) for c in names]) >= least)


def fillna(df: DataFrame, value: object) -> DataFrame:
    """NULL replaced by a scalar, in columns of its kind, or by column from a dictionary."""
    if isinstance(value, Mapping):
        return df.withColumns({c: F.coalesce(quoted(c), F.lit(v).cast(dict(df.dtypes)[c])) for c, v in value.items() if c in df.columns})
    kinds = ("string",) if isinstance(value, str) else ("boolean",) if isinstance(value, bool) else ("tinyint", "smallint", "int", "bigint", "float", "double")
    own = {c: F.coalesce(quoted(c), F.lit(value).cast(t)) for c, t in df.dtypes if t in kinds}
    return df.withColumns(own) if own else df


def isna(df: DataFrame) -> DataFrame:
    return df.select(*[quoted(c).isNull().alias(c) for c in df.columns])


def notna(df: DataFrame) -> DataFrame:
    return df.select(*[quoted(c).isNotNull().alias(c) for c in df.columns])


def has_missing(df: DataFrame, column: str) -> DataFrame:
    """One row: whether the column has a NULL."""
    return df.agg(F.coalesce(F.bool_or(quoted(column).isNull()), F.lit(False)).alias("hasnans"))


def assign_where(df: DataFrame, cond: Column, values: Mapping[str, Column | object]) -> DataFrame:
    """``values`` put where ``cond`` is True, everything else as it is."""
    hit = F.coalesce(cond, F.lit(False))
    return df.withColumns({c: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(quoted(c)) for c, v in values.items()})
