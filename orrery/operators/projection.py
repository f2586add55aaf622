"""Columns and labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _known(df: DataFrame, names: Sequence[str]) -> None:
    if missing := [c for c in names if c not in df.columns]:
        raise KeyError(f"no columns {missing}")


def select(df: DataFrame, names: Sequence[str]) -> DataFrame:
    _known(df, names)
    return df.select(*[quoted(c) for c in names])


def assign(df: DataFrame, values: Mapping[str, Column | object]) -> DataFrame:
    """Columns updated or, all of them, inserted."""
    present = [c in df.columns for c in values]
    if any(present) and not all(present):
        raise KeyError("columns to assign must all exist or all be new")
    return df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()})


def insert(df: DataFrame, loc: int, column: str, value: Column | object) -> DataFrame:
    if column in df.columns:
        raise ValueError(f"cannot insert {column}, already exists")
    if not 0 <= loc <= len(df.columns):
        raise IndexError(loc)
    own = [quoted(c) for c in df.columns]
    return df.select(*own[:loc], (value if isinstance(value, Column) else F.lit(value)).alias(column), *own[loc:])


def drop(df: DataFrame, names: Sequence[str]) -> DataFrame:
    _known(df, names)
    return df.select(*[quoted(c) for c in df.columns if c not in names])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Labels that don't occur are passed over."""
    return df.select(*[quoted(c).alias(names.get(c, c)) for c in df.columns])


def set_labels(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    if len(labels) != len(df.columns):
        raise ValueError(f"expected {len(df.columns)} labels, got {len(labels)}")
    return df.toDF(*labels)


def add_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*[prefix + c for c in df.columns])


def add_suffix(df: DataFrame, suffix: str) -> DataFrame:
    return df.toDF(*[c + suffix for c in df.columns])


def shuffle(df: DataFrame, keys: Sequence[str], n: int | None = None) -> DataFrame:
    """Rows dealt by a hash of ``keys``: joins and groupings on them that follow need no exchange."""
    _known(df, keys)
    return df.repartition(n, *[quoted(k) for k in keys]) if n else df.repartition(*[quoted(k) for k in keys])
