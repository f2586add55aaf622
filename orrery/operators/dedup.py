"""Duplicate rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .projection import quoted


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None, keep: str | bool = "first", by: Sequence[str] = ()) -> DataFrame:
    """One row of those alike in ``subset`` (NULL equals NULL): the first or last in the order ``by``, or none with False.

    Without an order any one is kept. Rows are reduced before they are shuffled, so a value repeated very often is a few
    rows; only the whole row, as one struct, takes part.
    """
    if keep not in ("first", "last", False):
        raise ValueError('keep must be "first", "last" or False')
    names = list(df.columns if subset is None else subset)
    if missing := [c for c in names if c not in df.columns]:
        raise KeyError(f"no columns {missing}")
    if keep is False:
        row = F.struct(*[quoted(c) for c in df.columns])
        out = df.groupBy(*[quoted(c).alias(f"__k{i}") for i, c in enumerate(names)]).agg(F.count(F.lit(1)).alias("__n"), F.first(row).alias("__row")).filter("__n = 1")
        return out.select("__row.*")
    if not by:
        return df.dropDuplicates(names)
    if set(names) == set(df.columns):
        return df.distinct()
    order = F.struct(*[x for c in by for x in (quoted(c).isNull().alias(f"n_{c}"), quoted(c).alias(c))])
    row = F.struct(*[quoted(c) for c in df.columns])
    pick = F.min_by(row, order) if keep == "first" else F.max_by(row, order)
    return df.groupBy(*[quoted(c).alias(f"__k{i}") for i, c in enumerate(names)]).agg(pick.alias("__row")).select("__row.*")


