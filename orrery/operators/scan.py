"""Cumulative operators over an order, in two steps that never put all rows in one task.

Rows are dealt to ranges of the order (see ``order``); values accumulate within a range, and the ranges' totals, one row
each, accumulate to what each range starts from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import ordering, ranges
from .projection import quoted

OPS = ("cumsum", "cumprod", "cummin", "cummax")


def _total(op: str, c: Column) -> Column:
    return {"cumsum": F.sum, "cumprod": F.product, "cummin": F.min, "cummax": F.max}[op](c)


def _join(op: str, before: Column, own: Column) -> Column:
    if op in ("cumsum", "cumprod"):
        both = before + own if op == "cumsum" else before * own
        return F.coalesce(both, before, own)
    return F.least(before, own) if op == "cummin" else F.greatest(before, own)


def cumulate(df: DataFrame, columns: Sequence[str], by: Sequence[str], op: str = "cumsum", skipna: bool = True) -> DataFrame:
    """``columns`` replaced by their running totals in the order ``by``, which should identify rows.

    With ``skipna`` a NULL stays NULL and the total carries on; without, every row from the first NULL on is NULL.
    """
    if op not in OPS:
        raise ValueError(f"no cumulative operator {op!r}")
    types = dict(df.dtypes)
    value = {c: quoted(c).cast("double") if op == "cumprod" else quoted(c) for c in columns}
    placed = df.withColumn("__range", ranges(df, by))
    within = Window.partitionBy("__range").orderBy(*ordering(by)).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("__range").agg(*[x for i, c in enumerate(columns) for x in (_total(op, value[c]).alias(f"__t{i}"), F.count_if(quoted(c).isNull()).alias(f"__m{i}"))])
    offsets = totals.select("__range", *[x for i in range(len(columns)) for x in (_total(op, F.col(f"__t{i}")).over(ahead).alias(f"__b{i}"), F.coalesce(F.sum(f"__m{i}").over(ahead), F.lit(0)).alias(f"__n{i}"))])
    own = placed.withColumns({k: v for i, c in enumerate(columns) for k, v in ((f"__o{i}", _total(op, value[c]).over(within)), (f"__u{i}", F.count_if(quoted(c).isNull()).over(within)))})
    met = own.join(F.broadcast(offsets), "__range")  # a row for each range
    out = {}
    for i, c in enumerate(columns):
        present = quoted(c).isNotNull() if skipna else F.col(f"__n{i}") + F.col(f"__u{i}") == 0
        total = _join(op, F.col(f"__b{i}"), F.col(f"__o{i}"))
        kind = "double" if op == "cumprod" else "bigint" if op == "cumsum" and types[c] in ("tinyint", "smallint", "int", "bigint") else types[c]
        out[c] = F.when(present, total).cast(kind)
    return met.withColumns(out).select(*[quoted(c) for c in df.columns])
