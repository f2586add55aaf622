"""Unions of rows and columns, and equality of tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def concat_rows(frames: Sequence[DataFrame], by_name: bool = True) -> DataFrame:
    """All rows, repeated ones too, in no order. By name, a column that a table lacks is NULL there."""
    if not frames:
        raise ValueError("no objects to concatenate")
    if by_name:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return reduce(lambda a, b: a.union(b), frames)


append = concat_rows


def concat_columns(frames: Sequence[DataFrame], index: Sequence[str]) -> DataFrame:
    """Columns side by side, for tables with the same row labels ``index``, each once. NULL is a label like others.

    A label that a table lacks raises when the result is made.
    """
    out = frames[0]
    for i, right in enumerate(frames[1:]):
        here, there, mine = f"__here{i}", f"__there{i}", [f"__label{i}_{k}" for k in range(len(index))]
        b = right.withColumnsRenamed(dict(zip(index, mine, strict=True))).withColumn(there, F.lit(True))
        a = out.withColumn(here, F.lit(True))
        same = reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[m]) for k, m in zip(index, mine, strict=True)])
        met = a.join(b, same, "full")
        odd = F.col(here).isNull() | F.col(there).isNull()
        # The test is part of a label's value, so that it is not left out.
        first = F.when(odd, F.raise_error(F.lit("row labels differ")).cast(met.schema[index[0]].dataType)).otherwise(F.col(f"`{index[0]}`"))
        out = met.withColumn(index[0], first).drop(here, there, *mine)
    return out


def equals(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both have the same column types, in order, and the same rows as often. NULL equals NULL."""
    if [t for _, t in a.dtypes] != [t for _, t in b.dtypes]:
        return a.sparkSession.range(1).select(F.lit(False).alias("equal"))
    names = [f"c{i}" for i in range(len(a.columns))]
    both = a.toDF(*names).withColumn("__side", F.lit(1)).union(b.toDF(*names).withColumn("__side", F.lit(-1)))
    differ = both.groupBy(*names).agg(F.sum("__side").alias("__n")).filter("__n <> 0")
    return differ.agg((F.count(F.lit(1)) == 0).alias("equal"))


