"""Casts between column types, and categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of column types, with Spark's. Unsigned integers take the next wider type.
TYPES = {
    "bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint8": "smallint", "uint16": "int",
    "uint32": "bigint", "uint64": "decimal(20,0)", "float32": "float", "float64": "double", "string": "string", "str": "string",
    "object": "string", "datetime64[ns]": "timestamp_ntz", "datetime": "timestamp_ntz", "date": "timestamp_ntz", "category": "string",
    "int": "bigint", "float": "double",
}
INTEGERS = ("tinyint", "smallint", "int", "bigint")


def spark_type(dtype: object) -> str:
    """Spark's name for a type given by name, Python type or NumPy type."""
    name = dtype if isinstance(dtype, str) else getattr(dtype, "__name__", None) or str(dtype)
    if name in TYPES:
        return TYPES[name]
    if name in TYPES.values() or name.startswith("decimal("):
        return name
    raise ValueError(f"no column type {dtype!r}")


def astype(c: Column, source: str, dtype: object) -> Column:
    """``c``, of Spark type ``source``, as ``dtype``. Numbers that don't fit wrap or are cut as in a machine cast."""
    target = spark_type(dtype)
    if target == source:
        return c
    if source == "string":
        if target == "boolean":
            return c == "True"
        if target == "timestamp_ntz":
            return F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))).cast(target)
        return c.cast(target)
    if target == "string":
        if source == "boolean":
            return F.when(c, "True").when(~c, "False")
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss") if source == "timestamp_ntz" else c.cast(target)
    if source == "timestamp_ntz":
        if target != "bigint":
            raise ValueError(f"no cast from datetime to {dtype!r}")
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c) * 1000
    if target == "timestamp_ntz":
        raise ValueError(f"no cast from {source} to datetime")
    if target == "boolean":
        return c != 0
    if source in INTEGERS and target in INTEGERS and INTEGERS.index(target) < INTEGERS.index(source):
        bits = 8 << INTEGERS.index(target)
        half = 1 << (bits - 1)
        wide = c.cast("bigint")
        return (F.pmod(wide + F.lit(half), F.lit(1 << bits)) - F.lit(half)).cast(target)
    return F.try_cast(c, target) if hasattr(F, "try_cast") else c.try_cast(target)


def categories(df: DataFrame, column: str) -> list[str]:
    """The distinct values of a column, sorted: the dictionary of an inferred category. One row each to the driver."""
    return [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).collect()]


def as_category(c: Column, known: Sequence[str]) -> Column:
    """``c`` with NULL for values out of the dictionary."""
    return F.when(c.isin(list(known)), c)


def codes(c: Column, known: Sequence[str]) -> Column:
    """The place of each value in the dictionary, from 0; NULL stays NULL."""
    at = F.array_position(F.array(*[F.lit(k) for k in known]), c)
    return F.when(at > 0, (at - 1).cast("int"))
