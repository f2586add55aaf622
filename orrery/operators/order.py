"""Row order: opt-in positions, stable sorts, head, tail, slices by position and by label.

A table has no order of its own. ``with_rowid`` numbers rows by order columns from 0, densely, in two steps that never put
all rows in one task: rows are dealt to ranges whose bounds come from a sample, numbered within a range, and the ranges'
sizes, one row each, give the offsets. Order columns should identify rows; ties are numbered in any order, in one range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .projection import quoted

ROWID = "__rowid"
#: Ranges, unless a range had fewer than LEAST rows or more than ROWS, and rows drawn for the bound of each.
RANGES, LEAST, ROWS, DRAWN = 256, 2000, 4_000_000, 40


def ordering(by: Sequence[str], ascending: bool | Sequence[bool] = True, na_position: str = "last") -> list[Column]:
    """NULL comes last, or first, whatever the direction."""
    if na_position not in ("first", "last"):
        raise ValueError(f"invalid na_position: {na_position}")
    up = [ascending] * len(by) if isinstance(ascending, bool) else list(ascending)
    if len(up) != len(by):
        raise ValueError("ascending must be as long as by")
    last = na_position == "last"
    return [(quoted(c).asc_nulls_last() if last else quoted(c).asc_nulls_first()) if u else (quoted(c).desc_nulls_last() if last else quoted(c).desc_nulls_first()) for c, u in zip(by, up, strict=True)]


def _before(names: Sequence[str], up: Sequence[bool], last: bool, bound: Column) -> Column:
    """Whether a row comes before ``bound``, a struct k0, k1, ... of a row's keys, in the order."""
    out = F.lit(False)
    for i, (c, u) in reversed(list(enumerate(zip(names, up, strict=True)))):
        col, v = quoted(c), bound[f"k{i}"]
        less = F.when(v.isNull(), col.isNotNull() if last else F.lit(False)).otherwise(F.coalesce(col < v if u else col > v, F.lit(not last)))
        out = less | (col.eqNullSafe(v) & out)
    return out


def ranges(df: DataFrame, by: Sequence[str], ascending: bool | Sequence[bool] = True, na_position: str = "last", total: int | None = None) -> Column:
    """The number of the range, from 0, that a row falls in; ranges follow one another in the order.

    Ranges grow in number with the table. Bounds come from a sample of rows, in proportion to the ranges, and are looked up by
    halving, so that the plan holds them once. Any bounds give right results; a sample's only give even ranges.
    ``total`` is the number of rows, if known.
    """
    up = [ascending] * len(by) if isinstance(ascending, bool) else list(ascending)
    keys = df.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(by)])
    total = keys.count() if total is None else total
    n = min(max(RANGES, -(-total // ROWS)), total // LEAST)
    if n < 2:
        return F.lit(0)
    drawn = keys.sample(min(1.0, n * DRAWN / total), seed=0)
    rows = drawn.orderBy(*ordering(keys.columns, up, na_position)).collect()
    kept = list(dict.fromkeys(rows[len(rows) * i // n] for i in range(1, n))) if rows else []
    if not kept:
        return F.lit(0)
    bounds = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, keys.schema, strict=True)]) for r in kept])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(kept).bit_length()))])

    def passed(at: Column, step: Column) -> Column:
        there = (at + step <= len(kept)) & ~_before(by, up, na_position == "last", F.get(bounds, at + step - 1))
        return F.when(there, at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), passed)


def with_rowid(df: DataFrame, by: Sequence[str], ascending: bool | Sequence[bool] = True, na_position: str = "last", name: str = ROWID) -> DataFrame:
    """``df`` with its rows' positions."""
    return numbered(df, by, ascending, na_position, name)[0]


def numbered(df: DataFrame, by: Sequence[str], ascending: bool | Sequence[bool] = True, na_position: str = "last", name: str = ROWID) -> tuple[DataFrame, int]:
    """``df`` with its rows' positions, and the number of rows."""
    total = df.count()
    placed = df.withColumn("__range", ranges(df, by, ascending, na_position, total))
    sizes = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*ordering(by, ascending, na_position))) - 1
    # A row for each range.
    out = placed.withColumn("__within", within).join(F.broadcast(offsets), "__range").withColumn(name, F.col("__first") + F.col("__within"))
    return out.drop("__range", "__within", "__first"), total


def sort_values(df: DataFrame, by: Sequence[str], ascending: bool | Sequence[bool] = True, na_position: str = "last", stable_by: Sequence[str] = ()) -> DataFrame:
    """Sorted by ``by``; ``stable_by`` is the order that ties keep."""
    return df.orderBy(*ordering(by, ascending, na_position), *ordering(stable_by))


def top(df: DataFrame, n: int, by: Sequence[str], ascending: bool | Sequence[bool] = True, na_position: str = "last") -> DataFrame:
    """The first ``n`` rows of the order, without sorting the others."""
    return df.orderBy(*ordering(by, ascending, na_position)).limit(n)


def head(df: DataFrame, by: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows, or all but the last -n."""
    return top(df, n, by) if n >= 0 else iloc(df, by, None, n)


def tail(df: DataFrame, by: Sequence[str], n: int = 5) -> DataFrame:
    """The last ``n`` rows, or all but the first -n."""
    if n < 0:
        return iloc(df, by, -n, None)
    return df.orderBy(*[c.desc_nulls_first() for c in map(quoted, by)]).limit(n)


def iloc(df: DataFrame, by: Sequence[str], start: int | None = None, stop: int | None = None) -> DataFrame:
    """Rows from position ``start`` up to, not including, ``stop``; negative ones count from the end."""
    rows = with_rowid(df, by)
    n = F.lit(df.count()) if (start or 0) < 0 or (stop or 0) < 0 else None
    at = lambda x: F.lit(x) if x >= 0 else n + x
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(ROWID) >= at(start))
    if stop is not None:
        cond = cond & (F.col(ROWID) < at(stop))
    return rows.filter(cond).drop(ROWID)


def loc_slice(df: DataFrame, index: str, by: Sequence[str], start: object = None, stop: object = None) -> DataFrame:
    """Rows from the first with the label ``start`` to the last with ``stop``, both included, by position in the order ``by``."""
    rows = with_rowid(df, by)
    found = rows.agg(F.min(F.when(quoted(index) == F.lit(start), F.col(ROWID))).alias("a"), F.max(F.when(quoted(index) == F.lit(stop), F.col(ROWID))).alias("b")).first()
    for label, at in ((start, found.a), (stop, found.b)):
        if label is not None and at is None:
            raise KeyError(label)
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col(ROWID) >= found.a)
    if stop is not None:
        cond = cond & (F.col(ROWID) <= found.b)
    return rows.filter(cond).drop(ROWID)


def loc_label(df: DataFrame, index: Sequence[str], label: object) -> DataFrame:
    """Rows with a label; a tuple may give the first levels only. Levels given are dropped."""
    values = label if isinstance(label, tuple) else (label,)
    cond = F.lit(True)
    for c, v in zip(index, values, strict=False):
        cond = cond & (quoted(c) == F.lit(v))
    return df.filter(cond).drop(*index[: len(values)])


def drop_label(df: DataFrame, index: str, label: object) -> DataFrame:
    """Rows whose label is another, or NULL."""
    return df.filter(F.coalesce(quoted(index) != F.lit(label), F.lit(True)))


def range_index(df: DataFrame, by: Sequence[str], start: int = 0, step: int = 1, name: str = "index") -> DataFrame:
    """``df`` with labels start, start + step, ... in the order ``by``."""
    return with_rowid(df, by).withColumn(name, F.lit(start) + F.lit(step) * F.col(ROWID)).drop(ROWID)


def category_codes(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """``df`` with the place of each value among the column's distinct values, sorted, from 0; NULL stays NULL.

    The dictionary is a joined table, so it may have any size.
    """
    words = df.select(quoted(column).alias("__word")).filter(F.col("__word").isNotNull()).distinct()
    numbered = with_rowid(words, ["__word"], name="__code")
    return df.join(numbered, quoted(column) == F.col("__word"), "left").withColumn(name, F.col("__code").cast("int")).drop("__word", "__code")
