"""A labelled frame interface over the operators.

A frame is a Spark DataFrame with row labels (columns ``__i0``, ``__i1``, ...) and an order (column ``__o``), both optional, and
a list of labelled column expressions over it. Column arithmetic only builds expressions; filters, joins and groupings
build plans; reductions, ``len`` and exports run them. Frames made from memory have labels and an order; those read from
files have neither until ``order_by`` or ``set_index`` gives them one, and operations that need one say so.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import DataFrame as Plan
from pyspark.sql import functions as F

from .functions import arithmetic, casts, datetimes, missing, strings
from .operators import aggregate, dedup, filters, order, scan, sets
from .operators import join as joins
from .operators.projection import quoted
from .plans.expression import translate
from .sources import csv, memory, parquet

ORDER = "__o"
INTEGERS, NUMBERS = ("tinyint", "smallint", "int", "bigint"), aggregate.NUMBERS
ALIASES = {"subtract": "sub", "multiply": "mul", "div": "truediv", "divide": "truediv", "rdiv": "rtruediv"}


@dataclass(frozen=True)
class Rows:
    """A plan, the names of its row labels, and whether it has an order.

    ``dense`` names a plan whose order is the positions from 0, with its number of rows, and ``wide`` a plan that has the rows, labels and
    columns of others, under the same names. Both hold as long as that is the plan: another plan voids them.
    """

    plan: Plan
    index: tuple[Any, ...] = ()
    ordered: bool = False
    dense: tuple[Plan, int] | None = None
    wide: tuple[Plan, tuple[Plan, ...]] | None = None

    @property
    def labels(self) -> list[str]:
        return [f"__i{i}" for i in range(len(self.index))]

    def own(self) -> list[str]:
        return self.labels + [ORDER] * self.ordered

    @property
    def size(self) -> int | None:
        """The number of rows, if the order is known to be the positions from 0."""
        return self.dense[1] if self.dense and self.dense[0] is self.plan else None

    @property
    def within(self) -> tuple[Plan, ...]:
        """Plans that this one has in it, row by row."""
        return (self.plan, *(self.wide[1] if self.wide and self.wide[0] is self.plan else ()))

    def numbered(self, plan: Plan, name: str) -> tuple[Plan, int]:
        """``plan``, made of these rows, with their positions, and how many there are. Positions are not counted again."""
        return order.numbered(plan, [ORDER], name=name) if self.size is None else (plan.withColumn(name, F.col(ORDER)), self.size)

    def need_order(self) -> None:
        if not self.ordered:
            raise ValueError("these rows have no order; give one with order_by(columns)")


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


class Frame:
    """What data frames and series share."""

    def __init__(self, rows: Rows, columns: list[tuple[Any, Column]]) -> None:
        self._rows, self._columns = rows, columns

    # Plans

    def _plan(self, *extra: Column) -> Plan:
        """Labels, order and columns c0, c1, ..."""
        return self._rows.plan.select(*self._rows.own(), *[c.alias(f"c{i}") for i, (_, c) in enumerate(self._columns)], *extra)

    def _with(self, plan: Plan, rows: Rows | None = None, names: Sequence[Any] | None = None) -> Frame:
        """The same labels over a plan with columns c0, c1, ..."""
        rows = replace(rows or self._rows, plan=plan)
        names = [n for n, _ in self._columns] if names is None else names
        return type(self)(rows, [(n, F.col(f"c{i}")) for i, n in enumerate(names)])

    def to_spark(self) -> Plan:
        """Columns under their labels as strings, row labels first; no order."""
        plan = self._plan()
        names = [str(n) if n is not None else f"level_{i}" if len(self._rows.index) > 1 else "index" for i, n in enumerate(self._rows.index)]
        return plan.select(*[F.col(f"__i{i}").alias(n) for i, n in enumerate(names)], *[F.col(f"c{i}").alias(str(n)) for i, (n, _) in enumerate(self._columns)])

    @property
    def _kinds(self) -> list[str]:
        return [t for n, t in self._plan().dtypes if n not in self._rows.own()]

    def _map(self, f: Callable[[Column, str], Column]) -> Frame:
        return type(self)(self._rows, [(n, f(c, k)) for (n, c), k in zip(self._columns, self._kinds, strict=True)])

    # Shape and labels

    def __len__(self) -> int:
        return self._rows.plan.count() if self._rows.size is None else self._rows.size

    @property
    def index(self) -> pd.Index:
        """The row labels, on the driver."""
        return self.to_pandas().index

    @property
    def empty(self) -> bool:
        return not self._columns

    def copy(self, deep: bool = True) -> Frame:
        return type(self)(self._rows, list(self._columns))

    __copy__ = copy

    def __deepcopy__(self, memo: dict) -> Frame:
        return self.copy()

    def __bool__(self) -> bool:
        raise ValueError("the truth value of a frame is ambiguous")

    def bool(self) -> bool:
        values = self.to_pandas().to_numpy().ravel()
        if len(values) != 1 or not isinstance(values[0], (bool, np.bool_)):
            raise ValueError("only one boolean has a truth value")
        return bool(values[0])

    def order_by(self, columns: Sequence[Any], ascending: bool | Sequence[bool] = True) -> Frame:
        """The same rows with an order, and labels 0, 1, ... where they have none."""
        at = [f"c{self._place(c)}" for c in columns]
        plan, n = order.numbered(self._plan().drop(ORDER), at, ascending, name=ORDER)
        if not self._rows.index:
            plan = plan.withColumn("__i0", F.col(ORDER))
            return self._with(plan, Rows(plan, (None,), True, (plan, n)))
        return self._with(plan, replace(self._rows, ordered=True, dense=(plan, n)))

    def _place(self, label: Any) -> int:
        for i, (n, _) in enumerate(self._columns):
            if n == label:
                return i
        raise KeyError(label)

    def set_axis(self, labels: Sequence[Any], axis: int = 0) -> Frame:
        if axis in (1, "columns"):
            if len(labels) != len(self._columns):
                raise ValueError("length mismatch")
            return type(self)(self._rows, [(n, c) for n, (_, c) in zip(labels, self._columns, strict=True)])
        self._rows.need_order()
        values = list(labels)
        plan, n = self._rows.numbered(self._plan(), "__at")
        if n != len(values):
            raise ValueError("length mismatch")
        new = memory.from_pandas(session(), pd.DataFrame({"__at": range(len(values)), "__new": values}))
        plan = plan.drop(*self._rows.labels).join(new, "__at").withColumnRenamed("__new", "__i0").drop("__at")
        return self._with(plan, Rows(plan, (getattr(labels, "name", None),), True))

    def droplevel(self, level: Any, axis: int = 0) -> Frame:
        own = self._level(level)
        keep = [i for i in range(len(self._rows.index)) if i not in own]
        plan = self._plan()
        plan = plan.select(*[F.col(f"__i{i}").alias(f"__i{k}") for k, i in enumerate(keep)], *[c for c in plan.columns if c not in self._rows.labels])
        return self._with(plan, Rows(plan, tuple(self._rows.index[i] for i in keep), self._rows.ordered))

    def _level(self, level: Any) -> list[int]:
        out = []
        for x in level if isinstance(level, (list, tuple)) else [level]:
            out.append(self._rows.index.index(x) if x in self._rows.index else range(len(self._rows.index))[x])
        return out

    # Rows

    def _filter(self, cond: Column) -> Frame:
        return type(self)(replace(self._rows, plan=self._rows.plan.filter(cond)), self._columns)

    def head(self, n: int = 5) -> Frame:
        self._rows.need_order()
        return self._with(order.head(self._plan(), [ORDER], n))

    def tail(self, n: int = 5) -> Frame:
        self._rows.need_order()
        return self._with(order.tail(self._plan(), [ORDER], n))

    def dropna(self, axis: int = 0, how: str = "any", thresh: int | None = None, subset: Sequence[Any] | None = None) -> Frame:
        at = None if subset is None else [f"c{self._place(c)}" for c in subset]
        return self._with(filters.dropna(self._plan(), how, thresh, at if at is not None else [f"c{i}" for i in range(len(self._columns))]))

    def isna(self) -> Frame:
        return self._map(lambda c, k: c.isNull())

    def notna(self) -> Frame:
        return self._map(lambda c, k: c.isNotNull())

    isnull, notnull = isna, notna

    def fillna(self, value: Any) -> Frame:
        if isinstance(value, Mapping):
            return type(self)(self._rows, [(n, F.coalesce(c, F.lit(value[n]).cast(k)) if n in value else c) for (n, c), k in zip(self._columns, self._kinds, strict=True)])
        fits = lambda k: k == "string" if isinstance(value, str) else k == "boolean" if isinstance(value, bool) else k in NUMBERS
        return self._map(lambda c, k: F.coalesce(c, F.lit(value).cast(k)) if fits(k) else c)

    def sort_index(self, level: Any = None, ascending: bool | Sequence[bool] = True, na_position: str = "last", ignore_index: bool = False, kind: Any = None) -> Frame:
        at = self._rows.labels if level is None else [f"__i{i}" for i in self._level(level)]
        if not at:
            raise ValueError("these rows have no labels")
        return self._sorted(at, ascending, na_position, ignore_index)

    def _sorted(self, by: list[str], ascending: bool | Sequence[bool], na_position: str, ignore_index: bool) -> Frame:
        """Stable: ties keep the order there was."""
        up = [ascending] * len(by) if isinstance(ascending, bool) else list(ascending)
        plan = self._plan().withColumnRenamed(ORDER, "__was")
        ties = ["__was"] * self._rows.ordered
        plan, n = order.numbered(plan, [*by, *ties], [*up, *[True] * len(ties)], na_position, name=ORDER)
        plan = plan.drop("__was")
        if ignore_index or not self._rows.index:
            plan = plan.drop(*self._rows.labels).withColumn("__i0", F.col(ORDER))
            return self._with(plan, Rows(plan, (None,), True, (plan, n)))
        return self._with(plan, replace(self._rows, ordered=True, dense=(plan, n)))

    def _cumulate(self, op: str, skipna: bool) -> Frame:
        self._rows.need_order()
        names = [f"c{i}" for i in range(len(self._columns))]
        return self._with(scan.cumulate(self._plan(), names, [ORDER], op, skipna))

    def cumsum(self, skipna: bool = True) -> Frame:
        return self._cumulate("cumsum", skipna)

    def cumprod(self, skipna: bool = True) -> Frame:
        return self._cumulate("cumprod", skipna)

    def cummin(self, skipna: bool = True) -> Frame:
        return self._cumulate("cummin", skipna)

    def cummax(self, skipna: bool = True) -> Frame:
        return self._cumulate("cummax", skipna)

    # Columns

    def abs(self) -> Frame:
        return self._map(lambda c, k: F.abs(c))

    def __abs__(self) -> Frame:
        return self.abs()

    def __neg__(self) -> Frame:
        return self._map(lambda c, k: -c)

    def __invert__(self) -> Frame:
        return self._map(lambda c, k: arithmetic.invert(c, k == "boolean"))

    def astype(self, dtype: Any) -> Frame:
        if isinstance(dtype, Mapping):
            if unknown := [n for n in dtype if n not in [x for x, _ in self._columns]]:
                raise KeyError(f"no columns {unknown}")
            return type(self)(self._rows, [(n, casts.astype(c, k, dtype[n]) if n in dtype else c) for (n, c), k in zip(self._columns, self._kinds, strict=True)])
        return self._map(lambda c, k: casts.astype(c, k, dtype))

    def _met(self, other: Frame) -> tuple[Frame, Frame]:
        """Both over one plan, row by row: as they are if one's plan has the other's in it, else joined by position.

        The plan of a join keeps all columns of the left one, so that its results and the left frame need no other join.
        """
        a, b = self._rows, other._rows
        if b.plan in a.within:
            return self, type(other)(a, other._columns)
        if a.plan in b.within:
            return type(self)(replace(b, index=a.index, ordered=a.ordered), self._columns), other
        a.need_order()
        b.need_order()
        names = [f"m{len(a.plan.columns) + i}" for i in range(len(other._columns))]
        left, n = a.numbered(a.plan, "__met")
        right, m = b.numbered(b.plan.select(ORDER, *[c.alias(x) for x, (_, c) in zip(names, other._columns, strict=True)]), "__met")
        if n != m:
            raise ValueError("operands must have the same rows")
        plan = left.drop(ORDER).join(right.drop(ORDER), "__met").withColumnRenamed("__met", ORDER)
        rows = Rows(plan, a.index, True, (plan, n), (plan, a.within))
        return type(self)(rows, list(self._columns)), type(other)(rows, [(x, F.col(c)) for c, (x, _) in zip(names, other._columns, strict=True)])

    def _operate(self, op: str, other: Any, fill_value: Any = None) -> Frame:
        op = ALIASES.get(op, op)
        if isinstance(other, (pd.Series, pd.DataFrame, np.ndarray, list)):
            other = from_pandas(pd.Series(other)) if isinstance(other, list) or (isinstance(other, np.ndarray) and other.ndim == 1) else from_pandas(pd.DataFrame(other) if isinstance(other, np.ndarray) else other)
        if isinstance(other, Frame):
            a, b = self._met(other)
            pairs = a._pairs(b)
            rows, owner = a._rows, a if isinstance(a, DataFrame) else b
        else:
            pairs, rows, owner = [(n, c, F.lit(other)) for n, c in self._columns], self._rows, self
        kinds = dict(rows.plan.select(*[x.alias(f"{s}{i}") for i, (_, l, r) in enumerate(pairs) for s, x in (("l", l), ("r", r)) if x is not None]).dtypes)
        out = []
        for i, (n, l, r) in enumerate(pairs):
            kl, kr = kinds.get(f"l{i}"), kinds.get(f"r{i}")
            if fill_value is not None:
                l = F.lit(fill_value).cast(kr) if l is None else F.coalesce(l, F.lit(fill_value).cast(kl)) if r is not None else l
                r = F.lit(fill_value).cast(kl) if r is None else F.coalesce(r, F.lit(fill_value).cast(kr))
            l = F.lit(None).cast(kr) if l is None else l
            r = F.lit(None).cast(kl) if r is None else r
            kl, kr = kl or kr, kr or kl
            comparing = op in ("eq", "ne", "lt", "gt", "le", "ge")
            if "string" in (kl, kr) and not comparing:
                raise TypeError(f"{op} is not defined for strings")
            integral = kl in INTEGERS and kr in INTEGERS
            if integral and not comparing and op not in ("and", "or", "xor"):
                l, r = l.cast("bigint"), r.cast("bigint")
            out.append((n, arithmetic.binary(op, l, r, integral=integral, boolean=kl == "boolean", result="bigint" if integral else "double")))
        return type(owner)(rows, out)

    def _pairs(self, other: Frame) -> list[tuple[Any, Column | None, Column | None]]:
        if isinstance(self, Series) and isinstance(other, Series):
            name = self._columns[0][0] if self._columns[0][0] == other._columns[0][0] else None
            return [(name, self._columns[0][1], other._columns[0][1])]
        if isinstance(other, Series):
            return [(n, c, other._columns[0][1]) for n, c in self._columns]
        if isinstance(self, Series):
            return [(n, self._columns[0][1], c) for n, c in other._columns]
        a, b = dict(self._columns), dict(other._columns)
        names = list(a) if list(a) == list(b) else sorted({*a, *b}, key=lambda x: (str(type(x)), x))
        return [(n, a.get(n), b.get(n)) for n in names]

    def where(self, cond: Frame, other: Any = None) -> Frame:
        return self._choose(cond, other, missing.where)

    def mask(self, cond: Frame, other: Any = None) -> Frame:
        return self._choose(cond, other, missing.mask)

    def _choose(self, cond: Frame, other: Any, how: Callable) -> Frame:
        n, m = len(self._columns), len(cond._columns)
        a, b = self._met(cond)
        tests = [c for _, c in b._columns] if isinstance(cond, DataFrame) and m == n else [b._columns[0][1]] * n
        if isinstance(other, Frame):
            both = type(self)(a._rows, a._columns + [(("cond", i), t) for i, t in enumerate(tests)])
            x, y = both._met(other)
            rest = [c for _, c in y._columns] * (n if len(y._columns) == 1 and n > 1 else 1)
            return type(self)(x._rows, [(name, how(c, x._columns[n + i][1], rest[i])) for i, (name, c) in enumerate(x._columns[:n])])
        value = None if other is None else F.lit(other)
        return type(self)(a._rows, [(name, how(c, t, value)) for (name, c), t in zip(a._columns, tests, strict=True)])

    # Results

    def _reduce(self, op: str) -> dict[Any, Any]:
        names = [(i, n, k) for i, ((n, _), k) in enumerate(zip(self._columns, self._kinds, strict=True)) if aggregate.TAKES[op] is None or k in aggregate.TAKES[op]]
        if not names:
            return {}
        row = self._plan().agg(*[aggregate.aggregate(op, F.col(f"c{i}"), k, False).alias(f"r{i}") for i, _, k in names]).first()
        return {n: row[f"r{i}"] for i, n, _ in names}

    def equals(self, other: Frame) -> bool:
        if self._kinds != other._kinds or len(self._rows.index) != len(other._rows.index):
            return False
        a, b = self, other
        if a._rows.ordered and b._rows.ordered:
            numbered = [x._rows.numbered(x._plan(), "__at")[0].drop(ORDER) for x in (a, b)]
        else:
            numbered = [x._plan().drop(ORDER) for x in (a, b)]
        return bool(sets.equals(numbered[0], numbered[1].select(*numbered[0].columns)).first()[0])

    def to_pandas(self) -> Any:
        plan = self._plan()
        data = memory.to_pandas(plan.orderBy(ORDER) if self._rows.ordered else plan)
        out = data[[f"c{i}" for i in range(len(self._columns))]]
        out.columns = pd.Index([n for n, _ in self._columns])
        labels = [data[x] for x in self._rows.labels]
        if len(labels) == 1:
            out.index = pd.Index(labels[0], name=self._rows.index[0])
        elif labels:
            out.index = pd.MultiIndex.from_arrays(labels, names=list(self._rows.index))
        return out.iloc[:, 0] if isinstance(self, Series) else out

    def to_numpy(self) -> np.ndarray:
        return self.to_pandas().to_numpy()

    values = property(to_numpy)

    def __array__(self, dtype: Any = None, copy: Any = None) -> np.ndarray:
        return np.asarray(self.to_numpy(), dtype=dtype)

    def to_arrow(self) -> Any:
        return memory.to_arrow(self.to_spark())

    def __arrow_c_stream__(self, requested_schema: Any = None) -> Any:
        """Export to any library that imports Arrow's C stream; row labels come first."""
        return self.to_arrow().__arrow_c_stream__(requested_schema)

    def __repr__(self) -> str:
        part = self.head(10) if self._rows.ordered else self._with(self._plan().limit(10))
        return repr(part.to_pandas())

    def to_csv(self, path: str, sep: str = ",", na_rep: str = "", columns: Sequence[Any] | None = None, header: bool = True, index: bool = True, line_terminator: str = "\n", partition: bool = False) -> None:
        part = self if columns is None else self[list(columns)]
        plan = part.to_spark()
        plan = plan if index else plan.select(*plan.columns[len(self._rows.index) :])
        csv.to_csv(plan, path, sep=sep, na_rep=na_rep, header=header, line_terminator=line_terminator, partition=partition)

    def to_parquet(self, path: str, compression: str | None = "snappy", index: bool = True, partition_cols: Sequence[Any] | None = None) -> None:
        plan, n = self.to_spark(), len(self._rows.index)
        parquet.to_parquet(parquet.mark_labels(plan, self._rows.index) if index else plan.select(*plan.columns[n:]), path, compression, partition_cols=partition_cols)

    # Locators

    @property
    def loc(self) -> _Loc:
        return _Loc(self)

    @property
    def iloc(self) -> _ILoc:
        return _ILoc(self)

    at = loc
    iat = iloc


def _methods(cls: type) -> None:
    def method(op: str) -> Callable:
        def run(self: Frame, other: Any, fill_value: Any = None) -> Frame:
            return self._operate(op, other, fill_value)

        run.__name__ = op
        return run

    for op in ("add", "sub", "mul", "truediv", "floordiv", "mod", "pow"):
        for name in (op, f"r{op}"):
            setattr(cls, name, method(name))
            setattr(cls, f"__{name}__", lambda self, other, name=name: self._operate(name, other))
    for name, op in ALIASES.items():
        setattr(cls, name, method(op))
    for op in ("eq", "ne", "lt", "gt", "le", "ge"):
        setattr(cls, op, method(op))
        setattr(cls, f"__{op}__", lambda self, other, op=op: self._operate(op, other))
    for op in ("and", "or", "xor"):
        for name in (f"__{op}__", f"__r{op}__"):
            setattr(cls, name, lambda self, other, op=op: self._operate(op, other))
    cls.__hash__ = None


_methods(Frame)


class DataFrame(Frame):
    """Labelled columns."""

    @property
    def columns(self) -> pd.Index:
        return pd.Index([n for n, _ in self._columns])

    @columns.setter
    def columns(self, labels: Sequence[Any]) -> None:
        self._columns = self.set_axis(labels, axis=1)._columns

    keys = property(lambda self: lambda: self.columns)
    shape = property(lambda self: (len(self), len(self._columns)))
    size = property(lambda self: len(self) * len(self._columns))
    ndim = 2
    axes = property(lambda self: [self.index, self.columns])
    dtypes = property(lambda self: pd.Series(self._kinds, index=self.columns))

    def __iter__(self):
        return iter([n for n, _ in self._columns])

    def __contains__(self, label: Any) -> bool:
        return any(n == label for n, _ in self._columns)

    def items(self):
        return ((n, self[n]) for n, _ in self._columns)

    def get(self, label: Any, default: Any = None) -> Any:
        return self[label] if label in self else default

    def __getattr__(self, name: str) -> Any:
        if not name.startswith("_") and name in self:
            return self[name]
        raise AttributeError(name)

    def __setattr__(self, name: str, value: Any) -> None:
        if not name.startswith("_") and name != "columns" and "_columns" in self.__dict__ and name in self:
            self[name] = value
        else:
            object.__setattr__(self, name, value)

    def __getitem__(self, key: Any) -> Any:
        if isinstance(key, DataFrame):
            return self.where(key)
        if isinstance(key, Series) or (isinstance(key, list) and key and all(isinstance(x, (bool, np.bool_)) for x in key)):
            return self.loc[key]
        if isinstance(key, slice):
            return self.iloc[key]
        if isinstance(key, (list, pd.Index)):
            return DataFrame(self._rows, [self._columns[self._place(k)] for k in key])
        return Series(self._rows, [self._columns[self._place(key)]])

    def __setitem__(self, key: Any, value: Any) -> None:
        keys = list(key) if isinstance(key, (list, pd.Index)) else [key]
        present = [k in self for k in keys]
        if any(present) and not all(present):
            raise KeyError("columns to set must all exist or all be new")
        if isinstance(value, (list, np.ndarray, pd.Series, pd.DataFrame)):
            value = from_pandas(value if isinstance(value, (pd.Series, pd.DataFrame)) else pd.Series(value))
        if isinstance(value, Frame):
            a, b = self._met(value)
            self._rows, columns = a._rows, list(a._columns)
            new = [c for _, c in b._columns] * (len(keys) if len(b._columns) == 1 else 1)
        else:
            columns, new = list(self._columns), [F.lit(value)] * len(keys)
        at = {n: i for i, (n, _) in enumerate(columns)}
        for k, c in zip(keys, new, strict=True):
            if k in at:
                columns[at[k]] = (k, c)
            else:
                columns.append((k, c))
        self._columns = columns

    def __delitem__(self, key: Any) -> None:
        del self._columns[self._place(key)]

    def insert(self, loc: int, column: Any, value: Any) -> None:
        if column in self:
            raise ValueError(f"cannot insert {column}, already exists")
        self[column] = value
        self._columns.insert(loc, self._columns.pop())

    def drop(self, labels: Any = None, axis: int = 0, index: Any = None, columns: Any = None, level: Any = None) -> DataFrame:
        if labels is not None:
            index, columns = (None, labels) if axis in (1, "columns") else (labels, None)
        out = self
        if columns is not None:
            gone = [columns] if not isinstance(columns, (list, pd.Index)) else list(columns)
            for c in gone:
                self._place(c)
            out = DataFrame(self._rows, [x for x in self._columns if x[0] not in gone])
        if index is not None:
            at = self._rows.labels[0 if level is None else self._level(level)[0]]
            out = out._filter(F.coalesce(F.col(at) != F.lit(index), F.lit(True)))
        return out

    def rename(self, mapper: Any = None, columns: Any = None, axis: int = 1) -> DataFrame:
        if axis not in (1, "columns") and columns is None:
            raise NotImplementedError("only columns can be renamed")
        names = columns if columns is not None else mapper
        new = names if callable(names) else lambda n: names.get(n, n)
        return DataFrame(self._rows, [(new(n), c) for n, c in self._columns])

    def add_prefix(self, prefix: str) -> DataFrame:
        return self.rename(lambda n: f"{prefix}{n}")

    def add_suffix(self, suffix: str) -> DataFrame:
        return self.rename(lambda n: f"{n}{suffix}")

    def set_index(self, keys: Any, drop: bool = True, append: bool = False) -> DataFrame:
        keys = [keys] if not isinstance(keys, list) else keys
        base, new, gone = self, [], []
        for k in keys:
            if isinstance(k, Series):
                base, k = base._met(k)
                new.append(k._columns[0])
            else:
                new.append(base._columns[base._place(k)])
                gone.append(k)
        old = [(n, F.col(x)) for n, x in zip(base._rows.index, base._rows.labels, strict=True)] if append else []
        keep = [(n, c) for n, c in base._columns if not (drop and n in gone)]
        labels = old + new
        plan = base._rows.plan.select(*[c.alias(f"__i{i}") for i, (_, c) in enumerate(labels)], *[ORDER] * base._rows.ordered, *[c.alias(f"c{i}") for i, (_, c) in enumerate(keep)])
        size = base._rows.size
        return DataFrame(Rows(plan, tuple(n for n, _ in labels), base._rows.ordered, None if size is None else (plan, size)), [(n, F.col(f"c{i}")) for i, (n, _) in enumerate(keep)])

    def reset_index(self, level: Any = None, drop: bool = False) -> DataFrame:
        own = list(range(len(self._rows.index))) if level is None else self._level(level)
        keep = [i for i in range(len(self._rows.index)) if i not in own]
        default = lambda i: "level_%d" % i if len(self._rows.index) > 1 else "index"
        front = [] if drop else [(self._rows.index[i] if self._rows.index[i] is not None else default(i), F.col(f"__i{i}")) for i in own]
        columns = front + self._columns
        plan, size = self._rows.plan, self._rows.size
        if not keep and self._rows.ordered:
            plan, _ = self._rows.numbered(plan, "__new")
            labels, index = [F.col("__new").alias("__i0")], (None,)
        else:
            labels, index = [F.col(f"__i{i}").alias(f"__i{k}") for k, i in enumerate(keep)], tuple(self._rows.index[i] for i in keep)
        plan = plan.select(*labels, *[ORDER] * self._rows.ordered, *[c.alias(f"c{i}") for i, (_, c) in enumerate(columns)])
        return DataFrame(Rows(plan, index, self._rows.ordered, None if size is None else (plan, size)), [(n, F.col(f"c{i}")) for i, (n, _) in enumerate(columns)])

    def squeeze(self, axis: Any = None) -> Any:
        one = len(self._columns) == 1 and axis in (None, 1, "columns")
        out = self[self._columns[0][0]] if one else self
        if axis in (None, 0, "index") and len(out) == 1:
            return out.to_pandas().squeeze() if one else from_pandas(self.to_pandas().iloc[0])
        return out

    def query(self, expr: str) -> DataFrame:
        frame = sys._getframe(1)
        kinds = dict(zip([str(n) for n, _ in self._columns], self._kinds, strict=True))
        cond, used = translate(expr, kinds, {**frame.f_globals, **frame.f_locals})
        inner = self._plan().toDF(*self._rows.own(), *kinds)
        for u in used:
            cond = cond & quoted(u).isNotNull()
        out = inner.filter(cond).toDF(*self._rows.own(), *[f"c{i}" for i in range(len(self._columns))])
        return self._with(out)

    def drop_duplicates(self, subset: Any = None, keep: Any = "first", ignore_index: bool = False) -> DataFrame:
        names = [n for n, _ in self._columns] if subset is None else [subset] if not isinstance(subset, list) else subset
        at = [f"c{self._place(n)}" for n in names]
        plan = dedup.drop_duplicates(self._plan(), at, keep, [ORDER] if self._rows.ordered and keep else [])
        out = self._with(plan)
        return out.reset_index(drop=True) if ignore_index else out

    def sort_values(self, by: Any, ascending: Any = True, na_position: str = "last", ignore_index: bool = False, kind: Any = None) -> DataFrame:
        keys = [by] if not isinstance(by, list) else by
        return self._sorted([f"c{self._place(k)}" for k in keys], ascending, na_position, ignore_index)

    def groupby(self, by: Any = None, level: Any = None, as_index: bool = True, sort: bool = False, method: str = "hash") -> GroupBy:
        return GroupBy(self, by, level, as_index, sort)

    def merge(self, right: DataFrame, how: str = "inner", on: Any = None, left_on: Any = None, right_on: Any = None, left_index: bool = False, right_index: bool = False, suffixes: tuple[str, str] = ("_x", "_y"), sort: bool = False, method: str | None = None) -> DataFrame:
        if sort:
            raise NotImplementedError("the result of a join has no order")
        as_list = lambda x: [x] if not isinstance(x, list) else x
        # Labels travel under names that no column of either side begins with.
        mark = "__"
        while any(str(n).startswith(f"{mark}label") for f in (self, right) for n, _ in f._columns):
            mark += "_"
        tags = [[f"{mark}label_{side}{i}" for i in range(len(f._rows.index))] for side, f in (("l", self), ("r", right))]
        named = lambda f, own: f._plan().drop(ORDER).toDF(*own, *[n for n, _ in f._columns])
        l, r = named(self, tags[0]), named(right, tags[1])
        lk = tags[0] if left_index else as_list(left_on if on is None else on) if (left_on is not None or on is not None) else None
        rk = tags[1] if right_index else as_list(right_on if on is None else on) if (right_on is not None or on is not None) else None
        if lk is None or rk is None:
            lk = rk = [n for n, _ in self._columns if n in right]
            if not lk:
                raise ValueError("no common columns to merge on")
        labelled = left_index and right_index
        l = l if left_index else l.drop(*tags[0])
        r = r if right_index else r.drop(*tags[1])
        labels = [f"{mark}label_{i}" for i in range(len(lk))] if labelled else []
        if labelled:
            out = joins.merge(l.withColumnsRenamed(dict(zip(lk, labels, strict=True))), r.withColumnsRenamed(dict(zip(rk, labels, strict=True))), how, on=labels, suffixes=suffixes, method=method)
        elif lk == rk:
            out = joins.merge(l, r, how, on=lk, suffixes=suffixes, method=method)
        else:
            out = joins.merge(l, r, how, left_on=lk, right_on=rk, suffixes=suffixes, method=method).drop(*tags[0], *tags[1])
        data = [c for c in out.columns if c not in labels]
        plan = out.select(*[quoted(c).alias(f"__i{i}") for i, c in enumerate(labels)], *[quoted(c).alias(f"c{i}") for i, c in enumerate(data)])
        return DataFrame(Rows(plan, self._rows.index if labelled else ()), [(n, F.col(f"c{i}")) for i, n in enumerate(data)])

    def join(self, other: Any, on: Any = None, how: str = "left", lsuffix: str = "", rsuffix: str = "") -> DataFrame:
        right = other.to_frame() if isinstance(other, Series) else other
        if on is None:
            return self.merge(right, how, left_index=True, right_index=True, suffixes=(lsuffix, rsuffix))
        return self.merge(right, how, left_on=on, right_index=True, suffixes=(lsuffix, rsuffix))

    def append(self, other: Any) -> DataFrame:
        return concat([self, *(other if isinstance(other, list) else [other])])

    def _totals(self, op: str) -> pd.Series:
        return pd.Series(self._reduce(op))

    def _shuffle(self, keys: Sequence[Any]) -> DataFrame:
        at = [F.col(f"c{self._place(k)}") for k in keys]
        return self._with(self._plan().repartition(*at))


class Series(Frame):
    """One labelled column."""

    @property
    def name(self) -> Any:
        return self._columns[0][0]

    @property
    def _kind(self) -> str:
        return self._kinds[0]

    dtype = property(lambda self: self._kind)
    shape = property(lambda self: (len(self),))
    size = property(lambda self: len(self))
    ndim = 1
    axes = property(lambda self: [self.index])
    hasnans = property(lambda self: bool(filters.has_missing(self._plan(), "c0").first()[0]))

    def __getitem__(self, key: Any) -> Any:
        return self.iloc[key] if isinstance(key, slice) else self.loc[key]

    def __setitem__(self, key: Any, value: Any) -> None:
        (self.iloc if isinstance(key, slice) else self.loc)[key] = value

    def to_frame(self, name: Any = None) -> DataFrame:
        label = name if name is not None else self.name if self.name is not None else 0
        return DataFrame(self._rows, [(label, self._columns[0][1])])

    def rename(self, name: Any) -> Series:
        return Series(self._rows, [(name, self._columns[0][1])])

    def reset_index(self, level: Any = None, drop: bool = False, name: Any = None) -> Any:
        out = self.to_frame(name).reset_index(level, drop)
        return Series(out._rows, [(self.name, out._columns[-1][1])]) if drop else out

    def squeeze(self) -> Any:
        return self.to_pandas().iloc[0] if len(self) == 1 else self

    def __int__(self) -> int:
        return int(self.squeeze())

    def sort_values(self, ascending: bool = True, na_position: str = "last", ignore_index: bool = False, kind: Any = None) -> Series:
        return self._sorted(["c0"], ascending, na_position, ignore_index)

    def drop_duplicates(self, keep: Any = "first") -> Series:
        return self._with(dedup.drop_duplicates(self._plan(), ["c0"], keep, [ORDER] if self._rows.ordered and keep else []))

    def groupby(self, by: Any = None, level: Any = None, sort: bool = False, method: str = "hash") -> GroupBy:
        return GroupBy(self.to_frame(), by, level, True, sort)

    def append(self, other: Any) -> Series:
        return concat([self, *(other if isinstance(other, list) else [other])])

    def _totals(self, op: str) -> Any:
        if not (found := self._reduce(op)):
            raise TypeError(f"{op} does not take {self._kind} columns")
        return next(iter(found.values()))

    def _one(self, f: Callable[..., Column], *args: Any) -> Series:
        return Series(self._rows, [(self.name, f(self._columns[0][1], *args))])

    @property
    def str(self) -> _Strings:
        if self._kind != "string":
            raise AttributeError("only string columns have .str")
        return _Strings(self)

    @property
    def dt(self) -> _Dates:
        if self._kind not in ("timestamp_ntz", "timestamp"):
            raise AttributeError("only datetime columns have .dt")
        return _Dates(self)

    @property
    def cat(self) -> _Categories:
        return _Categories(self)


def _reductions() -> None:
    for op in ("sum", "prod", "min", "max", "mean", "var", "std", "count", "any", "all"):
        for cls in (DataFrame, Series):
            setattr(cls, op, lambda self, op=op: self._totals(op))
    for cls in (DataFrame, Series):
        cls.product = cls.prod


_reductions()


class _Strings:
    def __init__(self, of: Series) -> None:
        self._of = of

    def __getattr__(self, name: str) -> Callable:
        found = {"contains": strings.contains, "pad": strings.pad, "zfill": strings.zfill, "strip": strings.strip, "lower": strings.lower, "upper": strings.upper, "swapcase": strings.swapcase}.get(name)
        if found is None:
            raise AttributeError(name)
        return lambda *args, **more: Series(self._of._rows, [(self._of.name, found(self._of._columns[0][1], *args, **more))])

    def to_datetime(self, format: str) -> Series:
        return self._of._one(datetimes.to_datetime, format)


class _Dates:
    def __init__(self, of: Series) -> None:
        self._of = of

    def __getattr__(self, name: str) -> Series:
        if name not in datetimes.FIELDS:
            raise AttributeError(name)
        return self._of._one(datetimes.field, name)


class _Categories:
    def __init__(self, of: Series) -> None:
        self._of = of

    @property
    def categories(self) -> list[Any]:
        return casts.categories(self._of._plan(), "c0")

    @property
    def codes(self) -> Series:
        return self._of._one(casts.codes, self.categories)


class _Loc:
    """By label. Slices hold both ends; a tuple may give the first levels of the labels."""

    def __init__(self, of: Frame) -> None:
        self._of = of

    def _split(self, key: Any) -> tuple[Any, Any]:
        if isinstance(self._of, DataFrame) and isinstance(key, tuple) and len(key) == 2 and not (len(self._of._rows.index) > 1 and not isinstance(key[0], (tuple, slice, Series)) and key[1] not in self._of and not isinstance(key[1], (slice, list))):
            return key
        return key, slice(None)

    def _columns(self, key: Any) -> list[Any] | Any:
        names = [n for n, _ in self._of._columns]
        if isinstance(key, slice):
            if key == slice(None) or not isinstance(self._of, DataFrame):
                return names
            a = 0 if key.start is None else self._of._place(key.start)
            b = len(names) if key.stop is None else self._of._place(key.stop) + 1
            return names[a:b]
        return key

    def _cond(self, key: Any) -> tuple[Frame, Column, int]:
        """The frame to filter, the condition, and how many levels are fixed by it."""
        of = self._of
        if isinstance(key, list) and all(isinstance(x, (bool, np.bool_)) for x in key):
            key = from_pandas(pd.Series(key))
        if isinstance(key, Series):
            a, b = of._met(key)
            return a, F.coalesce(b._columns[0][1], F.lit(False)), 0
        if not of._rows.index:
            raise ValueError("these rows have no labels")
        if isinstance(key, slice):
            if key == slice(None):
                return of, F.lit(True), 0
            if len(of._rows.index) > 1 or key.step is not None:
                raise NotImplementedError("slices need one level of labels and no step")
            of._rows.need_order()
            found = of._plan().agg(F.min(F.when(F.col("__i0") == F.lit(key.start), F.col(ORDER))), F.max(F.when(F.col("__i0") == F.lit(key.stop), F.col(ORDER)))).first()
            cond = F.lit(True)
            for label, at, test in ((key.start, found[0], lambda x: F.col(ORDER) >= x), (key.stop, found[1], lambda x: F.col(ORDER) <= x)):
                if label is not None:
                    if at is None:
                        raise KeyError(label)
                    cond = cond & test(at)
            return of, cond, 0
        values = key if isinstance(key, tuple) else (key,)
        cond = F.lit(True)
        for x, v in zip(of._rows.labels, values, strict=False):
            cond = cond & (F.col(x) == F.lit(v))
        return of, cond, len(values)

    def __getitem__(self, key: Any) -> Any:
        rows, columns = self._split(key)
        of, cond, fixed = self._cond(rows)
        out = of._filter(cond)
        if isinstance(of, DataFrame):
            out = out[self._columns(columns)]
        if not fixed:
            return out
        if not out._rows.plan.limit(1).count():
            raise KeyError(rows)
        if fixed < len(of._rows.index):
            return out.droplevel(list(range(fixed)))
        if len(out) == 1:
            found = out.to_pandas()
            return found.iloc[0]
        return out

    def __setitem__(self, key: Any, value: Any) -> None:
        rows, columns = self._split(key)
        of, cond, _ = self._cond(rows)
        self._put(of, cond, self._columns(columns), value)

    def _put(self, of: Frame, cond: Column, columns: Any, value: Any) -> None:
        names = columns if isinstance(columns, list) else [columns]
        hit = of._rows.plan.withColumn("__hit", F.coalesce(cond, F.lit(False)))
        of = type(of)(replace(of._rows, plan=hit), list(of._columns))
        if isinstance(value, Frame):
            a, b = of._met(value)
            new, of = [c for _, c in b._columns] * (len(names) if len(b._columns) == 1 else 1), a
            if of._rows.plan is not hit:
                raise ValueError("assign rows of the same frame")
        else:
            new = [F.lit(value)] * len(names)
        changed = dict(zip(names, new, strict=True)) if isinstance(of, DataFrame) else {of._columns[0][0]: new[0]}
        out = [(n, F.when(F.col("__hit"), changed[n]).otherwise(c) if n in changed else c) for n, c in of._columns]
        plan = of._rows.plan.select(*of._rows.own(), *[c.alias(f"c{i}") for i, (_, c) in enumerate(out)])
        self._of._rows = replace(of._rows, plan=plan)
        self._of._columns = [(n, F.col(f"c{i}")) for i, (n, _) in enumerate(out)]


class _ILoc(_Loc):
    """By position. Slices leave out the end; negative positions count from the end."""

    def _split(self, key: Any) -> tuple[Any, Any]:
        return key if isinstance(key, tuple) and isinstance(self._of, DataFrame) else (key, slice(None))

    def _columns(self, key: Any) -> Any:
        names = [n for n, _ in self._of._columns]
        return names[key] if isinstance(key, (int, slice)) else [names[k] for k in key]

    def _cond(self, key: Any) -> tuple[Frame, Column, int]:
        of = self._of
        if isinstance(key, (Series, list)):
            return super()._cond(key)
        of._rows.need_order()
        if isinstance(key, slice) and key == slice(None):
            return of, F.lit(True), 0
        plan, size = of._rows.numbered(of._plan(), "__at")
        moved = of._with(plan)
        if isinstance(key, slice):
            if key.step not in (None, 1):
                raise NotImplementedError("slices have no step")
            start, stop, _ = key.indices(size)
            return moved, (F.col("__at") >= start) & (F.col("__at") < stop), 0
        if not -size <= key < size:
            raise IndexError(key)
        return moved, F.col("__at") == key % size, max(1, len(of._rows.index))


class GroupBy:
    """Groups of a frame by columns or levels of the labels."""

    def __init__(self, of: DataFrame, by: Any, level: Any, as_index: bool, sort: bool, columns: list[Any] | None = None) -> None:
        if (by is None) == (level is None):
            raise ValueError("give either by or level")
        self._of, self._as_index, self._sort, self._by, self._level_ = of, as_index, sort, by, level
        if by is not None:
            self._keys = list(by) if isinstance(by, list) else [by]
            self._at = [f"c{of._place(k)}" for k in self._keys]
        else:
            own = of._level(level)
            self._keys, self._at = [of._rows.index[i] for i in own], [f"__i{i}" for i in own]
        self._chosen = columns

    def __getitem__(self, columns: Any) -> GroupBy:
        return GroupBy(self._of, self._by, self._level_, self._as_index, self._sort, columns if isinstance(columns, list) else [columns])

    def _results(self, spec: list[tuple[Any, str, Any]]) -> DataFrame:
        plan = self._of._plan().dropna(subset=self._at)
        kinds = dict(plan.dtypes)
        results = [aggregate.aggregate(op, F.col(f"c{self._of._place(c)}") if c is not None else F.lit(1), kinds.get(f"c{self._of._place(c)}" if c is not None else "", "int"), True).alias(f"r{i}") for i, (c, op, _) in enumerate(spec)]
        out = plan.groupBy(*[F.col(k).alias(f"k{i}") for i, k in enumerate(self._at)]).agg(*results)
        keys = [f"k{i}" for i in range(len(self._at))]
        n = len(keys)
        if self._sort:
            out = order.with_rowid(out, keys, name=ORDER)
        own = [ORDER] * self._sort
        if self._as_index:
            plan = out.select(*[F.col(k).alias(f"__i{i}") for i, k in enumerate(keys)], *own, *[F.col(f"r{i}").alias(f"c{i}") for i in range(len(spec))])
            return DataFrame(Rows(plan, tuple(self._keys), self._sort), [(name, F.col(f"c{i}")) for i, (_, _, name) in enumerate(spec)])
        plan = out.select(*own, *[F.col(k).alias(f"c{i}") for i, k in enumerate(keys)], *[F.col(f"r{i}").alias(f"c{n + i}") for i in range(len(spec))])
        return DataFrame(Rows(plan, (), self._sort), [(k, F.col(f"c{i}")) for i, k in enumerate(self._keys)] + [(name, F.col(f"c{n + i}")) for i, (_, _, name) in enumerate(spec)])

    def agg(self, func: Any) -> DataFrame:
        kinds = {n: k for (n, _), k in zip(self._of._columns, self._of._kinds, strict=True)}
        own = self._chosen or [n for n, _ in self._of._columns if self._by is None or n not in self._keys]
        takes = lambda n, op: aggregate.TAKES[op] is None or kinds[n] in aggregate.TAKES[op]
        if isinstance(func, Mapping):
            several = any(not isinstance(o, str) for o in func.values())
            spec = [(n, o, (n, o) if several else n) for n, ops in func.items() for o in ([ops] if isinstance(ops, str) else ops)]
        elif isinstance(func, str):
            spec = [(n, func, n) for n in own if takes(n, func)]
        else:
            spec = [(n, o, (n, o)) for n in own for o in func if takes(n, o)]
        return self._results(spec)

    aggregate = agg

    def size(self) -> Any:
        out = self._results([(None, "size", "size")])
        return Series(out._rows, [(None, out._columns[0][1])]) if self._as_index else out


for _op in ("sum", "prod", "min", "max", "mean", "var", "std", "count", "any", "all"):
    setattr(GroupBy, _op, lambda self, op=_op: self.agg(op))


# Making frames


def from_pandas(data: Any) -> Any:
    """A frame or series with the labels and order of a pandas object."""
    one = isinstance(data, pd.Series)
    frame = data.to_frame() if one else data
    names = [None if one and data.name is None else n for n in frame.columns]
    index = frame.index
    levels = [index.get_level_values(i) for i in range(index.nlevels)]
    flat = pd.DataFrame({**{f"__i{i}": np.asarray(v) for i, v in enumerate(levels)}, ORDER: np.arange(len(frame)), **{f"c{i}": frame.iloc[:, i].array for i in range(len(names))}})
    plan = memory.from_pandas(session(), flat)
    rows = Rows(plan, tuple(index.names), True, (plan, len(frame)))
    return (Series if one else DataFrame)(rows, [(n, F.col(f"c{i}")) for i, n in enumerate(names)])


def from_interchange(data: Any) -> DataFrame:
    """A frame of the columns that another library exports, in their order, labelled by position."""
    table = memory.read_interchange(data)
    at = pa.array(range(len(table)), pa.int64())
    own = pa.Table.from_arrays([at, at, *table.columns], ["__i0", ORDER, *[f"c{i}" for i in range(table.num_columns)]])
    rows = Rows(memory.from_arrow(session(), own), (None,), True)
    return DataFrame(rows, [(n, F.col(f"c{i}")) for i, n in enumerate(table.column_names)])


def frame(data: Any = None, index: Any = None, columns: Any = None, dtype: Any = None) -> DataFrame:
    """A data frame from what pandas makes one of."""
    return from_pandas(pd.DataFrame(data, index=index, columns=columns, dtype=dtype))


def series(data: Any = None, index: Any = None, name: Any = None, dtype: Any = None) -> Series:
    return from_pandas(pd.Series(data, index=index, name=name, dtype=dtype))


def from_spark(plan: Plan, index: Sequence[str] = (), order_by: Sequence[str] = ()) -> DataFrame:
    """A frame over a Spark DataFrame, with columns as labels and an order if given."""
    names = [c for c in plan.columns if c not in index]
    own = plan.select(*[quoted(c).alias(f"__i{i}") for i, c in enumerate(index)], *[quoted(c).alias(f"c{i}") for i, c in enumerate(names)])
    out = DataFrame(Rows(own, tuple(index)), [(n, F.col(f"c{i}")) for i, n in enumerate(names)])
    return out.order_by(order_by) if order_by else out


def read_parquet(path: Any, columns: Sequence[str] | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """Row labels come back where the files tell which columns hold them, also beside ``columns``."""
    labels = parquet.row_labels(session(), path)
    index = [c for c, _ in labels]
    own = None if columns is None else [*index, *[c for c in columns if c not in index]]
    out = from_spark(parquet.read_parquet(session(), path, own), index, order_by)
    return DataFrame(replace(out._rows, index=tuple(n for _, n in labels)), out._columns)


def read_csv(path: Any, index_col: Any = None, order_by: Sequence[str] = (), **options: Any) -> DataFrame:
    plan = csv.read_csv(session(), path, index_col=index_col, **options)
    n = 0 if index_col is None else len(index_col) if isinstance(index_col, (list, tuple)) else 1
    out = from_spark(plan, plan.columns[:n], order_by)
    index = tuple(None if str(x).startswith("Unnamed") else x for x in out._rows.index)
    return DataFrame(replace(out._rows, index=index), out._columns)


def read_table(path: Any, **options: Any) -> DataFrame:
    return read_csv(path, **{"sep": "\t", **options})


def concat(objs: Sequence[Frame], axis: int = 0, ignore_index: bool = False) -> Any:
    """Rows of all, in no order (axis 0), or columns side by side (axis 1, for the same row labels)."""
    objs = list(objs)
    if not objs:
        raise ValueError("no objects to concatenate")
    if axis in (1, "columns"):
        out, n = objs[0] if isinstance(objs[0], DataFrame) else objs[0].to_frame(), 0
        for x in objs[1:]:
            n += 1
            a, b = out._met(x if isinstance(x, DataFrame) else x.to_frame(x.name if x.name is not None else n))
            out = DataFrame(a._rows, a._columns + b._columns)
        return out
    names: list[Any] = []
    for x in objs:
        names += [n for n, _ in x._columns if n not in names]
    if all(isinstance(x, Series) for x in objs):
        names = names[:1]
    levels = min(len(x._rows.index) for x in objs)
    plans = []
    for x in objs:
        p = x._plan()
        at = {n: f"c{i}" for i, (n, _) in enumerate(x._columns)} if isinstance(x, DataFrame) or len(names) > 1 else {names[0]: "c0"}
        plans.append(p.select(*[f"__i{i}" for i in range(levels)], *[F.col(at[n]).alias(f"c{i}") for i, n in enumerate(names) if n in at]))
    plan = sets.concat_rows(plans)
    plan = plan.select(*[f"__i{i}" for i in range(levels)], *[f"c{i}" for i in range(len(names))])
    if ignore_index:
        plan, levels = plan.drop(*[f"__i{i}" for i in range(levels)]), 0
    kind = Series if all(isinstance(x, Series) for x in objs) else DataFrame
    return kind(Rows(plan, objs[0]._rows.index[:levels]), [(n, F.col(f"c{i}")) for i, n in enumerate(names)])


def to_datetime(arg: Any, format: str = "%Y-%m-%d %H:%M:%S") -> Any:
    return arg.str.to_datetime(format) if isinstance(arg, Series) else pd.to_datetime(arg, format=format)
