"""Equi-joins in which NULL keys match each other, on columns or row labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .projection import quoted

#: A side is broadcast on request only if the optimizer knows it to be no larger.
BROADCAST_BYTES = 64 << 20


def known_bytes(df: DataFrame) -> int:
    """The optimizer's estimate, an upper bound for what it can't see through."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def merge(
    left: DataFrame,
    right: DataFrame,
    how: str = "inner",
    on: Sequence[str] | str | None = None,
    left_on: Sequence[str] | str | None = None,
    right_on: Sequence[str] | str | None = None,
    suffixes: tuple[str, str] = ("_x", "_y"),
    method: str | None = None,
) -> DataFrame:
    """inner, left or outer join.

    Keys of one name on both sides come out once, for an outer join from whichever side has them. Other names on both
    sides get ``suffixes``. ``method``: None leaves the strategy to the optimizer, ``hash`` and ``sort`` ask for a shuffled
    join, ``broadcast`` for a broadcast of the right side if it is known to be small enough (never for outer).
    """
    if how not in ("inner", "left", "outer"):
        raise NotImplementedError(f"how={how!r}")
    if method not in (None, "hash", "sort", "broadcast"):
        raise ValueError(f"no join method {method!r}")
    if method == "broadcast" and how == "outer":
        raise ValueError("an outer join can't be broadcast")
    as_list = lambda x: [x] if isinstance(x, str) else list(x)
    if on is not None and (left_on is not None or right_on is not None):
        raise ValueError("give either on, or left_on and right_on")
    if (left_on is None) != (right_on is None):
        raise ValueError("give both left_on and right_on")
    if on is None and left_on is None:
        on = [c for c in left.columns if c in right.columns]
        if not on:
            raise ValueError("no common columns to merge on")
    lk, rk = (as_list(on), as_list(on)) if on is not None else (as_list(left_on), as_list(right_on))
    if len(lk) != len(rk):
        raise ValueError("left_on and right_on must have as many keys")
    for df, keys in ((left, lk), (right, rk)):
        if missing := [k for k in keys if k not in df.columns]:
            raise KeyError(f"no columns {missing}")
    shared = [a for a, b in zip(lk, rk, strict=True) if a == b]
    overlap = [c for c in left.columns if c in right.columns and c not in shared]
    if overlap and not any(suffixes):
        raise ValueError(f"columns overlap but no suffix specified: {overlap}")
    l_ = left.toDF(*[f"__l{i}" for i in range(len(left.columns))])
    r_ = right.toDF(*[f"__r{i}" for i in range(len(right.columns))])
    at_l, at_r = {c: f"__l{i}" for i, c in enumerate(left.columns)}, {c: f"__r{i}" for i, c in enumerate(right.columns)}
    if method == "broadcast" and known_bytes(right) <= BROADCAST_BYTES:
        r_ = F.broadcast(r_)
    elif method in ("hash", "sort"):
        r_ = r_.hint("shuffle_hash" if method == "hash" else "merge")
    cond = None
    for a, b in zip(lk, rk, strict=True):
        one = F.col(at_l[a]).eqNullSafe(F.col(at_r[b]))
        cond = one if cond is None else cond & one
    joined = l_.join(r_, cond, {"outer": "full"}.get(how, how))
    out = []
    for c in left.columns:
        own = F.coalesce(at_l[c], at_r[c]) if c in shared and how == "outer" else F.col(at_l[c])
        out.append(own.alias(c + suffixes[0] if c in overlap else c))
    out += [F.col(at_r[c]).alias(c + suffixes[1] if c in overlap else c) for c in right.columns if c not in shared]
    return joined.select(*out)


def join(left: DataFrame, right: DataFrame, index: Sequence[str], how: str = "left", lsuffix: str = "", rsuffix: str = "") -> DataFrame:
    """``merge`` on the row labels of both sides, which are the columns ``index``."""
    return merge(left, right, how, on=list(index), suffixes=(lsuffix, rsuffix))


def merge_on_labels(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_index: Sequence[str], how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y"), method: str | None = None) -> DataFrame:
    """Columns of the left side against row labels of the right, which don't come out."""
    labels = [f"__label{i}" for i in range(len(right_index))]
    named = right.select(*[quoted(c).alias(n) for c, n in zip(right_index, labels, strict=True)], *[quoted(c) for c in right.columns if c not in right_index])
    return merge(left, named, how, left_on=list(left_keys), right_on=labels, suffixes=suffixes, method=method).drop(*labels)
