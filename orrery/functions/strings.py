"""String functions. NULL in, NULL out."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ``strip`` removes by default.
WHITE = " \t\n\r"


def contains(c: Column, pattern: str) -> Column:
    """Whether the regular expression is found anywhere."""
    return c.rlike(pattern)


def pad(c: Column, width: int, side: str = "left", fillchar: str = " ") -> Column:
    """``c`` filled up to ``width``, never cut. ``both`` puts the smaller half on the left."""
    if len(fillchar) != 1:
        raise TypeError("fillchar must be a character")
    if side not in ("left", "right", "both"):
        raise ValueError("side must be left, right or both")
    n = F.char_length(c)
    if side == "left":
        padded = F.lpad(c, width, fillchar)
    elif side == "right":
        padded = F.rpad(c, width, fillchar)
    else:
        left = F.floor((F.lit(width) - n) / 2).cast("int")
        padded = F.rpad(F.concat(F.repeat(F.lit(fillchar), left), c), width, fillchar)
    return F.when(n >= width, c).otherwise(padded)


def zfill(c: Column, width: int) -> Column:
    return pad(c, width, "left", "0")


def strip(c: Column, chars: str | None = None) -> Column:
    return F.btrim(c, F.lit(WHITE if chars is None else chars))


def lower(c: Column) -> Column:
    return F.lower(c)


def upper(c: Column) -> Column:
    return F.upper(c)


def swapcase(c: Column) -> Column:
    """ASCII letters with the other case."""
    return F.translate(c, string.ascii_letters, string.ascii_letters.swapcase())
