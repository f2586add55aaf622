"""Date and time functions. Timestamps have no zone; NULL in, NULL out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of strftime formats, and what Spark's formats have for them.
CODES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "j": "DDD", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "z": "xx", "Z": "VV"}

FIELDS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "weekday": F.weekday}

#: The date forms that CSV columns may have, month first or year first.
CSV_DATES = tuple(f"{d}{t}" for d in ("MM/dd/yyyy", "MM-dd-yyyy", "yyyy-MM-dd", "yyyy/MM/dd", "MM/yyyy", "MM-yyyy", "yyyy-MM", "yyyy/MM") for t in ("", " HH:mm:ss", " hh:mm:ss a", " HH:mm"))


def field(c: Column, name: str) -> Column:
    """year, month, day, hour, minute, second or weekday (Monday is 0), as a smallint."""
    return FIELDS[name](c).cast("smallint")


def spark_format(fmt: str) -> str:
    """A strftime format in Spark's letters."""
    out, i, plain = [], 0, ""
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            if plain:
                out.append(plain)
                plain = ""
            code = fmt[i + 1]
            if code not in CODES and code != "%":
                raise ValueError(f"unknown format code %{code}")
            out.append("%" if code == "%" else CODES[code])
            i += 2
            continue
        plain += f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]
        i += 1
    return "".join([*out, plain]).replace("''", "")


def to_datetime(c: Column, format: str = "%Y-%m-%d %H:%M:%S") -> Column:
    """Parsed by a strftime format; NULL where it doesn't fit."""
    return F.try_to_timestamp(c, F.lit(spark_format(format))).cast("timestamp_ntz")


def parse_csv_date(c: Column) -> Column:
    """Parsed by the first of the forms that fits; NULL for an empty or unknown one."""
    text = F.when(F.trim(c) != "", F.trim(c))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in CSV_DATES]).cast("timestamp_ntz")
