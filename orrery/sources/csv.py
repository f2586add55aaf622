"""CSV and other delimited text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import spark_type
from ..functions.datetimes import parse_csv_date
from ..functions.missing import nan_to_null
from ..operators.projection import quoted

#: What counts as missing, true and false in every file.
NA = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
TRUE, FALSE = ("True", "TRUE", "true"), ("False", "FALSE", "false")


def _value(c: Column, kind: str, na: Sequence[str], true: Sequence[str], false: Sequence[str], date: bool) -> Column:
    text = F.when(~c.isin(list(na)), c)
    if date or kind == "timestamp_ntz":
        return parse_csv_date(text)
    if kind == "boolean":
        return F.when(text.isin(list(true)), True).when(text.isin(list(false)), False)
    return text if kind == "string" else F.trim(text).cast(kind)


def _header(spark: SparkSession, path: str, sep: str, quote: str) -> list[str]:
    row = spark.read.csv(path, sep=sep, quote=quote, header=False).first()
    return [] if row is None else [str(x) if x is not None else f"Unnamed: {i}" for i, x in enumerate(row)]


def read_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    sep: str = ",",
    delimiter: str | None = None,
    header: int | str | None = "infer",
    names: Sequence[str] | None = None,
    index_col: int | str | Sequence[int | str] | None = None,
    usecols: Sequence[int | str] | None = None,
    dtype: object = None,
    true_values: Sequence[str] = (),
    false_values: Sequence[str] = (),
    skiprows: int = 0,
    skipfooter: int = 0,
    nrows: int | None = None,
    na_values: Sequence[str] = (),
    skip_blank_lines: bool = True,
    parse_dates: Sequence[int | str] | bool = False,
    compression: str | None = "infer",
    quotechar: str = '"',
    doublequote: bool = True,
    verify_header: bool = False,
) -> DataFrame:
    """Typed columns of one or more delimited files.

    ``dtype`` is one type or a dictionary for all columns; without it types are inferred. Compression is by file extension.
    ``verify_header`` checks that all files have the first one's header. ``index_col`` puts these columns first, as labels.
    ``nrows``, ``skiprows`` and ``skipfooter`` count lines in file order; the last two hold for each file.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise ValueError("no files to read")
    sep = sep if delimiter is None else delimiter
    if len(sep) != 1 or len(quotechar) != 1:
        raise ValueError("sep and quotechar must be single characters")
    if header not in ("infer", None, 0):
        raise ValueError("header must be 0, None or 'infer'")
    if skipfooter and nrows is not None:
        raise ValueError("skipfooter is not supported with nrows")
    if min(skiprows, skipfooter, nrows or 0) < 0:
        raise ValueError("skiprows, skipfooter and nrows must not be negative")
    if compression not in ("infer", None, "gzip", "bz2"):
        raise ValueError(f"compression {compression!r} is not supported")
    if names is not None and len(set(names)) != len(names):
        raise ValueError("duplicate names are not allowed")
    has_header = header == 0 or (header == "infer" and names is None)
    first = _header(spark, paths[0], sep, quotechar)
    if has_header and verify_header:
        for p in paths[1:]:
            if _header(spark, p, sep, quotechar) != first:
                raise ValueError(f"{p} has another header than {paths[0]}")
    labels = list(names) if names is not None else first if has_header else [str(i) for i in range(len(first))]
    if len(set(labels)) != len(labels):
        raise ValueError("duplicate column names are not allowed")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(max(len(labels), len(first)))])
    options = {"sep": sep, "quote": quotechar, "escape": quotechar if doublequote else "\\", "header": has_header and not skiprows, "mode": "PERMISSIVE", "enforceSchema": True, "emptyValue": "", "ignoreLeadingWhiteSpace": False}
    raw = spark.read.schema(schema).options(**options).csv(paths)
    # The reader drops blank lines itself; a row of empty fields is a row. With one column the two are the same.
    if skip_blank_lines and len(raw.columns) == 1:
        raw = raw.filter(F.col(raw.columns[0]).isNotNull())
    if skiprows or skipfooter or nrows is not None:
        raw = _lines(raw, paths, skiprows + (has_header and skiprows > 0), skipfooter, nrows)
    dates = list(range(len(labels))) if parse_dates is True else [labels.index(d) if isinstance(d, str) else d for d in (parse_dates or [])]
    if any(not 0 <= d < len(labels) for d in dates):
        raise ValueError("parse_dates names no column")
    if isinstance(dtype, Mapping):
        if missing := [c for c in labels if c not in dtype]:
            raise ValueError(f"dtype must cover all columns; {missing} are missing")
        kinds = [spark_type(dtype[c]) for c in labels]
    elif dtype is not None:
        kinds = [spark_type(dtype)] * len(labels)
    else:
        kinds = _inferred(raw, len(labels), [*NA, *na_values], [*TRUE, *true_values, *FALSE, *false_values])
    na, true, false = [*NA, *na_values], [*TRUE, *true_values], [*FALSE, *false_values]
    out = raw.select(*[_value(F.col(f"c{i}"), kinds[i], na, true, false, i in dates).alias(c) for i, c in enumerate(labels)])
    if usecols is not None:
        out = out.select(*[quoted(labels[c] if isinstance(c, int) else c) for c in usecols])
    if index_col is not None:
        own = [index_col] if isinstance(index_col, (int, str)) else list(index_col)
        own = [labels[c] if isinstance(c, int) else c for c in own]
        out = out.select(*[quoted(c) for c in own], *[quoted(c) for c in out.columns if c not in own])
    return nan_to_null(out)


def _lines(raw: DataFrame, paths: Sequence[str], skip: int, foot: int, nrows: int | None) -> DataFrame:
    """Lines by their number in their file; files in order of their names. Each file is numbered by one task, as it is read."""
    numbered = raw.select("*", F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__at"))
    own = Window.partitionBy("__file").orderBy("__at")
    rows = numbered.withColumn("__n", F.row_number().over(own))
    if foot:
        rows = rows.withColumn("__of", F.count(F.lit(1)).over(Window.partitionBy("__file"))).filter(F.col("__n") <= F.col("__of") - foot)
    if skip:
        rows = rows.filter(F.col("__n") > skip)
    if nrows is not None:
        rows = rows.orderBy("__file", "__n").limit(nrows)
    return rows.select(*raw.columns)


def _inferred(raw: DataFrame, n: int, na: Sequence[str], booleans: Sequence[str]) -> list[str]:
    """bigint, double, boolean or string for each column, from all rows: one row of counts comes to the driver."""
    if not n:
        return []
    counts = []
    for i in range(n):
        c = F.when(~quoted(raw.columns[i]).isin(list(na)), F.trim(quoted(raw.columns[i])))
        counts += [F.count(x).alias(f"x{i}_{k}") for k, x in enumerate((c, c.try_cast("bigint"), c.try_cast("double"), F.when(c.isin(list(booleans)), 1)))]
    row = raw.agg(F.count(F.lit(1)).alias("rows"), *counts).first()
    out = []
    for i in range(n):
        values, whole, doubles, truths = (row[f"x{i}_{k}"] for k in range(4))
        # Integers can't be missing; a column with nothing but missing values is one of doubles.
        out.append("boolean" if values and truths == values else "bigint" if values and whole == values == row["rows"] else "double" if doubles == values else "string")
    return out


def read_table(spark: SparkSession, paths: str | Sequence[str], sep: str = "\t", **options) -> DataFrame:
    """``read_csv`` with tabs."""
    return read_csv(spark, paths, sep=sep, **options)


def to_csv(df: DataFrame, path: str, sep: str = ",", na_rep: str = "", columns: Sequence[str] | None = None, header: bool = True, partition: bool = False, line_terminator: str = "\n", compression: str | None = None, mode: str = "error") -> None:
    """A folder of delimited files: one file, or with ``partition`` one for each task."""
    out = df.select(*[quoted(c) for c in columns]) if columns is not None else df
    types = dict(out.dtypes)
    text = out.select(*[F.when(quoted(c), "True").when(~quoted(c), "False").alias(c) if types[c] == "boolean" else quoted(c) for c in out.columns])
    writer = (text if partition else text.coalesce(1)).write.mode(mode)
    options = {"sep": sep, "nullValue": na_rep, "emptyValue": '""', "header": header, "lineSep": line_terminator, "escape": '"', "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}
    writer.options(**options, **({"compression": compression} if compression else {})).csv(path)
