"""Parquet.

Row labels are ordinary columns of a file. Which columns they are stands in the schema: files written here mark the fields
with ``LEVEL``, and files written by pandas hold a description under the key ``pandas``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.missing import nan_to_null
from ..operators.projection import quoted, select

#: The mark of a field that holds row labels: its level, with ``NAMED`` telling whether the level has a name.
LEVEL, NAMED = "row_label_level", "row_label_named"


def read_parquet(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Tables from a file, files or a folder; only ``columns`` are read. NaN becomes NULL."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    return nan_to_null(select(df, columns) if columns is not None else df)


def to_parquet(df: DataFrame, path: str, compression: str | None = "snappy", mode: str = "error", partition_cols: Sequence[str] | None = None) -> None:
    """A folder with a file for each task. The folder must not exist."""
    if compression not in ("snappy", None):
        raise ValueError(f"compression {compression!r} is not supported")
    if partition_cols:
        raise NotImplementedError("partition_cols is not supported")
    df.write.mode(mode).option("compression", compression or "none").parquet(path)


def mark_labels(df: DataFrame, names: Sequence[str | None]) -> DataFrame:
    """``df`` with its first columns marked as the levels of the row labels; None is a level without a name."""
    marked = {c: {LEVEL: i, NAMED: n is not None} for i, (c, n) in enumerate(zip(df.columns, names, strict=False))}
    return df.select(*[quoted(c).alias(c, metadata=marked[c]) if c in marked else quoted(c) for c in df.columns])


def row_labels(spark: SparkSession, paths: str | Sequence[str]) -> list[tuple[str, str | None]]:
    """The columns that hold row labels, by level, with the levels' names. A range of labels is not in the file: none then."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    own = sorted((f.metadata[LEVEL], f.name, f.metadata[NAMED]) for f in df.schema if LEVEL in f.metadata)
    if own:
        return [(c, c if named else None) for _, c, named in own]
    files = df._jdf.inputFiles()
    if not len(files):
        return []
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0]))
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, spark._jsparkSession.sessionState().newHadoopConf()))
    try:
        told = reader.getFileMetaData().getKeyValueMetaData().get("pandas")
    finally:
        reader.close()
    told = json.loads(told) if told else {}
    levels = [c for c in told.get("index_columns", []) if isinstance(c, str) and c in df.columns]
    names = {c.get("field_name"): c.get("name") for c in told.get("columns", [])}
    return [(c, names.get(c)) for c in levels]
