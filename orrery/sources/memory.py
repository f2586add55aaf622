"""Tables from and to memory, by Arrow."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import interchange
from pyspark.sql import DataFrame, SparkSession

from ..functions.missing import nan_to_null


def from_pandas(spark: SparkSession, data: pd.DataFrame | pd.Series, preserve_index: bool = False) -> DataFrame:
    """NaN, NaT and None become NULL; categories become their strings; labels become strings."""
    frame = data.to_frame(data.name if data.name is not None else "0") if isinstance(data, pd.Series) else data
    frame = frame.rename(columns=str)
    for c in frame.columns:
        if isinstance(frame[c].dtype, pd.CategoricalDtype):
            frame = frame.assign(**{c: frame[c].astype(object)})
    return from_arrow(spark, pa.Table.from_pandas(frame, preserve_index=preserve_index))


def _spark_type(t: pa.DataType) -> pa.DataType:
    """The type that Spark has for ``t``: dictionaries as their values, unsigned integers as the next type that holds them."""
    if pa.types.is_dictionary(t):
        return _spark_type(t.value_type)
    if pa.types.is_timestamp(t):
        return pa.timestamp("us")
    wider = {pa.null(): pa.float64(), pa.uint8(): pa.int16(), pa.uint16(): pa.int32(), pa.uint32(): pa.int64(), pa.uint64(): pa.decimal128(20)}
    return wider.get(t, t)


def from_arrow(spark: SparkSession, table: pa.Table) -> DataFrame:
    fields = [pa.field(f.name, _spark_type(f.type)) for f in table.schema]
    return nan_to_null(spark.createDataFrame(table.cast(pa.schema(fields), safe=False)))


def read_interchange(data: object) -> pa.Table:
    """The Arrow table of an object that exports Arrow's C stream, or else the dataframe interchange protocol.

    Buffers are shared where the other side allows it. Without either protocol a TypeError is raised.
    """
    if hasattr(data, "__arrow_c_stream__"):
        return pa.table(data)
    if hasattr(data, "__dataframe__"):
        return interchange.from_dataframe(data)
    raise TypeError(f"{type(data).__name__} has neither __arrow_c_stream__ nor __dataframe__")


def from_interchange(spark: SparkSession, data: object) -> DataFrame:
    """What ``read_interchange`` takes, as a Spark table. NaN becomes NULL, a dictionary its values, an unsigned integer the next wider type."""
    return from_arrow(spark, read_interchange(data))


def from_dict(spark: SparkSession, columns: Mapping[str, object]) -> DataFrame:
    """Columns by name: lists, NumPy arrays, or scalars for all rows."""
    return from_pandas(spark, pd.DataFrame({str(k): v for k, v in columns.items()}))


def to_pandas(df: DataFrame) -> pd.DataFrame:
    return df.toArrow().to_pandas()


def to_numpy(df: DataFrame) -> np.ndarray:
    return to_pandas(df).to_numpy()


def to_arrow(df: DataFrame) -> pa.Table:
    return df.toArrow()
