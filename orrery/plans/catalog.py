"""The registered queries and their SQL. A query takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.parquet import read_parquet

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its own name."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", list(columns) or None)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of a sum doesn't show. A zero keeps its sign, which F.round drops."""
    return df.select(*[F.when(F.col(c) == 0, F.col(c)).otherwise(F.round(F.col(c), digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def queries() -> dict[str, Query]:
    from . import frame_queries, io_queries, relational_queries, scalar_queries  # noqa: F401  they register themselves

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
