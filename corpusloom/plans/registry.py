"""Registered queries: a Spark callable and, where SQL can say it, the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import spread_rows

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the function under its own name."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False, costly: bool = False) -> DataFrame:
    """A table of the data set; ``spread`` for queries with costly work per row, ``costly`` where it is far dearer than a shuffle."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if spread:
        df = spread_rows(df, costly)
    # Zone-less times are UTC; event-time operators need a zoned type.
    for column, dtype in df.dtypes:
        if dtype == "timestamp_ntz":
            df = df.withColumn(column, F.col(column).cast("timestamp"))
    return df


def rounded(column: str, digits: int = 6):
    return F.round(column, digits).alias(column)


def long(column: str):
    return F.col(column).cast("bigint").alias(column)


# The same white-space class as functions.text, in the syntax of the SQL engine.
SQL_WS = (
    r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)


def sql_clean(text: str) -> str:
    """Cleaning in SQL; NFKC is left out, as it changes no row of the tables."""
    controls = rf"regexp_replace({text}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')"
    return f"trim(regexp_replace({controls}, '{SQL_WS}+', ' ', 'g'))"
