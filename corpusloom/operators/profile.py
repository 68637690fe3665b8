"""Profiling: counts, distinct values and text lengths per column.

All figures come from one long form, one row per cell, aggregated first by
(column, value) and then by column. Equal values meet in the map-side combine,
so a value filling a third of the table costs one row per map task, and a
wide table needs one scan and one shuffle rather than one per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import estimated_tokens

# What a missing value reads as when it is measured as text.
MISSING_AS_TEXT = "nan"


def as_text(df: DataFrame, name: str) -> Column:
    """The cell as text, the way lengths are measured: missing reads as ``nan``."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(MISSING_AS_TEXT))


def _value_key(value: Column, dtype: T.DataType) -> Column:
    """Digest that stands for a value where only equality matters, null for missing."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        value = F.when(~F.isnan(value), value + F.lit(0.0))  # NaN is missing, -0.0 equals 0.0
    return F.unhex(F.md5(value.cast("string")))


def _cells(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per cell: position of its column, value key, length and size."""
    cells = []
    for position, name in enumerate(columns):
        text = as_text(df, name)
        cells.append(
            F.struct(
                F.lit(position).alias("position"),
                _value_key(F.col(f"`{name}`"), df.schema[name].dataType).alias("key"),
                F.length(text).cast("bigint").alias("chars"),
                estimated_tokens(text).alias("tokens"),
            )
        )
    return df.select(*by, F.explode(F.array(*cells)).alias("cell")).select(*by, "cell.*")


def column_profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    by: Sequence[str] = (),
    exact_distinct: bool = True,
) -> DataFrame:
    """One row per column (and per dataset, if ``by`` names the dataset columns).

    Columns: position, column, dtype, is_text, rows, missing, distinct_values,
    duplicates (a repeat of any value, missing included), total_chars,
    avg_length, min_length, max_length, token_estimate.

    ``exact_distinct=False`` replaces the count of distinct values by a sketch,
    which needs no shuffle of values and gives no ``duplicates``.
    """
    by = list(by)
    columns = [c for c in (columns or df.columns) if c not in by]
    cells = _cells(df, columns, by)
    sums = [
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.sum("chars").alias("total_chars"),
        F.min("min_length").cast("bigint").alias("min_length"),
        F.max("max_length").cast("bigint").alias("max_length"),
        F.sum("tokens").alias("token_estimate"),
    ]
    if exact_distinct:
        per_value = cells.groupBy(*by, "position", "key").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("chars").alias("chars"),
            F.min("chars").alias("min_length"),
            F.max("chars").alias("max_length"),
            F.sum("tokens").alias("tokens"),
        )
        distinct = F.count("key").alias("distinct_values")
        duplicates = F.sum(F.col("n") - 1).alias("duplicates")
    else:
        per_value = cells.withColumns(
            {"n": F.lit(1).cast("bigint"), "min_length": F.col("chars"), "max_length": F.col("chars")}
        )
        distinct = F.approx_count_distinct("key").alias("distinct_values")
        duplicates = F.lit(None).cast("bigint").alias("duplicates")
    per_column = per_value.groupBy(*by, "position").agg(*sums, distinct, duplicates)

    def label(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("position") + 1)

    types = [df.schema[c].dataType for c in columns]
    return per_column.select(
        *by,
        "position",
        label(list(columns)).alias("column"),
        label([t.simpleString() for t in types]).alias("dtype"),
        label([isinstance(t, T.StringType) for t in types]).alias("is_text"),
        "rows", "missing", "distinct_values", "duplicates", "total_chars",
        (F.col("total_chars") / F.col("rows")).alias("avg_length"),
        "min_length", "max_length", "token_estimate",
    )


def _counts_as_text(min_avg: float) -> Column:
    return F.col("is_text") & (F.col("avg_length") > min_avg)


def _rank_for_primary() -> Column:
    """Longest average first; the earlier column wins a tie."""
    return F.struct(F.col("avg_length"), -F.col("position"))


def table_size(df: DataFrame) -> DataFrame:
    """Row count, column count and the column names joined by commas."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.lit(",".join(df.columns)).alias("column_names"),
    )


def missing_per_column(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, missing): no value is shuffled, only one row of counters."""
    columns = list(columns or df.columns)

    def is_missing(name: str) -> Column:
        value = F.col(f"`{name}`")
        if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
            return value.isNull() | F.isnan(value)
        return value.isNull()

    counts = df.agg(*[F.count_if(is_missing(c)).alias(c) for c in columns])
    return counts.unpivot([], [f"`{c}`" for c in columns], "column", "missing")


def distinct_per_column(
    df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True
) -> DataFrame:
    """(column, distinct_values), missing excluded."""
    return column_profile(df, columns, exact_distinct=exact).select("column", "distinct_values")


#: Sketches of 2^12 registers: a standard error of about 1.6 %.
SKETCH_BITS = 12


def distinct_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by…, column, sketch): one mergeable sketch of the distinct values per column, missing excluded.

    One scan and one row per group and column: kept beside the table, the sketches
    of new parts unite with the old ones (:func:`united_distinct`) without reading
    the table again.
    """
    present = {c: F.when(F.col(c).isNotNull(), as_text(df, c)) for c in columns}
    made = df.groupBy(*by).agg(*[F.hll_sketch_agg(value, SKETCH_BITS).alias(f"__{i}") for i, value in enumerate(present.values())])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"__{i}").alias("sketch")) for i, c in enumerate(columns)]
    return made.select(*by, F.inline(F.array(*cells)))


def united_distinct(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by…, column, distinct_values): estimates from all sketches of a column."""
    united = F.hll_sketch_estimate(F.hll_union_agg("sketch"))
    return sketches.groupBy(*by, "column").agg(united.alias("distinct_values"))


def text_lengths(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, avg_length, min_length, max_length) of the string columns in one pass."""
    columns = [
        c for c in (columns or df.columns) if isinstance(df.schema[c].dataType, T.StringType)
    ]
    cells = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(i).alias("position"), F.length(as_text(df, c)).alias("chars"))
                    for i, c in enumerate(columns)
                ]
            )
        ).alias("cell")
    ).select("cell.*")
    lengths = cells.groupBy("position").agg(
        F.avg("chars").alias("avg_length"),
        F.min("chars").cast("bigint").alias("min_length"),
        F.max("chars").cast("bigint").alias("max_length"),
    )
    names = F.array(*[F.lit(c) for c in columns])
    return lengths.withColumn("column", F.element_at(names, F.col("position") + 1))


def detect_text_columns(df: DataFrame, min_avg: float = 10) -> DataFrame:
    """String columns whose mean length is above ``min_avg``, in column order."""
    found = text_lengths(df).where(F.col("avg_length") > min_avg)
    return found.select("position", "column", "avg_length").orderBy("position")


def primary_text_column(df: DataFrame, min_avg: float = 10) -> DataFrame:
    """One row: the text column with the longest mean, null if there is none."""
    return text_lengths(df).agg(
        F.max_by(
            F.when(F.col("avg_length") > min_avg, F.col("column")),
            F.when(F.col("avg_length") > min_avg, _rank_for_primary()),
        ).alias("text_column")
    )


def text_length_stats(df: DataFrame, text: str) -> DataFrame:
    return text_lengths(df, [text]).select("avg_length", "min_length", "max_length")


def avg_row_length(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Characters of all cells of a row, averaged over the rows."""
    columns = list(columns or df.columns)
    total = sum((F.length(as_text(df, c)) for c in columns[1:]), F.length(as_text(df, columns[0])))
    return df.agg(F.avg(total).alias("avg_text_length"))


def avg_of_column_means(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean over the columns of their mean cell length."""
    columns = list(columns or df.columns)
    means = [F.avg(F.length(as_text(df, c))) for c in columns]
    return df.agg((sum(means[1:], means[0]) / len(means)).alias("avg_text_length"))


def label_distribution(df: DataFrame, target: str) -> DataFrame:
    """(class, n), one row per value of ``target``, missing as its own class."""
    return df.groupBy(F.col(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def class_count(df: DataFrame, target: str) -> DataFrame:
    """Distinct classes, once with missing as the empty class and once without it."""
    value = F.col(target).cast("string")
    classes = df.groupBy(F.coalesce(value, F.lit("")).alias("class")).agg(
        F.count(value).alias("present")
    )
    return classes.agg(
        F.count(F.lit(1)).alias("with_missing"),
        F.count_if(F.col("present") > 0).alias("without_missing"),
    )


def dataset_stats(
    df: DataFrame, by: Sequence[str] = (), min_avg: float = 10, columns: Sequence[str] | None = None
) -> DataFrame:
    """One row per dataset: size, text columns, text length, tokens, missing, duplicates.

    Duplicates, token estimate and length refer to the primary text column.
    """
    by = list(by)
    profiled = column_profile(df, columns, by)
    text = _counts_as_text(min_avg)
    rank = F.when(text, _rank_for_primary())

    def of_primary(value: Column) -> Column:
        return F.max_by(value, rank)

    # Bounded group: one row per column of the table.
    names = F.array_sort(F.collect_list(F.when(text, F.struct("position", "column"))))
    return profiled.groupBy(*by).agg(
        F.max("rows").alias("rows"),
        F.count(F.lit(1)).alias("columns"),
        F.array_join(names["column"], ",").alias("text_columns"),
        of_primary(F.when(text, F.col("column"))).alias("text_column"),
        of_primary(F.col("avg_length")).alias("avg_text_length"),
        of_primary(F.col("token_estimate")).alias("token_count_estimate"),
        (F.sum("missing") > 0).alias("has_missing"),
        of_primary(F.col("duplicates") / F.col("rows")).alias("duplicate_ratio"),
    )


def profile(df: DataFrame, run_id: str, min_avg: float = 10) -> DataFrame:
    """Whole profile of one dataset as one nested row; one scan, one shuffle."""
    profiled = column_profile(df)
    text = _counts_as_text(min_avg)
    rank = F.when(text, _rank_for_primary())

    def per_column(value: str) -> Column:
        # Bounded group: one entry per column of the table.
        return F.map_from_entries(F.collect_list(F.struct("column", value)))

    ordered = F.array_sort(F.collect_list(F.struct("position", "column")))
    text_ordered = F.array_sort(F.collect_list(F.when(text, F.struct("position", "column"))))
    lengths = F.struct("avg_length", "min_length", "max_length")
    return profiled.agg(
        F.lit(f"ds_{run_id[:8]}").alias("dataset_id"),
        F.max("rows").alias("rows"),
        ordered["column"].alias("columns"),
        F.max_by(F.when(text, F.col("column")), rank).alias("text_column"),
        text_ordered["column"].alias("text_columns"),
        F.struct(
            per_column("dtype").alias("dtypes"),
            per_column("missing").alias("missing_values"),
            per_column("distinct_values").alias("unique_values"),
            F.max_by(F.when(text, lengths), rank).alias("text_stats"),
        ).alias("stats"),
    )
