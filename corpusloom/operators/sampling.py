"""Splits, class balance, filters and column choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 10_000
RATIO_RANGE = (0.5, 0.95)
ALL_LANGUAGES = "multi"


def _bucket(id_col: str) -> Column:
    """A number below ``BUCKETS`` that depends on the id alone."""
    head = F.conv(F.substring(F.md5(F.col(id_col).cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(BUCKETS))


def split(df: DataFrame, id_col: str, ratio: float = 0.8, alias: str = "split") -> DataFrame:
    """Add train, test or validation: shares r, three and one quarter of the rest; stable for an id."""
    if not RATIO_RANGE[0] <= ratio <= RATIO_RANGE[1]:
        raise ValueError(f"ratio must lie in {RATIO_RANGE}")
    train = round(ratio * BUCKETS)
    test = train + round((1 - ratio) * 0.75 * BUCKETS)
    bucket = _bucket(id_col)
    return df.withColumn(
        alias, F.when(bucket < train, "train").when(bucket < test, "test").otherwise("validation")
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): rows / (classes * rows of the class); a missing label is no class."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"))
    rows, classes = totals.select("rows").scalar(), totals.select("classes").scalar()
    return counts.withColumn("weight", rows / (classes * F.col("n")))


def balanced(df: DataFrame, label: str, id_col: str) -> DataFrame:
    """As many rows of every class as the rarest has: those with the smallest hashes of their ids.

    The hash below which a class keeps its rows is found from counts of a few
    thousand hash ranges; only the rows of the range at the border are ranked.
    """
    rows = df.where(F.col(label).isNotNull()).withColumn("__h", F.md5(F.col(id_col).cast("string"))).withColumn(
        "__range", F.conv(F.substring("__h", 1, 3), 16, 10).cast("int")
    )
    sizes = rows.groupBy(label, "__range").agg(F.count(F.lit(1)).alias("__n"))
    least = sizes.groupBy(label).agg(F.sum("__n").alias("n")).agg(F.min("n")).scalar()
    before = F.coalesce(
        F.sum("__n").over(Window.partitionBy(label).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    room = sizes.withColumn("__room", least - before).where("__room > 0")
    placed = rows.join(room, [label, "__range"])
    rank = F.row_number().over(Window.partitionBy(label, "__range").orderBy("__h", id_col))
    border = placed.where("__n > __room").withColumn("__rank", rank).where("__rank <= __room").drop("__rank")
    return placed.where("__n <= __room").unionByName(border).select(*df.columns)


def filter_language(df: DataFrame, language: str, column: str = "lang") -> DataFrame:
    """Rows of one language; ``multi`` keeps all."""
    return df if language == ALL_LANGUAGES else df.where(F.col(column) == language)


def filter_domain(df: DataFrame, domain: str | None, column: str = "source") -> DataFrame:
    """Rows of one domain; no domain keeps all."""
    return df if domain is None else df.where(F.col(column) == domain)


def select_columns(df: DataFrame, target: str, inputs: Sequence[str]) -> DataFrame:
    """The input columns, then the target; each must exist."""
    names = list(dict.fromkeys([*inputs, target]))
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return df.select(*[F.col(f"`{n}`") for n in names])
