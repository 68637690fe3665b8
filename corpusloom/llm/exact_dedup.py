"""Exact de-duplication by content sort, in DataFrame operations only.

Rows are range-partitioned by sampled splitters over the head of the normalised
text and a fingerprint of the rest, sorted within the partitions by the whole
text, and neighbours are compared in full: equal texts stand next to each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACE, written

HOT_TEXTS = 256
SALTS = 64
SPLITTER_CHARS = 32


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def exact_dedup(
    docs: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    carry: tuple[str, ...] = (),
    hot_texts: int = HOT_TEXTS,
    salts: int = SALTS,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, and the columns to ``carry``.

    Of equal texts the row with the most code points before normalising stays,
    then the one with the smallest id (a null id counts as the largest).

    The ``hot_texts`` most frequent fingerprints are spread over ``salts`` keys
    each, so that a text that fills a third of the table is sorted in many
    tasks; every other text has at most one ``hot_texts``-th of the rows. The
    parts of a hot text are then merged through one row per part. The driver
    holds ``hot_texts`` numbers.

    Null and empty texts form one group. Repeated rows are members like any
    other; of rows that agree in length and id, one is kept. An empty table
    gives an empty result. Other columns are not read.
    """
    # Written once: counting and sampling then read the narrow columns only.
    rows = written(
        docs.select(
            F.col(id_column).alias("id"),
            F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint").alias("n"),
            normalised(F.col(text)).alias("body"),
            F.struct(F.lit(0).alias("_"), *carry).alias("carried"),
        ).select("*", F.xxhash64("body").alias("fp"), F.substring("body", 1, SPLITTER_CHARS).alias("head")),
        "normalised",
    )
    hot = [
        row.fp
        for row in rows.groupBy("fp").count().where("count > 1").orderBy(F.desc("count"), "fp").limit(hot_texts).collect()
    ]
    is_hot = F.col("fp").isin(hot) if hot else F.lit(False)
    spread = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(salts)).cast("int")
    rows = rows.withColumn("part", F.when(is_hot, spread).otherwise(F.lit(-1)))
    # The window's key holds the splitters' columns, so no second exchange is needed, and its
    # sort compares neighbours by the whole text.
    splitters = ["head", "fp", "part"]
    same = Window.partitionBy(*splitters, "body")
    best = same.orderBy(F.desc("n"), F.asc_nulls_last("id"))
    sorted_rows = (
        rows.repartitionByRange(*splitters)
        .withColumn("place", F.row_number().over(best))
        .withColumn("first", F.first(F.struct("n", "id")).over(best))
        .withColumn("size", F.count(F.lit(1)).over(same))
        .select("id", "carried", "place", "first", "size", "part", F.sha2(F.col("body").cast("binary"), 256).alias("text_sha256"))
    )
    groups = written(sorted_rows, "content-sort")
    order = F.struct(
        (-F.col("first.n")).alias("n"), F.col("first.id").isNull().alias("no_id"), F.col("first.id").alias("id")
    )
    merged = (
        groups.where("part >= 0 AND place = 1")
        .groupBy("text_sha256")
        .agg(F.min(order).alias("whole"), F.sum("size").alias("whole_size"), F.min_by("part", order).alias("whole_part"))
    )
    whole = F.col("part") >= 0
    return (
        # At most ``hot_texts`` fingerprints have parts, so this side has a fixed bound.
        groups.join(F.broadcast(merged), "text_sha256", "left")
        .select(
            F.col("id").alias(id_column),
            F.when(whole, F.col("whole.id")).otherwise(F.col("first.id")).alias("keep_id"),
            F.when(whole, F.col("whole_size")).otherwise(F.col("size")).cast("bigint").alias("group_size"),
            ((F.col("place") == 1) & (~whole | (F.col("part") == F.col("whole_part")))).alias("kept"),
            "text_sha256",
            *[F.col("carried").getField(c).alias(c) for c in carry],
        )
    )
