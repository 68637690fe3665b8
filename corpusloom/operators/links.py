"""Connected components of links, by minimum labels written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import scratch_path


def _kept(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "labels")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def least_reachable(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label): the smallest id reachable over the links, for every id that has one.

    Each round takes the least label among the neighbours and then the label of
    that label, so the distance covered doubles; it ends when no label changes.
    Every round is written, so a lost executor does not repeat the earlier ones.
    """
    both = _kept(
        links.select(F.col(a).alias("id"), F.col(b).alias("other"))
        .unionByName(links.select(F.col(b).alias("id"), F.col(a).alias("other")))
        .where("id != other").distinct()
    )
    labels = _kept(both.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("label")))
    while True:
        seen = both.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("label").alias("near"))
        lower = labels.join(seen, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        further = labels.select(F.col("id").alias("label"), F.col("label").alias("beyond"))
        new = _kept(
            lower.join(further, "label", "left").select("id", F.coalesce(F.least("label", "beyond"), "label").alias("label"), "old")
        )
        changed = not new.where("label != old").isEmpty()
        labels = new.select("id", "label")
        if not changed:
            return labels
