"""The corpus pipeline: from raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import exact_dedup, minhash_dedup, mixing, packing, quality
from corpusloom.llm.common import numbered, settled, written
from corpusloom.operators.positions import free_name
from corpusloom.session import scratch_path, ship_package


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade reaches the bar; rows are otherwise unchanged."""
    ship_package(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    graded = free_name(docs, "graded")
    rows = quality.scored(docs, model, into=graded)
    return rows.where(F.col(f"{graded}.tail_probability") >= quality.KEEP_TAIL).drop(graded)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space."""
    ship_package(spark)
    rows, number = numbered(docs, "numbered")

    def dropped() -> DataFrame:
        return exact_dedup.exact_dedup(rows, carry=(number,)).where("NOT kept").select(number)

    return _without(rows, settled(dropped, spark, "dropped"), number)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8.

    Rows are told apart by their number, so rows without an id and rows that
    share one take part like any other. Of a group, the row with the smallest id
    stays (a null id counts as the largest), then the one with the smallest number.
    """
    ship_package(spark)
    rows, number = numbered(docs, "numbered")
    ids = rows.select(F.col(number).alias("row"), F.col("doc_id").alias("of_document"), "text")

    def dropped() -> DataFrame:
        groups = written(
            minhash_dedup.minhash_dedup(ids, id_column="row", row_column="of_document").select("row", "of_document", "component_id"),
            "groups",
        )
        order = F.struct(F.col("of_document").isNull().alias("no_id"), "of_document", "row")
        stays = groups.groupBy("component_id").agg(F.count(F.lit(1)).alias("n"), F.min(order).getField("row").alias("stays"))
        told = groups.join(stays.where("n > 1"), "component_id").where("row <> stays")
        return told.select(F.col("row").alias(number))

    return _without(rows, settled(dropped, spark, "dropped"), number)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix reads it, sorted by the training positions."""
    ship_package(spark)
    rows, number = numbered(docs, "numbered")
    place = free_name(rows, "reading")

    def readings() -> DataFrame:
        reading = F.struct("position", "reading").alias(place)
        return mixing.curriculum(mixing.mix_plan(rows, row_column=number)).select(F.col("row").alias(number), reading)

    return (
        rows.join(settled(readings, spark, "readings"), number)
        .repartitionByRange(place, number)
        .sortWithinPartitions(place, number)
        .select(*docs.columns)
    )


def _without(rows: DataFrame, dropped: DataFrame, number: str) -> DataFrame:
    """The rows whose numbers are not among the dropped ones (a written table, so Spark knows its size)."""
    return rows.join(dropped, number, "left_anti").drop(number)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, each in its sequence."""
    ship_package(spark)
    return packing.pack(docs, keep_ids=False)


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_copies),
    ("minhash near-dedup", near_copies),
    ("mixing", mixed_sources),
    ("packing", packed),
]

#: A trained classifier and hashed signatures have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
