"""Queries over sources and sinks. Files are written by Spark from the tables first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.catalog import head_sample, preview
from corpusloom.plans.registry import query, table
from corpusloom.session import scratch_path
from corpusloom.sources.readers import file_inventory, load
from corpusloom.sources.writers import save_jsonl

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
_PER_SOURCE = """
SELECT source, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars,
       CAST(sum(doc_id) AS BIGINT) AS id_sum, count(DISTINCT lang) AS langs, CAST(sum(n_chars) AS BIGINT) AS stated_chars
FROM documents GROUP BY source
"""


def _per_source(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum(F.length("text")).alias("chars"),
        F.sum("doc_id").cast("bigint").alias("id_sum"),
        F.count_distinct("lang").alias("langs"),
        F.sum(F.col("n_chars").cast("bigint")).alias("stated_chars"),
    )


@query(_PER_SOURCE)
def load_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_source(load(spark, f"{sf_dir}/documents.parquet"))


@query(_PER_SOURCE)
def load_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "documents") + ".csv"
    table(spark, sf_dir, "documents").write.option("header", True).option("escape", '"').csv(path)
    return _per_source(load(spark, path, multiline=True))


@query(
    """
    SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS o_custkey, o_totalprice,
           CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS status
    FROM orders
    """
)
def load_csv_missing_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "orders") + ".CSV"
    status = F.when(F.col("o_orderstatus") == "P", "N/A").otherwise(F.col("o_orderstatus"))
    table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", status.alias("status")
    ).write.option("header", True).csv(path)
    return load(spark, path, multiline=False)


@query(_PER_SOURCE)
def load_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "documents") + ".jsonl"
    table(spark, sf_dir, "documents").write.json(path)
    return _per_source(load(spark, path, schema=DOCUMENTS))


@query(_PER_SOURCE)
def load_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of records: one array per 500 neighbouring ids, so an array stays small."""
    path = scratch_path(spark, "documents") + ".json"
    block = F.floor(F.col("doc_id") / 500).alias("block")
    arrays = table(spark, sf_dir, "documents").groupBy(block).agg(
        F.to_json(F.collect_list(F.struct("doc_id", "text", "lang", "source", "n_chars"))).alias("value")
    )
    arrays.select("value", "block").write.partitionBy("block").text(path)
    return _per_source(load(spark, path, "json"))


@query(
    """
    SELECT count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars
    FROM (SELECT unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line
          FROM documents)
    """
)
def load_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "documents") + ".txt"
    table(spark, sf_dir, "documents").select("text").write.text(path)
    return load(spark, path).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars")
    )


@query("SELECT doc_id, text, lang, source, n_chars, CAST(NULL AS VARCHAR) AS note FROM documents")
def save_as_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("note", F.lit(None).cast("string"))
    path = save_jsonl(docs, scratch_path(spark, "saved"), "run1")
    return load(spark, path, "jsonl", schema=docs.schema)


@query()
def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_inventory(spark, sf_dir).select(
        F.substring_index("path", "/", -1).alias("file"), "size"
    )


@query(
    """
    SELECT doc_id, text, lang, (SELECT count(*) FROM documents) AS total
    FROM documents ORDER BY doc_id LIMIT 10
    """
)
def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return preview(docs, "doc_id", 10)


@query("SELECT doc_id, source, text FROM documents ORDER BY doc_id LIMIT 20")
def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return head_sample(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id", 20)
