"""Scores from references that are tokenized once for several predictions, and costly rows on all cores."""

from pyspark.sql import functions as F

from corpusloom.operators import evaluate as E
from corpusloom.plans import evaluation_queries as Q
from corpusloom.session import spread_rows


def test_scores_with_shared_reference_tokens(spark):
    rows = [(1, "the cat, sat.", "the cat sat."), (1, "x", "x y-z"), (2, None, "a b"), (2, "a", None), (3, "", ""), (3, "3.5%", "3.5 %")]
    pairs = spark.createDataFrame(rows, "k int, prediction string, reference string")
    plain = E.pair_scores(pairs, keep=["k"]).collect()
    shared = E.pair_scores(E.reference_tokens(pairs), keep=["k"]).collect()
    assert sorted(map(str, plain)) == sorted(map(str, shared)) and len(plain) == len(rows)


def test_one_row_group_is_scored_on_all_cores(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a b, c").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    pairs = Q.model_pairs(spark, str(tmp_path))
    assert pairs.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
    assert "bleu_reference" in pairs.columns and pairs.count() == 100
    one = spark.range(5).coalesce(1)
    assert spread_rows(one).rdd.getNumPartitions() == 1
