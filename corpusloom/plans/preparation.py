"""The end-to-end jobs: profile, validate, preprocess, evaluate and compare."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.chunk import chunk_dataset
from corpusloom.operators.clean import clean_column
from corpusloom.operators.compare import compare_models
from corpusloom.operators.dedup import exact_dedup
from corpusloom.operators.evaluate import compute_all
from corpusloom.operators.profile import profile
from corpusloom.operators.template import OUTPUT_COLUMN, apply_template
from corpusloom.operators.tokenize import count_tokens
from corpusloom.operators.validate import validation_report
from corpusloom.session import through_table
from corpusloom.sources.readers import load
from corpusloom.sources.writers import save_jsonl

Stage = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class PreprocessConfig:
    """Switches of the preprocessing job, with its defaults."""

    clean: bool = True
    aggressive_clean: bool = False
    dedup: bool = True
    template: str | None = None
    template_mapping: Mapping[str, str] = field(default_factory=dict)
    chunk: bool = False
    max_length: int = 512
    chunk_overlap: int = 50
    null_policy: str = "literal"
    vocabulary: str | None = None
    special_tokens: bool = False
    #: Counts the tokens of a text column in place of the tokenizer.
    token_counter: Callable[[Column], Column] | None = None


def run_stages(df: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """Apply table-to-table steps in order; the job stays lazy."""
    for stage in stages:
        df = df.transform(stage)
    return df


def preprocess(
    df: DataFrame, text: str, order_by: str, config: PreprocessConfig = PreprocessConfig()
) -> DataFrame:
    """clean, dedup, template, chunk, count tokens. Only texts that may be repeated are shuffled, by dedup.

    After a template the text lives in column ``text`` and only the ordering
    column is kept beside it.
    """
    stages: list[Stage] = []
    column = text
    if config.clean:
        stages.append(lambda d: clean_column(d, text, config.aggressive_clean, config.null_policy))
    if config.dedup:
        # Cleaning is costly and exact_dedup reads its input three times: it is written once.
        stages.append(lambda d: exact_dedup(through_table(d, "cleaned") if config.clean else d, text, order_by))
    if config.template:
        column = OUTPUT_COLUMN
        stages.append(
            lambda d: apply_template(d, config.template, config.template_mapping, keep=[order_by])
        )
    if config.chunk:
        stages.append(lambda d: chunk_dataset(d, column, config.max_length, config.chunk_overlap))
    if config.token_counter is not None:
        stages.append(lambda d: d.withColumn("token_count", config.token_counter(F.col(column))))
    else:
        stages.append(lambda d: count_tokens(d, column, config.vocabulary, config.special_tokens))
    return run_stages(df, stages)


def processing_stats(original: DataFrame, processed: DataFrame) -> DataFrame:
    """original, final and removed samples with token figures, as one row."""
    before = original.agg(F.count(F.lit(1))).scalar()
    tokens = F.col("token_count").cast("bigint")
    final = processed.agg(
        F.count(F.lit(1)).alias("final_samples"),
        F.coalesce(F.round(F.avg(tokens), 2), F.lit(0.0)).alias("avg_tokens"),
        F.coalesce(F.min(tokens), F.lit(0)).alias("min_tokens"),
        F.coalesce(F.max(tokens), F.lit(0)).alias("max_tokens"),
    )
    counted = final.withColumn("original_samples", before)
    return counted.select(
        "original_samples",
        "final_samples",
        (F.col("original_samples") - F.col("final_samples")).alias("removed_samples"),
        "avg_tokens", "min_tokens", "max_tokens",
    )


def preprocess_and_save(
    df: DataFrame, text: str, order_by: str, base: str, run_id: str,
    config: PreprocessConfig = PreprocessConfig(),
) -> dict:
    """Write the processed dataset; its figures are taken while writing, not in a second pass.

    They are observed in the last stage only, where a task's counts enter once
    even if earlier stages are run again. The input is counted by itself, which
    reads no column.
    """
    written = Observation("written")
    before = df.count()
    tokens = F.col("token_count").cast("bigint")
    processed = preprocess(df, text, order_by, config).observe(
        written,
        F.count(F.lit(1)).alias("rows"),
        F.round(F.avg(tokens), 2).alias("avg_tokens"),
        F.min(tokens).alias("min_tokens"),
        F.max(tokens).alias("max_tokens"),
    )
    path = save_jsonl(processed, base, run_id)
    after = written.get
    return {
        "processed_dataset_path": path,
        "num_samples": after["rows"],
        "avg_tokens": after["avg_tokens"] or 0.0,
        "processing_stats": {
            "original_samples": before,
            "final_samples": after["rows"],
            "removed_samples": before - after["rows"],
            "avg_tokens": after["avg_tokens"] or 0.0,
            "min_tokens": after["min_tokens"] or 0,
            "max_tokens": after["max_tokens"] or 0,
        },
    }


def ingest_and_profile(spark: SparkSession, path: str, run_id: str, **options) -> DataFrame:
    return profile(load(spark, path, **options), run_id)


def validate(df: DataFrame, text: str) -> DataFrame:
    return validation_report(df, text)


def evaluate_and_compare(
    pairs: DataFrame, base: str, tuned: str, stemming: bool = True,
    loss: str | None = None, tokens: str | None = None,
) -> DataFrame:
    """Scores of two models over (model, prediction, reference), and their comparison."""
    metrics = compute_all(pairs, by=["model"], stemming=stemming, loss=loss, tokens=tokens)
    return compare_models(metrics, base, tuned)
