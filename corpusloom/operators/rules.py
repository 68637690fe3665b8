"""Task and configuration rules over a table of datasets, one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_SCALE = 100
RANKS = (8, 16, 32, 64)


def detect_task(df: DataFrame, columns: str = "columns") -> DataFrame:
    """Add task_type, confidence, target_column and reasoning from the column names."""
    names = F.col(columns)
    lowered = F.transform(names, F.lower)

    def has(*wanted: str) -> Column:
        return F.arrays_overlap(lowered, F.array(*[F.lit(w) for w in wanted]))

    def first(test) -> Column:
        return F.get(F.filter(names, test), F.lit(0))

    def named(*wanted: str) -> Column:
        return first(lambda c: F.lower(c).isin(*wanted))

    def containing(part: str) -> Column:
        return first(lambda c: F.contains(F.lower(c), F.lit(part)))

    last = F.coalesce(F.get(names, F.size(names) - 1), F.lit("text"))
    # Column names, task names, confidences and reasons, in the order of the rules.
    rules = [
        (has("label", "class", "category"), "classification", 0.7,
         named("label", "class", "category"), "Dataset has label/class column"),
        (has("question") & has("answer"), "qa", 0.8,
         containing("answer"), "Dataset has question-answer structure"),
        (has("instruction", "prompt") & has("response", "output"), "chat", 0.8,
         named("response", "output"), "Dataset has instruction-response format"),
        (has("summary"), "summarization", 0.75,
         containing("summary"), "Dataset has summary column"),
        (F.lit(True), "generation", 0.5,
         last, "No clear task indicators, assuming text generation"),
    ]
    verdict = F.coalesce(
        *[
            F.when(
                rule,
                F.struct(
                    F.lit(task).alias("task_type"),
                    F.lit(confidence).alias("confidence"),
                    target.alias("target_column"),
                    F.lit(why).alias("reasoning"),
                ),
            )
            for rule, task, confidence, target, why in rules
        ]
    )
    return df.withColumn("__verdict", verdict).select(*df.columns, "__verdict.*")


def rows_from_sample(sampled: Column) -> Column:
    """Row estimate where only a sample of the dataset is known."""
    return sampled * SAMPLE_SCALE


def snap_rank(rank: Column) -> Column:
    """Nearest allowed rank, the smaller one on a tie."""
    nearest = F.array_min(
        F.array(*[F.struct(F.abs(rank - r).alias("far"), F.lit(r).alias("rank")) for r in RANKS])
    )
    return nearest["rank"]


def suggest_config(
    df: DataFrame, rows: str = "rows", avg_length: str = "avg_text_length", gpus: str = "gpu_count"
) -> DataFrame:
    """Add the suggested training settings from size, text length and devices."""
    n, long_text = F.col(rows), F.col(avg_length) > 500
    on_gpu = F.col(gpus) > 0
    small, medium = n < 1000, n < 10000

    def by_size(a, b, c) -> Column:
        return F.when(small, F.lit(a)).when(medium, F.lit(b)).otherwise(F.lit(c))

    rank = by_size(8, 16, 32)
    batch = F.when(on_gpu, F.when(n > 5000, 8).otherwise(4)).otherwise(2)

    def halved(value: Column, least: int) -> Column:
        return F.when(long_text, F.greatest(F.lit(least), F.floor(value / 2).cast("int"))).otherwise(value)

    return df.withColumns(
        {
            "batch_size": halved(batch, 2),
            "epochs": by_size(5, 3, 2),
            "lora_rank": halved(rank, 8),
            "lora_alpha": by_size(16, 32, 64),
            "learning_rate": by_size(1e-4, 2e-4, 2e-4),
            "precision": F.when(on_gpu, F.lit("fp16")).otherwise(F.lit("fp32")),
        }
    )


def apply_preset(df: DataFrame, mode: str = "training_mode", gpus: str = "gpu_count") -> DataFrame:
    """Adjust suggested settings to the mode (fast, balanced, anything else: high quality)."""
    fast, balanced = F.col(mode) == "fast", F.col(mode) == "balanced"

    def choose(if_fast: Column, if_balanced: Column, otherwise: Column) -> Column:
        return F.when(fast, if_fast).when(balanced, if_balanced).otherwise(otherwise)

    batch, rank, rate = F.col("batch_size"), F.col("lora_rank"), F.col("learning_rate")
    tuned = df.withColumns(
        {
            "epochs": choose(F.lit(1), F.lit(3), F.lit(5)),
            "batch_size": choose(F.greatest(batch, F.lit(4)), batch, batch),
            "learning_rate": choose(rate, rate, rate * 0.5),
            "lora_rank": choose(F.least(F.lit(8), rank), rank, F.least(F.lit(32), rank * 2)),
        }
    )
    on_cpu = F.col(gpus) == 0
    accumulate = (
        F.when(on_cpu, F.lit(4))
        .when(batch < 8, F.floor(F.lit(8) / batch).cast("int"))
        .otherwise(F.lit(1))
    )
    return tuned.withColumn("gradient_accumulation", accumulate)
