"""Comparing two models by their metrics or by their responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOWER_IS_BETTER = "perplexity"


def compare_models(metrics: DataFrame, base: str, tuned: str) -> DataFrame:
    """(metric, base_value, tuned_value, absolute, relative_percent) from (model, metric, value).

    Metrics that only one of the models has are left out. One grouping instead
    of a self-join.
    """

    def of(model: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col("value")))

    sides = (
        metrics.where(F.col("model").isin(base, tuned))
        .groupBy("metric")
        .agg(of(base).alias("base_value"), of(tuned).alias("tuned_value"))
        .where(F.col("base_value").isNotNull() & F.col("tuned_value").isNotNull())
    )
    change = F.col("tuned_value") - F.col("base_value")
    gain = F.when(F.col("metric") == LOWER_IS_BETTER, -change).otherwise(change)
    relative = F.when(F.col("base_value") > 0, gain / F.col("base_value") * 100).otherwise(F.lit(0.0))
    return sides.select(
        "metric", "base_value", "tuned_value",
        change.alias("absolute"), relative.alias("relative_percent"),
    )


def _report_cells() -> list[Column]:
    gain = F.format_string("%.2f%%", F.col("relative_percent"))
    return [
        F.col("metric"),
        F.format_string("%.4f", F.col("base_value")).alias("base_model"),
        F.format_string("%.4f", F.col("tuned_value")).alias("tuned_model"),
        F.when(F.col("relative_percent") > 0, F.concat(F.lit("+"), gain)).otherwise(gain).alias("improvement"),
    ]


def comparison_table(comparison: DataFrame) -> DataFrame:
    """The report's table: four decimals and a signed percentage, sorted by metric."""
    return comparison.select(*_report_cells()).orderBy("metric")


def _summary_sums() -> list[Column]:
    best = F.struct(-F.col("relative_percent"), F.col("metric"))
    return [
        F.count_if(F.col("relative_percent") > 0).alias("improved"),
        F.count(F.lit(1)).alias("total"),
        F.min_by("metric", best).alias("best_metric"),
        F.max("relative_percent").alias("best_percent"),
    ]


def comparison_summary(comparison: DataFrame) -> DataFrame:
    """Improved and total metrics, and the best one (first by name on a tie)."""
    return comparison.agg(*_summary_sums())


def comparison_report(comparison: DataFrame) -> DataFrame:
    """The Markdown report as one row (bounded: one line per metric name)."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *_report_cells()), F.lit(" |\n"))
    lines = F.array_sort(F.collect_list(F.struct("metric", line.alias("line"))))
    one = comparison.agg(lines.alias("rows"), *_summary_sums())
    head = (
        "# Model Comparison Report\n\n## Metrics Comparison\n\n"
        "| Metric | Base Model | Fine-tuned Model | Improvement |\n"
        "|--------|------------|------------------|-------------|\n"
    )
    counted = F.format_string("\n## Summary\n\n- **Metrics improved**: %d/%d\n", "improved", "total")
    best = F.when(
        F.col("total") > 0, F.format_string("- **Best improvement**: %s (%.2f%%)\n", "best_metric", "best_percent")
    ).otherwise(F.lit(""))
    body = F.array_join(F.transform("rows", lambda r: r["line"]), "")
    return one.select(F.concat(F.lit(head), body, counted, best).alias("report"))


def paired_response_delta(responses: DataFrame, base: str, tuned: str, id_col: str) -> DataFrame:
    """Per prompt: tuned minus base for tokens and latency.

    ``responses`` has (id, model, tokens, latency_ms), one row per prompt and model.
    """

    def of(model: str, value: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(value)))

    paired = (
        responses.where(F.col("model").isin(base, tuned))
        .groupBy(id_col)
        .agg(
            of(base, "tokens").alias("base_tokens"),
            of(tuned, "tokens").alias("tuned_tokens"),
            of(base, "latency_ms").alias("base_latency_ms"),
            of(tuned, "latency_ms").alias("tuned_latency_ms"),
        )
        .where("base_tokens IS NOT NULL AND tuned_tokens IS NOT NULL")
    )
    return paired.select(
        id_col,
        (F.col("tuned_tokens") - F.col("base_tokens")).alias("token_delta"),
        (F.col("tuned_latency_ms") - F.col("base_latency_ms")).alias("latency_delta_ms"),
    )


def delta_summary(deltas: DataFrame) -> DataFrame:
    return deltas.agg(
        F.count(F.lit(1)).alias("prompts"),
        F.avg("token_delta").alias("avg_token_delta"),
        F.avg("latency_delta_ms").alias("avg_latency_delta_ms"),
        F.count_if(F.col("latency_delta_ms") < 0).alias("faster"),
    )
