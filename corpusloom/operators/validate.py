"""Dataset checks: missing values, duplicates, personal data, text quality.

Row predicates are evaluated once per row in the scan and summed per distinct
text before anything is shuffled; a row of the shuffle is a 16-byte text digest
and a few counters, never the text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import PII_PREDICATES, has_encoding_issue, text_digest
from corpusloom.operators.profile import as_text

MIN_TEXT_LENGTH = 5


def _percent(part: Column, whole: Column) -> Column:
    """Share in percent; 0 for an empty table."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def check_missing(df: DataFrame, text: str) -> DataFrame:
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(text).isNull()).alias("missing_count")
    )
    return counts.select(
        (F.col("missing_count") > 0).alias("has_missing"),
        "missing_count",
        _percent(F.col("missing_count"), F.col("rows")).alias("missing_percentage"),
    )


def _per_text(df: DataFrame, text: str) -> DataFrame:
    return df.groupBy(text_digest(F.col(text)).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def check_duplicates(df: DataFrame, text: str) -> DataFrame:
    """Rows after the first of their text; missing texts equal each other."""
    counts = _per_text(df, text).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_count"),
    )
    return counts.select(
        (F.col("duplicate_count") > 0).alias("has_duplicates"),
        "duplicate_count",
        _percent(F.col("duplicate_count"), F.col("rows")).alias("duplicate_percentage"),
    )


def duplicate_stats(df: DataFrame, text: str) -> DataFrame:
    """Total against distinct texts; here every missing text counts as a duplicate."""
    counts = _per_text(df, text).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), F.count("key").alias("unique_rows")
    )
    duplicates = F.col("total_rows") - F.col("unique_rows")
    return counts.select(
        "total_rows",
        "unique_rows",
        duplicates.alias("duplicate_count"),
        _percent(duplicates, F.col("total_rows")).alias("duplicate_percentage"),
    )


def check_pii(
    df: DataFrame, text: str, sample_rows: int | None = None, order_by: str | None = None
) -> DataFrame:
    """(position, pii_type, rows) for each kind of personal data that occurs.

    Looks at every row. ``sample_rows`` looks at the first rows by ``order_by``
    only, as the quick check of an upload does.
    """
    source = df
    if sample_rows is not None:
        if order_by is None:
            raise ValueError("a sample of the first rows needs order_by")
        source = df.orderBy(order_by).limit(sample_rows)
    value = as_text(df, text)
    counts = source.agg(
        *[F.count_if(found(value)).alias(kind) for kind, found in PII_PREDICATES.items()]
    )
    long = counts.unpivot([], list(PII_PREDICATES), "pii_type", "rows").where("rows > 0")
    order = F.array_position(F.array(*[F.lit(k) for k in PII_PREDICATES]), F.col("pii_type"))
    return long.select(order.alias("position"), "pii_type", "rows")


def _is_short(value: Column) -> Column:
    return F.length(value) < MIN_TEXT_LENGTH


def text_quality(df: DataFrame, text: str) -> DataFrame:
    """Short texts, texts with control characters, and their sum."""
    value = as_text(df, text)
    counts = df.agg(
        F.count_if(_is_short(value)).alias("too_short_count"),
        F.count_if(has_encoding_issue(value)).alias("encoding_issues_count"),
    )
    return counts.select(
        (F.col("too_short_count") + F.col("encoding_issues_count")).alias("low_quality_count"),
        "too_short_count",
        "encoding_issues_count",
    )


def validation_counts(df: DataFrame, text: str, by: Sequence[str] = ()) -> DataFrame:
    """Every counter of the report, one row per dataset, from one scan and one shuffle."""
    by = list(by)
    value = as_text(df, text)
    flags = {
        "short": _is_short(value),
        "encoding": has_encoding_issue(value),
        **{kind: found(value) for kind, found in PII_PREDICATES.items()},
    }
    facts = df.select(
        *by,
        text_digest(F.col(text)).alias("key"),
        *[flag.cast("int").alias(name) for name, flag in flags.items()],
    )
    per_text = facts.groupBy(*by, "key").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(name).alias(name) for name in flags]
    )

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0))

    return per_text.groupBy(*by).agg(
        total(F.col("n")).alias("rows"),
        total(F.when(F.col("key").isNull(), F.col("n"))).alias("missing_count"),
        total(F.col("n") - 1).alias("duplicate_count"),
        total(F.col("short")).alias("too_short_count"),
        total(F.col("encoding")).alias("encoding_issues_count"),
        *[total(F.col(kind)).alias(f"{kind}_rows") for kind in PII_PREDICATES],
    )


def validation_report(df: DataFrame, text: str, by: Sequence[str] = ()) -> DataFrame:
    """valid, warnings, errors, pii_detected and the nested report, one row per dataset."""
    by = list(by)
    rows, missing = F.col("rows"), F.col("missing_count")
    duplicates = F.col("duplicate_count")
    low = F.col("too_short_count") + F.col("encoding_issues_count")

    def present(entries: list[Column]) -> Column:
        return F.array_compact(F.array(*entries))

    pii_types = present(
        [F.when(F.col(f"{kind}_rows") > 0, F.lit(kind)) for kind in PII_PREDICATES]
    )
    pii_counts = F.map_from_entries(
        present(
            [
                F.when(
                    F.col(f"{kind}_rows") > 0,
                    F.struct(F.lit(kind).alias("key"), F.col(f"{kind}_rows").alias("value")),
                )
                for kind in PII_PREDICATES
            ]
        )
    )
    found = F.size(pii_types) > 0
    # The wording of the warnings.
    warnings = present(
        [
            F.when(missing > 0, F.concat(missing.cast("string"), F.lit(" missing values in text column"))),
            F.when(duplicates > 0, F.concat(duplicates.cast("string"), F.lit(" duplicate rows found"))),
            F.when(found, F.concat(F.lit("PII detected: "), F.array_join(pii_types, ", "))),
            F.when(low > 0, F.concat(low.cast("string"), F.lit(" rows with low quality text"))),
        ]
    )
    report = F.struct(
        F.struct(
            (missing > 0).alias("has_missing"),
            missing.alias("missing_count"),
            _percent(missing, rows).alias("missing_percentage"),
        ).alias("missing_values"),
        F.struct(
            (duplicates > 0).alias("has_duplicates"),
            duplicates.alias("duplicate_count"),
            _percent(duplicates, rows).alias("duplicate_percentage"),
        ).alias("duplicates"),
        F.struct(
            found.alias("pii_found"), pii_types.alias("pii_types"), pii_counts.alias("pii_counts")
        ).alias("pii"),
        F.struct(
            low.alias("low_quality_count"),
            F.col("too_short_count"),
            F.col("encoding_issues_count"),
        ).alias("text_quality"),
    )
    errors = F.array().cast("array<string>")
    return validation_counts(df, text, by).select(
        *by,
        (F.size(errors) == 0).alias("valid"),
        warnings.alias("warnings"),
        errors.alias("errors"),
        found.alias("pii_detected"),
        report.alias("validation_report"),
    )


@dataclass(frozen=True)
class Between:
    low: float
    high: float

    def holds(self, value: Column) -> Column:
        return value.between(self.low, self.high)


@dataclass(frozen=True)
class OneOf:
    allowed: tuple

    def holds(self, value: Column) -> Column:
        return value.isin(*self.allowed)


@dataclass(frozen=True)
class LengthBetween:
    low: int
    high: int

    def holds(self, value: Column) -> Column:
        return F.length(value).between(self.low, self.high)


# The bounds of the request fields.
FIELD_BOUNDS: Mapping[str, Between | OneOf | LengthBetween] = {
    "project_name": LengthBetween(1, 100),
    "description": LengthBetween(0, 500),
    "dataset_name": LengthBetween(1, 100),
    "split_ratio": Between(0.5, 0.95),
    "task_type": OneOf(("classification", "regression", "chat", "summarization", "qa", "extraction")),
    "output_type": OneOf(("label", "text", "json", "multi-label")),
    "domain": OneOf(("general", "finance", "medical", "legal", "code", "custom")),
    "language": OneOf(("en", "es", "fr", "de", "multi")),
    "training_mode": OneOf(("fast", "balanced", "high_quality")),
    "epochs": Between(1, 10),
    "batch_size": Between(1, 16),
    "learning_rate": Between(1e-5, 5e-4),
    "max_seq_len": Between(512, 4096),
    "lora_rank": Between(8, 64),
    "gradient_accumulation": Between(1, 8),
    "precision": OneOf(("fp16", "bf16", "float32")),
}


def constraint_violations(
    df: DataFrame, rules: Mapping[str, Between | OneOf | LengthBetween] | None = None
) -> DataFrame:
    """(field, checked, violations) for the bounded fields ``df`` has; null is not checked."""
    rules = rules or {k: v for k, v in FIELD_BOUNDS.items() if k in df.columns}
    checks = [
        F.struct(
            F.lit(field).alias("field"),
            F.count(field).alias("checked"),
            F.count_if(~rule.holds(F.col(field))).alias("violations"),
        ).alias(field)
        for field, rule in rules.items()
    ]
    return df.agg(*checks).select(F.inline(F.array(*[F.col(f) for f in rules])))
