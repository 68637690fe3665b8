"""Queries over profiling and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import profile as P
from corpusloom.operators import validate as V
from corpusloom.plans.preparation import ingest_and_profile, validate
from corpusloom.plans.registry import query, rounded, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their quality label, missing where nobody labelled them."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return documents(spark, sf_dir).join(labels, "doc_id", "left")


_LABELLED = "(SELECT d.*, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))"


@query(
    """
    SELECT count(*) AS rows, CAST(5 AS BIGINT) AS columns,
           'doc_id,text,lang,source,n_chars' AS column_names FROM documents
    """
)
def table_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table_size(documents(spark, sf_dir))


def _union(template: str, names: list[str]) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in names)


_DOC = ["doc_id", "text", "lang", "source", "n_chars"]


@query(
    _union(
        f"SELECT '{{c}}' AS \"column\", count(*) - count({{c}}) AS missing FROM {_LABELLED}",
        [*_DOC, "quality"],
    )
)
def missing_per_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.missing_per_column(labelled(spark, sf_dir), [*_DOC, "quality"])


@query(
    _union(
        f"SELECT '{{c}}' AS \"column\", count(DISTINCT {{c}}) AS distinct_values FROM {_LABELLED}",
        [*_DOC, "quality"],
    )
)
def distinct_per_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.distinct_per_column(labelled(spark, sf_dir), [*_DOC, "quality"])


@query(
    _union(
        f"SELECT '{{c}}' AS \"column\", count(DISTINCT {{c}}) AS distinct_values, true AS estimate_is_near FROM {_LABELLED}",
        [*_DOC, "quality"],
    )
)
def distinct_from_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches per source, united, beside the exact counts; an estimate may be off by 5 % (three standard errors)."""
    rows, columns = labelled(spark, sf_dir), [*_DOC, "quality"]
    estimates = P.united_distinct(P.distinct_sketches(rows, columns, by=["source"])).withColumnRenamed("distinct_values", "estimate")
    near = F.abs(F.col("estimate") - F.col("distinct_values")) <= F.greatest(0.05 * F.col("distinct_values"), F.lit(1))
    return P.distinct_per_column(rows, columns).join(estimates, "column").select("column", "distinct_values", near.alias("estimate_is_near"))


@query(
    "SELECT * FROM ("
    + _union(
        "SELECT '{c}' AS \"column\", round(avg(length({c})), 6) AS avg_length FROM documents",
        ["text", "lang", "source"],
    )
    + ") WHERE avg_length > 10"
)
def detect_text_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.detect_text_columns(documents(spark, sf_dir))
    return found.select("column", rounded("avg_length"))


@query(
    "SELECT arg_max(\"column\", avg_length) AS text_column FROM ("
    + _union(
        "SELECT '{c}' AS \"column\", avg(length({c})) AS avg_length FROM pages",
        ["url", "html"],
    )
    + ") WHERE avg_length > 10"
)
def primary_text_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.primary_text_column(table(spark, sf_dir, "pages"))


@query(
    """
    SELECT round(avg(length(text)), 6) AS avg_length, min(length(text)) AS min_length,
           max(length(text)) AS max_length FROM documents
    """
)
def text_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = P.text_length_stats(documents(spark, sf_dir), "text")
    return stats.select(rounded("avg_length"), "min_length", "max_length")


_TOKENS = "CAST(sum(ceil(octet_length(encode(text)) / 4.0)) AS BIGINT)"


@query(
    f"""
    SELECT source, count(*) AS rows, CAST(4 AS BIGINT) AS columns, 'text' AS text_columns,
           'text' AS text_column, round(avg(length(text)), 6) AS avg_text_length,
           {_TOKENS} AS token_count_estimate, false AS has_missing,
           round((count(*) - count(DISTINCT text)) / count(*), 6) AS duplicate_ratio
    FROM documents GROUP BY source
    """
)
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source is a dataset of its own."""
    stats = P.dataset_stats(documents(spark, sf_dir), by=["source"])
    return stats.select(
        "source", "rows", "columns", "text_columns", "text_column", rounded("avg_text_length"),
        "token_count_estimate", "has_missing", rounded("duplicate_ratio"),
    )


@query(f"SELECT {_TOKENS} AS token_count_estimate FROM documents")
def token_count_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusloom.functions.text import estimated_tokens

    return documents(spark, sf_dir).agg(
        F.sum(estimated_tokens(F.col("text"))).alias("token_count_estimate")
    )


def _sql_cells(names: list[str]) -> list[str]:
    return [f"length(CAST({c} AS VARCHAR))" for c in names]


@query(f"SELECT round(avg({' + '.join(_sql_cells(_DOC))}), 6) AS avg_text_length FROM documents")
def avg_row_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.avg_row_length(documents(spark, sf_dir)).select(rounded("avg_text_length"))


@query(
    "SELECT round(("
    + " + ".join(f"avg({c})" for c in _sql_cells(_DOC))
    + ") / 5, 6) AS avg_text_length FROM documents"
)
def avg_of_column_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.avg_of_column_means(documents(spark, sf_dir)).select(rounded("avg_text_length"))


@query(
    f"""
    SELECT count(DISTINCT coalesce(CAST(quality AS VARCHAR), '')) AS with_missing,
           count(DISTINCT quality) AS without_missing FROM {_LABELLED}
    """
)
def class_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.class_count(labelled(spark, sf_dir), "quality")


@query(f"SELECT CAST(quality AS VARCHAR) AS class, count(*) AS n FROM {_LABELLED} GROUP BY quality")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = labelled(spark, sf_dir).withColumn("quality", F.col("quality").cast("string"))
    return P.label_distribution(labels, "quality")


@query(
    _union(
        "SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS missing, "
        "count(DISTINCT {c}) AS distinct_values, "
        "CAST(count(*) - count(DISTINCT {c}) AS BIGINT) AS duplicates, "
        "round(avg(length(CAST({c} AS VARCHAR))), 6) AS avg_length, "
        "min(length(CAST({c} AS VARCHAR))) AS min_length, "
        "max(length(CAST({c} AS VARCHAR))) AS max_length FROM documents",
        _DOC,
    )
)
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.column_profile(documents(spark, sf_dir)).select(
        "column", "rows", "missing", "distinct_values", "duplicates", rounded("avg_length"),
        "min_length", "max_length",
    )


@query(
    """
    SELECT 'ds_a1b2c3d4' AS dataset_id, count(*) AS rows, 'doc_id,text,lang,source,n_chars' AS columns,
           'text' AS text_column, 'text' AS text_columns,
           'doc_id=bigint,lang=string,n_chars=bigint,source=string,text=string' AS dtypes,
           count(*) - count(text) AS missing_text, count(DISTINCT text) AS unique_text,
           count(DISTINCT lang) AS unique_lang, round(avg(length(text)), 6) AS avg_length,
           max(length(text)) AS max_length
    FROM documents
    """
)
def ingest_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load and profile in one job, flattened for comparison."""
    row = ingest_and_profile(spark, f"{sf_dir}/documents.parquet", "a1b2c3d4e5")
    dtypes = F.array_sort(
        F.transform(F.map_entries("stats.dtypes"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    )
    return row.select(
        "dataset_id", "rows", F.array_join("columns", ",").alias("columns"), "text_column",
        F.array_join("text_columns", ",").alias("text_columns"),
        F.array_join(dtypes, ",").alias("dtypes"),
        F.col("stats.missing_values")["text"].alias("missing_text"),
        F.col("stats.unique_values")["text"].alias("unique_text"),
        F.col("stats.unique_values")["lang"].alias("unique_lang"),
        F.round("stats.text_stats.avg_length", 6).alias("avg_length"),
        F.col("stats.text_stats.max_length").alias("max_length"),
    )


@query(
    f"""
    SELECT count(*) > count(quality) AS has_missing, count(*) - count(quality) AS missing_count,
           round((count(*) - count(quality)) * 100.0 / count(*), 6) AS missing_percentage
    FROM {_LABELLED}
    """
)
def check_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = V.check_missing(labelled(spark, sf_dir), "quality")
    return checked.select("has_missing", "missing_count", rounded("missing_percentage"))


@query(
    """
    SELECT count(*) > count(DISTINCT text) AS has_duplicates,
           count(*) - count(DISTINCT text) AS duplicate_count,
           round((count(*) - count(DISTINCT text)) * 100.0 / count(*), 6) AS duplicate_percentage
    FROM documents
    """
)
def check_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = V.check_duplicates(documents(spark, sf_dir), "text")
    return checked.select("has_duplicates", "duplicate_count", rounded("duplicate_percentage"))


# All texts, and a missing one for every label.
_GAPPED = "(SELECT text FROM documents UNION ALL SELECT CAST(NULL AS VARCHAR) FROM labels)"


def _gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = table(spark, sf_dir, "labels").select(F.lit(None).cast("string").alias("text"))
    return documents(spark, sf_dir).select("text").unionByName(missing)


@query(
    f"""
    SELECT count(*) AS total_rows, count(DISTINCT text) AS unique_rows,
           count(*) - count(DISTINCT text) AS duplicate_count,
           round((count(*) - count(DISTINCT text)) * 100.0 / count(*), 6) AS duplicate_percentage
    FROM {_GAPPED}
    """
)
def duplicate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = V.duplicate_stats(_gapped(spark, sf_dir), "text")
    return stats.select("total_rows", "unique_rows", "duplicate_count", rounded("duplicate_percentage"))


# Kinds of personal data in SQL, over text where a missing one reads as 'nan'.
_SQL_EMAIL = r"regexp_matches(t, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b')"
_SQL_PHONE = r"regexp_matches(t, '\b\d{3}[-.]?\d{3}[-.]?\d{4}\b')"
_SQL_SSN = r"regexp_matches(t, '\b\d{3}-\d{2}-\d{4}\b')"
_SQL_ISSUE = r"regexp_matches(t, '[\x00-\x08\x0B\x0C\x0E-\x1F]')"


def _filled(source: str) -> str:
    return f"(SELECT text, coalesce(text, 'nan') AS t FROM {source})"


@query(
    f"""
    SELECT * FROM (
      SELECT 'email' AS pii_type, count(*) FILTER ({_SQL_EMAIL}) AS rows FROM {_filled('documents')}
      UNION ALL SELECT 'phone', count(*) FILTER ({_SQL_PHONE}) FROM {_filled('documents')}
      UNION ALL SELECT 'ssn', count(*) FILTER ({_SQL_SSN}) FROM {_filled('documents')}
    ) WHERE rows > 0
    """
)
def check_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.check_pii(documents(spark, sf_dir), "text").select("pii_type", "rows")


@query(
    f"""
    SELECT * FROM (
      SELECT 'email' AS pii_type, count(*) FILTER ({_SQL_EMAIL}) AS rows FROM {_filled("(SELECT html AS text FROM pages)")}
      UNION ALL SELECT 'phone', count(*) FILTER ({_SQL_PHONE}) FROM {_filled("(SELECT html AS text FROM pages)")}
      UNION ALL SELECT 'ssn', count(*) FILTER ({_SQL_SSN}) FROM {_filled("(SELECT html AS text FROM pages)")}
    ) WHERE rows > 0
    """
)
def check_pii_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.check_pii(table(spark, sf_dir, "pages"), "html").select("pii_type", "rows")


@query(f"SELECT count(*) FILTER (length(t) < 5) AS too_short_count FROM {_filled(_GAPPED)}")
def too_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.text_quality(_gapped(spark, sf_dir), "text").select("too_short_count")


@query(f"SELECT count(*) FILTER ({_SQL_ISSUE}) AS encoding_issues_count FROM {_filled('documents')}")
def encoding_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.text_quality(documents(spark, sf_dir), "text").select("encoding_issues_count")


@query(
    f"""
    SELECT count(*) FILTER (length(t) < 5) + count(*) FILTER ({_SQL_ISSUE}) AS low_quality_count,
           count(*) FILTER (length(t) < 5) AS too_short_count,
           count(*) FILTER ({_SQL_ISSUE}) AS encoding_issues_count
    FROM {_filled(_GAPPED)}
    """
)
def low_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.text_quality(_gapped(spark, sf_dir), "text")


def _sql_report(source: str, by: str) -> str:
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
    WITH c AS (
      SELECT {lead}count(*) AS n, count(*) - count(text) AS missing,
             count(*) - count(DISTINCT text)
               - CASE WHEN count(text) < count(*) THEN 1 ELSE 0 END AS dup,
             count(*) FILTER (length(t) < 5) + count(*) FILTER ({_SQL_ISSUE}) AS low,
             count(*) FILTER ({_SQL_EMAIL}) AS email, count(*) FILTER ({_SQL_PHONE}) AS phone,
             count(*) FILTER ({_SQL_SSN}) AS ssn
      FROM (SELECT *, coalesce(text, 'nan') AS t FROM {source}) {group}),
    p AS (SELECT *, concat_ws(', ', CASE WHEN email > 0 THEN 'email' END,
                 CASE WHEN phone > 0 THEN 'phone' END, CASE WHEN ssn > 0 THEN 'ssn' END) AS kinds FROM c)
    SELECT {lead}true AS valid,
           concat_ws(' | ',
             CASE WHEN missing > 0 THEN missing || ' missing values in text column' END,
             CASE WHEN dup > 0 THEN dup || ' duplicate rows found' END,
             CASE WHEN kinds <> '' THEN 'PII detected: ' || kinds END,
             CASE WHEN low > 0 THEN low || ' rows with low quality text' END) AS warnings,
           kinds <> '' AS pii_detected, missing AS missing_count, dup AS duplicate_count,
           round(dup * 100.0 / n, 6) AS duplicate_percentage, low AS low_quality_count
    FROM p
    """


def _flat_report(report: DataFrame, by: list[str]) -> DataFrame:
    r = "validation_report"
    return report.select(
        *by, "valid", F.array_join("warnings", " | ").alias("warnings"), "pii_detected",
        F.col(f"{r}.missing_values.missing_count").alias("missing_count"),
        F.col(f"{r}.duplicates.duplicate_count").alias("duplicate_count"),
        F.round(f"{r}.duplicates.duplicate_percentage", 6).alias("duplicate_percentage"),
        F.col(f"{r}.text_quality.low_quality_count").alias("low_quality_count"),
    )


@query(_sql_report(_GAPPED, ""))
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_report(validate(_gapped(spark, sf_dir), "text"), [])


@query(_sql_report("documents", "source"))
def validation_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_report(V.validation_report(documents(spark, sf_dir), "text", ["source"]), ["source"])


@query(
    """
    WITH c AS (SELECT event_type AS language, CAST(json_extract(props, '$.k') AS INTEGER) AS epochs,
                      value / 1000000 AS learning_rate, event_type AS project_name FROM events)
    SELECT 'project_name' AS field, count(*) AS checked,
           count(*) FILTER (length(project_name) NOT BETWEEN 1 AND 100) AS violations FROM c
    UNION ALL SELECT 'language', count(*), count(*) FILTER (language NOT IN ('en', 'es', 'fr', 'de', 'multi')) FROM c
    UNION ALL SELECT 'epochs', count(*), count(*) FILTER (epochs NOT BETWEEN 1 AND 10) FROM c
    UNION ALL SELECT 'learning_rate', count(*), count(*) FILTER (learning_rate NOT BETWEEN 1e-5 AND 5e-4) FROM c
    """
)
def field_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as settings; each bounded field is checked over all rows."""
    settings = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("project_name"),
        F.col("event_type").alias("language"),
        F.get_json_object("props", "$.k").cast("int").alias("epochs"),
        (F.col("value") / 1000000).alias("learning_rate"),
    )
    return V.constraint_violations(settings)
