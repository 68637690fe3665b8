"""Queries over masking, flags, splits, balance, filters, whole conversations and stopping rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.templates import register_template
from corpusloom.operators import events as E
from corpusloom.operators import redact as R
from corpusloom.operators import sampling as S
from corpusloom.operators.template import apply_template, conversation_to_chatml
from corpusloom.plans.event_queries import _LOG, SLICES, log, replayed, time_slices
from corpusloom.plans.preparation import run_stages
from corpusloom.plans.registry import query, rounded, table
from corpusloom.sources.readers import load
from corpusloom.streaming import logs as L

# The patterns of the masking operator, as the SQL engine writes them.
_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
_PHONE = r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"
_SSN = r"\b\d{3}-\d{2}-\d{4}\b"


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(*columns) if columns else docs


_CARDS = r"""list_filter(regexp_extract_all(text, '\b\d(?:[ -]?\d){12,18}\b'), lambda x: list_sum(list_transform(
      range(0, length(regexp_replace(x, '[^0-9]', '', 'g'))), lambda k:
      CASE WHEN k % 2 = 1
           THEN CAST(substr(reverse(regexp_replace(x, '[^0-9]', '', 'g')), CAST(k AS INT) + 1, 1) AS INT) * 2
                - CASE WHEN substr(reverse(regexp_replace(x, '[^0-9]', '', 'g')), CAST(k AS INT) + 1, 1) > '4' THEN 9 ELSE 0 END
           ELSE CAST(substr(reverse(regexp_replace(x, '[^0-9]', '', 'g')), CAST(k AS INT) + 1, 1) AS INT) END)) % 10 = 0)"""


@query(
    rf"""
    WITH c AS (SELECT doc_id, list_reduce(list_concat([text], {_CARDS}), lambda t, card: replace(t, card, '[CARD]')) AS text
               FROM documents)
    SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{_EMAIL}', '[EMAIL]', 'g'),
           '{_SSN}', '[SSN]', 'g'), '{_PHONE}', '[PHONE]', 'g') AS text
    FROM c
    """
)
def pii_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pii_redact(_documents(spark, sf_dir, "doc_id", "text"), "text")


@query(f"SELECT * FROM (SELECT doc_id, array_to_string({_CARDS}, ',') AS cards FROM documents) WHERE cards <> ''")
def pii_credit_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = F.array_join(R.card_numbers(F.col("text")), ",")
    return _documents(spark, sf_dir, "doc_id", "text").select("doc_id", cards.alias("cards")).where("cards <> ''")


@query(
    r"""
    WITH t AS (SELECT doc_id, text FROM documents UNION ALL SELECT -doc_id - 1, CASE WHEN toxic = 1 THEN 'bad' END FROM labels)
    SELECT doc_id, length(coalesce(text, 'nan')) < 5 AS too_short,
           regexp_matches(coalesce(text, 'nan'), '[\x00-\x08\x0B\x0C\x0E-\x1F]') AS encoding_issue,
           length(coalesce(text, 'nan')) < 5 OR regexp_matches(coalesce(text, 'nan'), '[\x00-\x08\x0B\x0C\x0E-\x1F]') AS low_quality
    FROM t
    """
)
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, and short or missing texts for the labels."""
    extra = table(spark, sf_dir, "labels").select(
        (-F.col("doc_id") - 1).alias("doc_id"), F.when(F.col("toxic") == 1, "bad").alias("text")
    )
    rows = _documents(spark, sf_dir, "doc_id", "text").unionByName(extra)
    return R.quality_flags(rows, "text").drop("text")


_BUCKET = "CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 10000"


@query(
    f"""
    SELECT doc_id, CASE WHEN {_BUCKET} < 8000 THEN 'train' WHEN {_BUCKET} < 9500 THEN 'test' ELSE 'validation' END AS split
    FROM documents
    """
)
def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split(_documents(spark, sf_dir, "doc_id"), "doc_id")


@query(
    """
    SELECT quality, count(*) AS n, round((SELECT count(*) FROM labels) * 1.0
           / ((SELECT count(DISTINCT quality) FROM labels) * count(*)), 6) AS weight
    FROM labels GROUP BY quality
    """
)
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.class_weights(table(spark, sf_dir, "labels"), "quality").select("quality", "n", rounded("weight"))


@query(
    """
    SELECT doc_id, lang FROM documents
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id)
            <= (SELECT min(n) FROM (SELECT count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang))
    """
)
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.balanced(_documents(spark, sf_dir, "doc_id", "lang"), "lang", "doc_id")


@query(
    """
    SELECT 'de' AS kept, count(*) AS docs, CAST(sum(doc_id) AS BIGINT) AS id_sum FROM documents WHERE lang = 'de' AND source = 'src3'
    UNION ALL SELECT 'multi', count(*), CAST(sum(doc_id) AS BIGINT) FROM documents
    """
)
def filter_language_and_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "lang", "source")

    def told(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("docs"), F.sum("doc_id").cast("bigint").alias("id_sum")).withColumn("kept", F.lit(name))

    one = S.filter_domain(S.filter_language(docs, "de"), "src3")
    return told("de", one).unionByName(told("multi", S.filter_domain(S.filter_language(docs, "multi"), None)))


@query("SELECT text, source, lang FROM documents")
def select_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.select_columns(_documents(spark, sf_dir), "lang", ["text", "source"])


@query(
    """
    SELECT conv_id, count(*) AS turns,
           string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10) ORDER BY turn) AS text
    FROM conversations GROUP BY conv_id
    """
)
def conversation_chatml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_to_chatml(table(spark, sf_dir, "conversations"))


@query(
    f"""
    WITH r AS (SELECT run_id, ts, event_id, value,
                 row_number() OVER o AS place, min(value) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
               FROM {_LOG} WHERE value IS NOT NULL WINDOW o AS (PARTITION BY run_id ORDER BY ts, event_id)),
    g AS (SELECT *, place - max(CASE WHEN best IS NULL OR value < best THEN place END)
                 OVER (PARTITION BY run_id ORDER BY place) AS stalled FROM r)
    SELECT run_id, arg_min(event_id, place) AS stop_event, arg_min(best, place) AS best
    FROM g WHERE stalled >= 20 GROUP BY run_id
    """
)
def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.early_stopping(log(spark, sf_dir), "value", patience=20).drop("stop_ts")


@query(
    f"""
    SELECT event_id, user_id, value FROM events
    WHERE NOT (event_id % 97 = 0 AND ts < TIMESTAMP '{SLICES[0]}'
               AND ts < (SELECT max(ts) FROM events WHERE ts < TIMESTAMP '{SLICES[1]}') - INTERVAL 2 DAY)
    """
)
def event_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that delivers events again and late, in three slices, to a reader that is restarted after each.

    The second and third slice repeat the last day of the one before. The third
    also brings events held back so far: those of the first slice lie behind the
    watermark (two days) by then and are dropped, those of the second slice's
    last day are not.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    first, second, third = time_slices(events)
    split, later = (F.lit(t).cast("timestamp_ntz") for t in SLICES)
    day = F.expr("INTERVAL 1 DAY")
    too_late, late = F.col("event_id") % 97 == 0, (F.col("event_id") % 97 == 1) & (F.col("ts") >= later - day)
    slices = [
        first.where(~too_late),
        second.where(~late).unionByName(first.where(~too_late & (F.col("ts") >= split - day))),
        third.unionByName(second.where(F.col("ts") >= later - day)).unionByName(first.where(too_late)),
    ]

    def follow(stream: DataFrame, root: str) -> DataFrame:
        once = E.event_dedup(stream.withColumn("ts", F.col("ts").cast("timestamp")), delay="2 days")
        return L.append_result(once, "event-dedup", root)

    return replayed(spark, sf_dir, follow, slices).select("event_id", "user_id", "value")


@query("SELECT source, count(*) AS docs FROM documents GROUP BY source")
def load_bucket_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, "s3://datasets/documents.parquet", buckets={"datasets": sf_dir})
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"))


@query("SELECT doc_id, '[' || lang || '] ' || text AS text FROM documents")
def registered_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own template, registered by name."""
    register_template("tagged", lambda fields: F.concat(F.lit("["), fields["tag"], F.lit("] "), fields["body"]))
    return apply_template(_documents(spark, sf_dir), "tagged", {"tag": "lang", "body": "text"}, keep=["doc_id"])


@query("SELECT lang, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE length(text) > 100 GROUP BY lang")
def user_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own stages, table to table, in order."""
    return run_stages(
        _documents(spark, sf_dir, "lang", "text"),
        [
            lambda d: d.where(F.length("text") > 100),
            lambda d: d.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars")),
        ],
    )
