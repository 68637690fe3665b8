"""Queries over evaluation, comparison and the rule tables.

The tables hold no model output, so two models are derived from the documents:
the tuned one loses every 7th word of a text, the base one every 3rd. Texts are
scored whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import compare as C
from corpusloom.operators import evaluate as E
from corpusloom.operators import rules as R
from corpusloom.operators.profile import dataset_stats
from corpusloom.plans.preparation import evaluate_and_compare
from corpusloom.plans.registry import query, rounded, table


def _without_every(text: str, n: int) -> Column:
    return F.array_join(F.filter(F.split(text, " "), lambda w, i: (i + 1) % n != 0), " ")


def _sql_without_every(text: str, n: int) -> str:
    return f"array_to_string(list_filter(string_split({text}, ' '), lambda w, i: i % {n} <> 0), ' ')"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as evaluation samples; a third of the references differ only in outer blanks."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", F.col("source").alias("input"), F.concat(F.lit("  "), F.col("text"), F.lit("\n")).alias("output")
    )


def predictions(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", _without_every("text", n).alias("prediction"))


def pairs(spark: SparkSession, sf_dir: str, n: int = 7) -> DataFrame:
    return E.extract_pairs(samples(spark, sf_dir), predictions(spark, sf_dir, n), "doc_id")


def model_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, doc_id, prediction, reference) for the two models, from one scan; a reference is tokenized once."""
    docs = table(spark, sf_dir, "documents", spread=True, costly=True)
    answers = F.array(
        F.struct(F.lit("base").alias("model"), _without_every("text", 3).alias("prediction")),
        F.struct(F.lit("tuned").alias("model"), _without_every("text", 7).alias("prediction")),
    )
    samples = E.reference_tokens(docs.select("doc_id", "text", F.col("text").alias("reference")))
    return samples.select("doc_id", "reference", *E.REFERENCE_TOKENS, F.inline(answers))


def _sql_model_pairs() -> str:
    return f"""
      SELECT 'base' AS model, doc_id, {_sql_without_every('text', 3)} AS prediction, text AS reference FROM documents
      UNION ALL
      SELECT 'tuned', doc_id, {_sql_without_every('text', 7)}, text FROM documents
    """


@query(
    f"""
    SELECT doc_id, source AS input, {_sql_without_every('text', 7)} AS prediction,
           '  ' || text || chr(10) AS reference FROM documents
    """
)
def pair_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir)


@query(
    f"""
    SELECT round(avg(CASE WHEN trim({_sql_without_every('text', 7)}, ' ' || chr(10)) = trim(text, ' ' || chr(10))
                     THEN 1 ELSE 0 END), 6) AS accuracy
    FROM documents
    """
)
def exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.exact_match(pairs(spark, sf_dir)).select(rounded("accuracy"))


def _sql_13a(text: str) -> str:
    # The published mteval-13a tokenisation in the SQL engine's syntax.
    out = f"(' ' || {text} || ' ')"
    for old, new in (("<skipped>", "''"), ("-' || chr(10) || '", "''"), ("' || chr(10) || '", "' '"),
                     ("&quot;", "'\"'"), ("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'")):
        out = f"replace({out}, '{old}', {new})"
    for pattern, new in (
        (r"([\{-\~\[-\x60 -\&\(-\+\:-\@\/])", r" \1 "),
        (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return f"list_filter(regexp_split_to_array({out}, '\\s+'), lambda w: w <> '')"


def _sql_grams(orders: int) -> str:
    """n-gram counts per pair and side, from the table ``tok(model, doc_id, p, r)``."""
    ahead = [f"lead(w, {j}) OVER o AS w{j}" for j in range(1, orders)]
    parts = []
    for n in range(1, orders + 1):
        last = f"w{n - 1}" if n > 1 else "w"
        gram = " || chr(1) || ".join(["w", *[f"w{j}" for j in range(1, n)]])
        parts.append(f"SELECT model, doc_id, mine, {n} AS n, {gram} AS g FROM spread WHERE {last} IS NOT NULL")
    return f"""
      SELECT model, doc_id, n, g, sum(mine) AS cp, sum(1 - mine) AS cr
      FROM (WITH words AS (
              SELECT model, doc_id, 1 AS mine, unnest(p) AS w, unnest(range(len(p))) AS i FROM tok UNION ALL
              SELECT model, doc_id, 0, unnest(r), unnest(range(len(r))) FROM tok),
            spread AS (SELECT {', '.join(['model', 'doc_id', 'mine', 'w', *ahead])} FROM words
                       WINDOW o AS (PARTITION BY model, doc_id, mine ORDER BY i))
            {' UNION ALL '.join(parts)})
      GROUP BY model, doc_id, n, g
    """


_SQL_BLEU = f"""
    WITH pairs AS ({_sql_model_pairs()}),
    tok AS (SELECT model, doc_id, {_sql_13a('prediction')} AS p, {_sql_13a('reference')} AS r FROM pairs),
    grams AS ({_sql_grams(4)}),
    per_n AS (SELECT model, n, sum(least(cp, cr)) AS m, sum(cp) AS t, sum(cr) AS rt FROM grams GROUP BY model, n),
    s AS (SELECT model, max(m) FILTER (n = 1) AS m1, max(t) FILTER (n = 1) AS c, max(rt) FILTER (n = 1) AS r,
                 min(t) AS least_t, avg(ln(m / t)) AS log_p FROM per_n GROUP BY model)
    SELECT model, 100 * CASE WHEN c > r THEN 1 ELSE exp(1 - r / c) END * exp(log_p) AS bleu FROM s
"""


@query(f"SELECT model, round(bleu, 6) AS bleu FROM ({_SQL_BLEU})")
def corpus_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = E.corpus_bleu(model_pairs(spark, sf_dir), by=["model"])
    return scored.select("model", rounded("bleu"))


def _sql_rouge_tokens(text: str) -> str:
    return (
        f"list_filter(string_split(trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')"
    )


# A prediction of these models leaves words out of its reference and adds none, so it is the longest common subsequence.
_SQL_ROUGE = f"""
    WITH pairs AS ({_sql_model_pairs()}),
    tok AS (SELECT model, doc_id, {_sql_rouge_tokens('prediction')} AS p, {_sql_rouge_tokens('reference')} AS r FROM pairs),
    grams AS ({_sql_grams(2)}),
    f AS (SELECT model, doc_id, n, 2.0 * sum(least(cp, cr)) / (sum(cp) + sum(cr)) AS f FROM grams GROUP BY model, doc_id, n)
    SELECT t.model, t.doc_id, coalesce(a.f, 0) AS rouge1, coalesce(b.f, 0) AS rouge2,
           CASE WHEN len(p) > 0 THEN 2.0 * len(p) / (len(p) + len(r)) ELSE 0 END AS "rougeL"
    FROM tok t LEFT JOIN f a ON a.model = t.model AND a.doc_id = t.doc_id AND a.n = 1
               LEFT JOIN f b ON b.model = t.model AND b.doc_id = t.doc_id AND b.n = 2
"""


@query(f"SELECT model, round(avg(rouge1), 6) AS rouge1, round(avg(rouge2), 6) AS rouge2 FROM ({_SQL_ROUGE}) GROUP BY model")
def rouge_n_unstemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = E.rouge(model_pairs(spark, sf_dir), by=["model"], stemming=False)
    return scored.select("model", rounded("rouge1"), rounded("rouge2"))


@query(f'SELECT model, doc_id, round(rouge1, 6) AS rouge1, round(rouge2, 6) AS rouge2, round("rougeL", 6) AS "rougeL" FROM ({_SQL_ROUGE})')
def pair_rouge_unstemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROUGE-1, ROUGE-2 and ROUGE-L of every pair, over whole texts."""
    rows = E.pair_scores(model_pairs(spark, sf_dir), keep=["model", "doc_id"], stemming=False, bleu=False)
    return rows.select("model", "doc_id", *[rounded(name) for name in ("rouge1", "rouge2", "rougeL")])


@query()
def rouge_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = E.rouge(model_pairs(spark, sf_dir), by=["model"])
    return scored.select("model", rounded("rouge1"), rounded("rouge2"), rounded("rougeL"))


@query()
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every score pair by pair, for looking into single answers."""
    rows = E.pair_scores(model_pairs(spark, sf_dir), keep=["model", "doc_id"])
    return rows.select(
        "model", "doc_id", "exact", *[f"match{n}" for n in E.BLEU_ORDERS],
        *[rounded(name) for name in ("rouge1", "rouge2", "rougeL")],
    )


@query(
    """
    SELECT event_type, round(exp(sum(value / 100 * k) / sum(k)), 6) AS perplexity
    FROM (SELECT event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
    GROUP BY event_type
    """
)
def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values read as losses, the ``k`` property as token numbers."""
    losses = table(spark, sf_dir, "events").select(
        "event_type",
        (F.col("value") / 100).alias("loss"),
        F.get_json_object("props", "$.k").cast("bigint").alias("tokens"),
    )
    return E.perplexity(losses, "loss", "tokens", ["event_type"]).select("event_type", rounded("perplexity"))


@query(
    """
    WITH g AS (SELECT l.quality AS label, CASE WHEN d.n_chars >= 300 THEN 1 ELSE 0 END AS guess
               FROM labels l JOIN documents d USING (doc_id)),
    c AS (SELECT k AS class, count(*) FILTER (label = k AND guess = k) AS tp,
                 count(*) FILTER (label = k) AS act, count(*) FILTER (guess = k) AS gue
          FROM g, (SELECT DISTINCT label AS k FROM g UNION SELECT DISTINCT guess FROM g) GROUP BY k)
    SELECT round(avg(CASE WHEN tp > 0 THEN 2.0 * tp / (act + gue) ELSE 0 END), 6) AS f1_macro,
           round(2.0 * sum(tp) / (sum(act) + sum(gue)), 6) AS f1_micro FROM c
    """
)
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels against a guess from the length of the text."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("n_chars") >= 300, 1).otherwise(0).alias("guess")
    )
    judged = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return E.f1_scores(judged, "guess", "quality").select(rounded("f1_macro"), rounded("f1_micro"))


def _with_losses(pairs: DataFrame) -> DataFrame:
    """The losses are the relative lengths lost."""
    return pairs.withColumns(
        {
            "loss": 1 - F.length("prediction") / (F.length("reference") + 1),
            "tokens": F.length("reference"),
        }
    )


@query()
def compute_all_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every score of the two models."""
    scored = _with_losses(model_pairs(spark, sf_dir))
    metrics = E.compute_all(scored, by=["model"], loss="loss", tokens="tokens")
    return metrics.select("model", "metric", rounded("value"))


_SQL_ALL = f"""
  (WITH r AS (SELECT model, avg(rouge1) AS rouge1, avg(rouge2) AS rouge2, avg("rougeL") AS "rougeL" FROM ({_SQL_ROUGE}) GROUP BY model),
   o AS (SELECT model, avg(CASE WHEN trim(prediction, ' ' || chr(10)) = trim(reference, ' ' || chr(10)) THEN 1.0 ELSE 0.0 END) AS accuracy,
                exp(sum((1 - length(prediction) / (length(reference) + 1.0)) * length(reference)) / sum(length(reference))) AS perplexity
         FROM ({_sql_model_pairs()}) GROUP BY model),
   b AS ({_SQL_BLEU})
   SELECT model, 'bleu' AS metric, bleu AS value FROM b
   UNION ALL SELECT model, 'rouge1', rouge1 FROM r UNION ALL SELECT model, 'rouge2', rouge2 FROM r
   UNION ALL SELECT model, 'rougeL', "rougeL" FROM r
   UNION ALL SELECT model, 'accuracy', accuracy FROM o UNION ALL SELECT model, 'perplexity', perplexity FROM o)
"""


@query(f"SELECT model, metric, round(value, 6) AS value FROM {_SQL_ALL}")
def all_metrics_unstemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every score of the two models, without stemming."""
    scored = _with_losses(model_pairs(spark, sf_dir))
    metrics = E.compute_all(scored, by=["model"], stemming=False, loss="loss", tokens="tokens")
    return metrics.select("model", "metric", rounded("value"))


@query(
    f"""
    WITH m AS ({_SQL_ALL[_SQL_ALL.index("(") + 1:_SQL_ALL.rindex(")")]})
    SELECT metric, round(b.value, 6) AS base_value, round(t.value, 6) AS tuned_value, round(t.value - b.value, 6) AS absolute,
           round(CASE WHEN b.value <= 0 THEN 0 WHEN metric = 'perplexity' THEN (b.value - t.value) / b.value * 100
                 ELSE (t.value - b.value) / b.value * 100 END, 6) AS relative_percent
    FROM m b JOIN m t USING (metric) WHERE b.model = 'base' AND t.model = 'tuned'
    """
)
def compare_models_unstemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole evaluation of two models, from pairs to their comparison."""
    compared = evaluate_and_compare(
        _with_losses(model_pairs(spark, sf_dir)), "base", "tuned", stemming=False, loss="loss", tokens="tokens"
    )
    return compared.select("metric", *[rounded(c) for c in ("base_value", "tuned_value", "absolute", "relative_percent")])


_METRICS = """
  (SELECT CASE WHEN user_id % 2 = 0 THEN 'base' ELSE 'tuned' END AS model,
          CASE event_type WHEN 'error' THEN 'perplexity' ELSE event_type END AS metric, avg(value) AS value
   FROM events GROUP BY ALL)
"""

_COMPARED = f"""
  (SELECT b.metric, b.value AS base_value, t.value AS tuned_value, t.value - b.value AS absolute,
          CASE WHEN b.value <= 0 THEN 0
               WHEN b.metric = 'perplexity' THEN (b.value - t.value) / b.value * 100
               ELSE (t.value - b.value) / b.value * 100 END AS relative_percent
   FROM {_METRICS} b JOIN {_METRICS} t ON b.metric = t.metric AND b.model = 'base' AND t.model = 'tuned')
"""


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean event value per type as a metric; users of even number stand for the base model."""
    events = table(spark, sf_dir, "events")
    model = F.when(F.col("user_id") % 2 == 0, "base").otherwise("tuned")
    metric = F.when(F.col("event_type") == "error", "perplexity").otherwise(F.col("event_type"))
    return events.groupBy(model.alias("model"), metric.alias("metric")).agg(F.avg("value").alias("value"))


@query(
    f"""
    SELECT metric, round(base_value, 6) AS base_value, round(tuned_value, 6) AS tuned_value,
           round(absolute, 6) AS absolute, round(relative_percent, 6) AS relative_percent FROM {_COMPARED}
    """
)
def compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = C.compare_models(_metrics(spark, sf_dir), "base", "tuned")
    return compared.select(
        "metric", *[rounded(c) for c in ("base_value", "tuned_value", "absolute", "relative_percent")]
    )


@query(
    f"""
    SELECT metric, printf('%.4f', base_value) AS base_model, printf('%.4f', tuned_value) AS tuned_model,
           CASE WHEN relative_percent > 0 THEN '+' ELSE '' END || printf('%.2f', relative_percent) || '%' AS improvement
    FROM {_COMPARED}
    """
)
def comparison_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.comparison_table(C.compare_models(_metrics(spark, sf_dir), "base", "tuned"))


@query(
    f"""
    SELECT count(*) FILTER (relative_percent > 0) AS improved, count(*) AS total,
           arg_max(metric, relative_percent) AS best_metric, round(max(relative_percent), 6) AS best_percent
    FROM {_COMPARED}
    """
)
def comparison_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = C.comparison_summary(C.compare_models(_metrics(spark, sf_dir), "base", "tuned"))
    return summary.select("improved", "total", "best_metric", rounded("best_percent"))


# Headings and layout of the report.
@query(
    f"""
    SELECT '# Model Comparison Report' || chr(10) || chr(10) || '## Metrics Comparison' || chr(10) || chr(10)
      || '| Metric | Base Model | Fine-tuned Model | Improvement |' || chr(10)
      || '|--------|------------|------------------|-------------|' || chr(10)
      || string_agg('| ' || metric || ' | ' || printf('%.4f', base_value) || ' | ' || printf('%.4f', tuned_value) || ' | '
           || CASE WHEN relative_percent > 0 THEN '+' ELSE '' END || printf('%.2f', relative_percent) || '% |' || chr(10),
           '' ORDER BY metric)
      || chr(10) || '## Summary' || chr(10) || chr(10)
      || '- **Metrics improved**: ' || count(*) FILTER (relative_percent > 0) || '/' || count(*) || chr(10)
      || '- **Best improvement**: ' || arg_max(metric, relative_percent)
      || ' (' || printf('%.2f', max(relative_percent)) || '%)' || chr(10) AS report
    FROM {_COMPARED}
    """
)
def comparison_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.comparison_report(C.compare_models(_metrics(spark, sf_dir), "base", "tuned"))


@query()
def evaluate_and_compare_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = evaluate_and_compare(model_pairs(spark, sf_dir), "base", "tuned")
    return compared.select("metric", rounded("base_value"), rounded("tuned_value"), rounded("relative_percent"))


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words per answer as tokens; a fixed cost per character stands for latency."""
    return model_pairs(spark, sf_dir).select(
        "doc_id", "model",
        F.size(F.split("prediction", " ")).cast("bigint").alias("tokens"),
        (F.length("prediction") * F.when(F.col("model") == "base", 3).otherwise(2)).cast("bigint").alias("latency_ms"),
    )


_DELTAS = f"""
  (SELECT b.doc_id, t.tokens - b.tokens AS token_delta, t.latency - b.latency AS latency_delta_ms
   FROM (SELECT doc_id, len(string_split(p, ' ')) AS tokens, length(p) * 3 AS latency
         FROM (SELECT doc_id, {_sql_without_every('text', 3)} AS p FROM documents)) b
   JOIN (SELECT doc_id, len(string_split(p, ' ')) AS tokens, length(p) * 2 AS latency
         FROM (SELECT doc_id, {_sql_without_every('text', 7)} AS p FROM documents)) t USING (doc_id))
"""


@query(f"SELECT doc_id, token_delta, latency_delta_ms FROM {_DELTAS}")
def paired_response_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.paired_response_delta(_responses(spark, sf_dir), "base", "tuned", "doc_id")


@query(
    f"""
    SELECT count(*) AS prompts, round(avg(token_delta), 6) AS avg_token_delta,
           round(avg(latency_delta_ms), 6) AS avg_latency_delta_ms,
           count(*) FILTER (latency_delta_ms < 0) AS faster FROM {_DELTAS}
    """
)
def delta_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    deltas = C.paired_response_delta(_responses(spark, sf_dir), "base", "tuned", "doc_id")
    summary = C.delta_summary(deltas)
    return summary.select("prompts", rounded("avg_token_delta"), rounded("avg_latency_delta_ms"), "faster")


# --- rules ------------------------------------------------------------------


def _conversation_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a dataset whose columns are the roles it has, first seen first."""
    turns = table(spark, sf_dir, "conversations")
    first_seen = turns.groupBy("conv_id", "role").agg(F.min("turn").alias("turn"))
    column = (
        F.when(F.col("role") == "user", "Instruction")
        .when(F.col("role") == "assistant", "response")
        .otherwise(F.col("role"))
    )
    # Bounded group: one entry per role.
    ordered = F.array_sort(F.collect_list(F.struct("turn", column.alias("name"))))
    return first_seen.groupBy("conv_id").agg(ordered["name"].alias("columns"))


# Column words, confidences and reasons of the task rules.
@query(
    """
    WITH r AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY conv_id, role),
    c AS (SELECT conv_id, list(CASE role WHEN 'user' THEN 'Instruction' WHEN 'assistant' THEN 'response' ELSE role END
                               ORDER BY t) AS cols FROM r GROUP BY conv_id),
    d AS (SELECT *, list_contains(cols, 'Instruction') AND list_contains(cols, 'response') AS chat FROM c)
    SELECT conv_id, CASE WHEN chat THEN 'chat' ELSE 'generation' END AS task_type,
           CASE WHEN chat THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence,
           CASE WHEN chat THEN 'response' ELSE cols[-1] END AS target_column,
           CASE WHEN chat THEN 'Dataset has instruction-response format'
                ELSE 'No clear task indicators, assuming text generation' END AS reasoning
    FROM d
    """
)
def detect_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.detect_task(_conversation_schemas(spark, sf_dir)).drop("columns")


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source as a dataset; the listed size is taken for a sample of one percent."""
    stats = dataset_stats(table(spark, sf_dir, "documents").select("source", "text"), by=["source"])
    digits = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    return stats.select(
        "source",
        R.rows_from_sample(F.col("rows")).alias("rows"),
        "avg_text_length",
        (digits % 2).alias("gpu_count"),
        F.when(digits % 3 == 0, "fast").when(digits % 3 == 1, "balanced").otherwise("high_quality").alias("training_mode"),
    )


_PROFILES = """
  (SELECT source, count(*) * 100 AS rows, avg(length(text)) AS len,
          CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) % 2 AS gpus,
          CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) % 3 AS mode FROM documents GROUP BY source)
"""

_SUGGESTED = f"""
  (SELECT *, CASE WHEN long_ THEN greatest(2, b // 2) ELSE b END AS batch_size,
          CASE WHEN long_ THEN greatest(8, r // 2) ELSE r END AS lora_rank
   FROM (SELECT source, gpus, mode, len > 500 AS long_,
                CASE WHEN gpus > 0 THEN CASE WHEN rows > 5000 THEN 8 ELSE 4 END ELSE 2 END AS b,
                CASE WHEN rows < 1000 THEN 8 WHEN rows < 10000 THEN 16 ELSE 32 END AS r,
                CASE WHEN rows < 1000 THEN 16 WHEN rows < 10000 THEN 32 ELSE 64 END AS lora_alpha,
                CASE WHEN rows < 1000 THEN 5 WHEN rows < 10000 THEN 3 ELSE 2 END AS epochs,
                CASE WHEN rows < 1000 THEN 1e-4 ELSE 2e-4 END AS learning_rate,
                CASE WHEN gpus > 0 THEN 'fp16' ELSE 'fp32' END AS precision FROM {_PROFILES}))
"""
_SETTINGS = ["batch_size", "epochs", "lora_rank", "lora_alpha", "learning_rate", "precision"]


@query(f"SELECT source, {', '.join(_SETTINGS)} FROM {_SUGGESTED}")
def suggest_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.suggest_config(_profiles(spark, sf_dir)).select("source", *_SETTINGS)


@query(
    f"""
    SELECT *, CASE WHEN gpus = 0 THEN 4 WHEN batch_size < 8 THEN 8 // batch_size ELSE 1 END AS gradient_accumulation
    FROM (SELECT source, gpus, CASE mode WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 5 END AS epochs,
                 CASE WHEN mode = 0 THEN greatest(batch_size, 4) ELSE batch_size END AS batch_size,
                 CASE WHEN mode = 2 THEN learning_rate * 0.5 ELSE learning_rate END AS learning_rate,
                 CASE mode WHEN 0 THEN least(8, lora_rank) WHEN 1 THEN lora_rank ELSE least(32, lora_rank * 2) END AS lora_rank,
                 lora_alpha, precision FROM {_SUGGESTED})
    """
)
def apply_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned = R.apply_preset(R.suggest_config(_profiles(spark, sf_dir)))
    return tuned.select("source", F.col("gpu_count").alias("gpus"), *_SETTINGS, "gradient_accumulation")


@query(
    """
    SELECT event_id, CASE WHEN k <= 12 THEN 8 WHEN k <= 24 THEN 16 WHEN k <= 48 THEN 32 ELSE 64 END AS lora_rank
    FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
    """
)
def snap_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    wished = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select("event_id", R.snap_rank(wished).alias("lora_rank"))
