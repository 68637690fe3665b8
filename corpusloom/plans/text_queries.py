"""Queries over cleaning, de-duplication, chunking, templates and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import chunk as K
from corpusloom.operators import dedup as D
from corpusloom.operators import tokenize as N
from corpusloom.operators.clean import clean_column
from corpusloom.operators.template import apply_template
from corpusloom.plans.preparation import PreprocessConfig, preprocess, processing_stats
from corpusloom.plans.registry import SQL_WS, long, query, sql_clean, table
from corpusloom.session import through_table


def _docs(spark: SparkSession, sf_dir: str, costly: bool = False) -> DataFrame:
    return table(spark, sf_dir, "documents", spread=True, costly=costly)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages", spread=True)


# --- cleaning ---------------------------------------------------------------

# Patterns of cleaning, as the SQL engine writes them.
_CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
_URL = r"https?://[^\s\x0B\x1C-\x1F]+"


# ASCII signs and their full-width forms, which NFKC maps back.
_ASCII = "".join(map(chr, range(0x21, 0x7F)))
_FULL_WIDTH = "".join(chr(ord(c) + 0xFEE0) for c in _ASCII)


@query("SELECT doc_id, text FROM documents")
def normalize_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts put into full-width letters; normalising must give them back."""
    wide = F.translate("text", _ASCII, _FULL_WIDTH)
    return _docs(spark, sf_dir).select("doc_id", X.normalize_unicode(wide).alias("text"))


@query()
def normalize_unicode_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NFKC over whole page sources, which hold entities, accents and symbols."""
    return _pages(spark, sf_dir).select("page_id", X.normalize_unicode(F.col("html")).alias("html"))


@query(f"SELECT page_id, trim(regexp_replace(html, '{SQL_WS}+', ' ', 'g')) AS html FROM pages")
def normalize_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", X.normalize_whitespace(F.col("html")).alias("html"))


@query(f"SELECT doc_id, regexp_replace(text, '{_CONTROLS}', '', 'g') AS text FROM documents")
def remove_control_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(
        "doc_id", X.remove_control_characters(F.col("text")).alias("text")
    )


@query("SELECT page_id, html FROM pages")
def fix_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stray byte is put before every page; repairing must give the page back."""
    broken = F.concat(F.unhex(F.lit("FF")), F.encode("html", "UTF-8")).cast("string")
    pages = _pages(spark, sf_dir).select("page_id", broken.alias("html"))
    return pages.select("page_id", X.fix_encoding(F.col("html")).alias("html"))


@query(f"SELECT page_id, regexp_replace(html, '{_URL}', '', 'g') AS html FROM pages")
def remove_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", X.remove_urls(F.col("html")).alias("html"))


@query(f"SELECT doc_id, regexp_replace(text, '{_EMAIL}', '', 'g') AS text FROM documents")
def remove_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.remove_emails(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {sql_clean('text')} AS text FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_column(_docs(spark, sf_dir).select("doc_id", "text"), "text")


@query(
    f"""
    SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace({sql_clean('text')},
             '{_URL}', '', 'g'), '{_EMAIL}', '', 'g'), '{SQL_WS}+', ' ', 'g')) AS text
    FROM documents
    """
)
def clean_text_aggressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_column(_docs(spark, sf_dir).select("doc_id", "text"), "text", aggressive=True)


# --- de-duplication ---------------------------------------------------------

_FIRST = "SELECT min(doc_id) FROM documents GROUP BY text"


@query(f"SELECT doc_id, text, lang, source, n_chars FROM documents WHERE doc_id IN ({_FIRST})")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.exact_dedup(_docs(spark, sf_dir), "text", "doc_id")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def exact_dedup_kept_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.kept_ids(_docs(spark, sf_dir), "text", "doc_id")


_SHINGLES = r"""
    w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\f\r]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS g
          FROM w WHERE len(w) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
    e AS (SELECT a, b, c AS common, na.n + nb.n - c AS either FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
          WHERE c >= 0.7 * (na.n + nb.n - c) - 1e-9)"""


_NEAR = f"""
    WITH RECURSIVE {_SHINGLES},
    near AS (SELECT a AS id, b AS other FROM e WHERE common >= 0.9 * either - 1e-9
             UNION ALL SELECT b, a FROM e WHERE common >= 0.9 * either - 1e-9),
    r AS (SELECT id, other FROM near UNION SELECT r.id, near.other FROM r JOIN near ON r.other = near.id)
    SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT id FROM r WHERE other < id)
    """


@query(_NEAR)
def near_dedup_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same groups, with candidates from MinHash bands."""
    docs = _docs(spark, sf_dir).select("doc_id", "text", "source")
    return D.near_dedup(docs, "text", "doc_id", 0.9, hashed=True).select("doc_id", "source")


@query(_NEAR)
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document of each group of at least 0.9 similar texts, by exact Jaccard of word shingles."""
    return D.near_dedup(_docs(spark, sf_dir).select("doc_id", "text", "source"), "text", "doc_id", 0.9).select("doc_id", "source")


@query("SELECT doc_id, md5(text) AS text_hash FROM documents")
def hash_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.hash_text(_docs(spark, sf_dir).select("doc_id", "text"), "text").drop("text")


@query(
    """
    SELECT count(*) AS rows_before, count(DISTINCT text) AS rows_after,
           count(*) - count(DISTINCT text) AS rows_removed FROM documents
    """
)
def dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dedup_counts(_docs(spark, sf_dir), "text")


# --- chunking ---------------------------------------------------------------

def _sql_sentences(source: str) -> str:
    marked = (
        f"string_split(regexp_replace(trim(regexp_replace(text, '^{SQL_WS}+|{SQL_WS}+$', '', 'g')), "
        f"'([.!?]){SQL_WS}+', '\\1' || chr(1), 'g'), chr(1))"
    )
    pieces = f"list_filter({marked}, lambda s: s <> '')"
    return f"SELECT doc_id, unnest({pieces}) AS text, generate_subscripts({pieces}, 1) - 1 AS sentence_id FROM {source}"


_SENTENCES = _sql_sentences("documents")


@query(_SENTENCES)
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.split_sentences(_docs(spark, sf_dir).select("doc_id", "text"), "text")
    return rows.select("doc_id", "text", long("sentence_id"))


# Greedy packing of the sentences in ``s``: the tables ``d``, ``walk`` and ``cuts``, and the chunks.
_SQL_CHUNKS = """
    d AS (SELECT doc_id, list(length(text) ORDER BY sentence_id) AS lens,
                 list(text ORDER BY sentence_id) AS texts, count(*) AS n FROM s GROUP BY doc_id),
    walk(doc_id, i, first, chars, cut_first, cut_n) AS (
      SELECT doc_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT FROM d
      UNION ALL
      SELECT doc_id, i + 1, CASE WHEN full_ THEN i - kept ELSE first END,
             CASE WHEN full_ THEN kept_chars + len ELSE chars + len END,
             CASE WHEN full_ THEN first END, CASE WHEN full_ THEN i - first END
      FROM (
        SELECT w.*, d.lens[w.i + 1] AS len,
               w.chars + d.lens[w.i + 1] > 512 AND w.i > w.first AS full_,
               (SELECT coalesce(max(k), 0) FROM range(1, w.i - w.first + 1) r(k)
                 WHERE list_sum(d.lens[w.i - k + 1 : w.i]) <= 50) AS kept,
               coalesce(list_sum(d.lens[w.i - (SELECT coalesce(max(k), 0) FROM range(1, w.i - w.first + 1) r(k)
                 WHERE list_sum(d.lens[w.i - k + 1 : w.i]) <= 50) + 1 : w.i]), 0)::BIGINT AS kept_chars
        FROM walk w JOIN d USING (doc_id) WHERE w.i < d.n)),
    cuts AS (
      SELECT doc_id, cut_first AS first, cut_n AS n FROM walk WHERE cut_n IS NOT NULL
      UNION ALL SELECT w.doc_id, w.first, w.i - w.first FROM walk w JOIN d USING (doc_id) WHERE w.i = d.n)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY c.first, c.n) - 1 AS chunk_id,
           array_to_string(d.texts[c.first + 1 : c.first + c.n], ' ') AS text,
           length(array_to_string(d.texts[c.first + 1 : c.first + c.n], ' ')) AS length, c.n AS sentence_count
    FROM cuts c JOIN d USING (doc_id)
"""


@query(f"WITH RECURSIVE s AS ({_SENTENCES}), {_SQL_CHUNKS}")
def chunk_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.chunk_dataset(_docs(spark, sf_dir).select("doc_id", "text"), "text", details=True)
    return rows.select("doc_id", long("chunk_id"), "text", long("length"), long("sentence_count"))


@query(
    """
    SELECT doc_id, k AS chunk_id, substring(text, 462 * k + 1, 512) AS text,
           length(substring(text, 462 * k + 1, 512)) AS length,
           462 * k AS start_pos, 462 * k + 512 AS end_pos
    FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 462.0) AS BIGINT))) AS k FROM documents)
    """
)
def chunk_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.chunk_dataset(
        _docs(spark, sf_dir).select("doc_id", "text"), "text", preserve_sentences=False, details=True
    )
    return rows.select(
        "doc_id", long("chunk_id"), "text", long("length"), long("start_pos"), long("end_pos")
    )


# --- templates --------------------------------------------------------------


def _exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the reply that follows and the system turn of the conversation."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    replied = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply")
    )
    system = turns.where("role = 'system'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("setting"))
    return asked.join(replied, ["conv_id", "turn"], "left").join(system, "conv_id", "left")


_EXCHANGES = """
  (SELECT u.conv_id, u.turn, u.text AS question, coalesce(a.text, '') AS reply, coalesce(s.setting, '') AS setting
   FROM conversations u
   LEFT JOIN conversations a ON a.role = 'assistant' AND a.conv_id = u.conv_id AND a.turn = u.turn + 1
   LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS setting FROM conversations WHERE role = 'system' GROUP BY conv_id) s
     ON s.conv_id = u.conv_id
   WHERE u.role = 'user')
"""
_KEYS = ["conv_id", "turn"]


@query(
    f"""
    SELECT conv_id, turn,
      CASE WHEN setting <> '' THEN
        'Below is an instruction that describes a task, paired with an input that provides further context. '
        || 'Write a response that appropriately completes the request.' || chr(10) || chr(10)
        || '### Instruction:' || chr(10) || question || chr(10) || chr(10)
        || '### Input:' || chr(10) || setting || chr(10) || chr(10) || '### Response:' || chr(10) || reply
      ELSE
        'Below is an instruction that describes a task. '
        || 'Write a response that appropriately completes the request.' || chr(10) || chr(10)
        || '### Instruction:' || chr(10) || question || chr(10) || chr(10) || '### Response:' || chr(10) || reply
      END AS text
    FROM {_EXCHANGES}
    """
)
def template_alpaca(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = {"instruction": "question", "input": "setting", "output": "reply"}
    return apply_template(_exchanges(spark, sf_dir), "alpaca", mapping, keep=_KEYS)


@query(
    f"""
    SELECT conv_id, turn, concat_ws(chr(10),
      CASE WHEN setting <> '' THEN '<|im_start|>system' || chr(10) || setting || '<|im_end|>' END,
      CASE WHEN question <> '' THEN '<|im_start|>user' || chr(10) || question || '<|im_end|>' END,
      CASE WHEN reply <> '' THEN '<|im_start|>assistant' || chr(10) || reply || '<|im_end|>' END) AS text
    FROM {_EXCHANGES}
    """
)
def template_chatml(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = {"system": "setting", "user": "question", "assistant": "reply"}
    return apply_template(_exchanges(spark, sf_dir), "chatml", mapping, keep=_KEYS)


@query(
    f"""
    SELECT conv_id, turn, '<s>[INST] '
      || CASE WHEN setting <> '' THEN '<<SYS>>' || chr(10) || setting || chr(10) || '<</SYS>>' || chr(10) || chr(10) ELSE '' END
      || question || ' [/INST] ' || reply AS text
    FROM {_EXCHANGES}
    """
)
def template_llama2(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = {"system": "setting", "user": "question", "assistant": "reply"}
    return apply_template(_exchanges(spark, sf_dir), "llama2", mapping, keep=_KEYS)


@query(f"SELECT conv_id, turn, question || reply AS text FROM {_EXCHANGES}")
def template_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = {"text": "question", "completion": "reply"}
    return apply_template(_exchanges(spark, sf_dir), "completion", mapping, keep=_KEYS)


@query(
    """
    SELECT doc_id, CASE WHEN text <> '' THEN '<|im_start|>user' || chr(10) || text || '<|im_end|>' ELSE '' END AS text
    FROM documents
    """
)
def template_missing_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapped column the table lacks reads as empty."""
    mapping = {"user": "text", "assistant": "no_such_column"}
    return apply_template(_docs(spark, sf_dir), "chatml", mapping, keep=["doc_id"])


# --- tokens -----------------------------------------------------------------


@query()
def count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.count_tokens(_docs(spark, sf_dir).select("doc_id", "text"), "text").drop("text")


@query()
def token_stats_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = N.count_tokens(_docs(spark, sf_dir).select("source", "text"), "text")
    return N.token_stats(counted, by=["source"])


@query(
    """
    SELECT role, count(*) AS num_samples, round(avg(n), 2) AS avg_tokens,
           min(n) AS min_tokens, max(n) AS max_tokens
    FROM (SELECT role, CAST(ceil(octet_length(encode(text)) / 4.0) AS BIGINT) AS n FROM conversations)
    GROUP BY role
    """
)
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics alone, over the tokenizer-free estimate SQL can repeat."""
    turns = table(spark, sf_dir, "conversations").select(
        "role", X.estimated_tokens(F.col("text")).alias("token_count")
    )
    return N.token_stats(turns, by=["role"])


_END_OF_TEXT = 50256


@query()
def tokenize_fixed_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows of 2048 ids with mask and labels, summed up per row; long texts give several."""
    rows = N.token_windows(
        _docs(spark, sf_dir, costly=True).select("doc_id", "text"), "text", 2048, padding=True, pad_id=_END_OF_TEXT
    )
    labelled = N.causal_labels(rows, _END_OF_TEXT)
    return labelled.select(
        "doc_id", "window", "token_count",
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("true_tokens"),
        F.size(F.array_remove("labels", N.IGNORED_LABEL)).alias("learned_tokens"),
        F.xxhash64("input_ids").alias("ids_hash"),
    )


@query()
def tokenize_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.tokenize_batches(
        _docs(spark, sf_dir, costly=True).select("doc_id", "text"), "text", "doc_id", batch_size=32, pad_id=_END_OF_TEXT
    )
    return rows.select(
        "doc_id", "batch_id", "true_tokens", "token_count", F.size("input_ids").alias("padded_length")
    )


@query("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS changed FROM documents")
def token_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.round_trip_audit(_docs(spark, sf_dir, costly=True), "text").select("rows", "changed")


# The same steps over ids that SQL can repeat: the bytes of the whole texts.
_BYTES = """
    (SELECT doc_id, source, coalesce(strlen(text), 0) AS n,
            list_transform(range(coalesce(strlen(text), 0)), lambda k: 1 + CAST('0x' || substr(hex(encode(text)), 2 * k + 1, 2) AS INTEGER)) AS ids
     FROM documents)
"""


@query(
    f"""
    WITH b AS MATERIALIZED (
      SELECT doc_id, n, unnest(ids) AS id, unnest(range(n)) AS place FROM {_BYTES} WHERE n > 0)
    SELECT doc_id, CAST(place // 512 AS INTEGER) AS "window", 512 AS token_count, CAST(count(*) AS INTEGER) AS true_tokens,
           CAST(count(*) AS INTEGER) AS learned_tokens, CAST(sum(id) AS BIGINT) AS id_sum,
           CAST(sum(id * (1 + place % 512)) AS BIGINT) AS place_sum
    FROM b GROUP BY doc_id, place // 512
    UNION ALL SELECT doc_id, 0, 512, 0, 0, 0, 0 FROM documents WHERE coalesce(strlen(text), 0) = 0
    """
)
def byte_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed windows with padding, mask and labels; the sums tell which ids stand in a window, and where."""
    ids = _docs(spark, sf_dir, costly=True).select("doc_id", N.byte_ids(F.col("text")).alias("input_ids"))
    rows = N.causal_labels(N.cut_windows(ids, "input_ids", 512, padding=True), pad_id=0)
    at = F.zip_with("input_ids", F.sequence(F.lit(1), F.lit(512)), lambda i, k: (i * k).cast("bigint"))
    return rows.select(
        "doc_id", "window", "token_count",
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("true_tokens"),
        F.size(F.array_remove("labels", N.IGNORED_LABEL)).alias("learned_tokens"),
        F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"),
        F.aggregate(at, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("place_sum"),
    )


@query(
    """
    WITH r AS (SELECT doc_id, coalesce(strlen(text), 0) AS n, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents)
    SELECT doc_id, CAST(place // 32 AS BIGINT) AS batch_id, CAST(n AS INTEGER) AS true_tokens,
           CAST(max(n) OVER (PARTITION BY place // 32) AS INTEGER) AS token_count,
           CAST(max(n) OVER (PARTITION BY place // 32) AS INTEGER) AS padded_length
    FROM r
    """
)
def byte_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of neighbouring rows, each padded to its own longest."""
    ids = _docs(spark, sf_dir, costly=True).select("doc_id", N.byte_ids(F.col("text")).alias("input_ids"))
    rows = N.batch_rows(through_table(ids, "byte-ids"), "input_ids", "doc_id", batch_size=32)
    return rows.select("doc_id", "batch_id", "true_tokens", "token_count", F.size("input_ids").alias("padded_length"))


@query(
    """
    SELECT source, count(*) AS rows, count(*) FILTER (n > 2048) AS truncated_rows, CAST(sum(n) AS BIGINT) AS tokens,
           CAST(sum(greatest(n - 2048, 0)) AS BIGINT) AS lost_tokens
    FROM (SELECT source, coalesce(strlen(text), 0) AS n FROM documents) GROUP BY source
    """
)
def truncation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cut at 2048 ids would take from each source."""
    counted = _docs(spark, sf_dir).select("source", F.octet_length(F.coalesce("text", F.lit(""))).alias("token_count"))
    return N.truncation_stats(counted, 2048, by=["source"])


# --- the whole job ----------------------------------------------------------


@query(
    f"""
    WITH c AS (SELECT doc_id, source, {sql_clean('text')} AS text FROM documents),
    k AS (SELECT c.* FROM c JOIN (SELECT min(doc_id) AS doc_id FROM c GROUP BY text) USING (doc_id))
    SELECT source, count(*) AS docs, CAST(sum(doc_id) AS BIGINT) AS id_sum,
           CAST(sum(length(text)) AS BIGINT) AS chars,
           round(avg(ceil(octet_length(encode(text)) / 4.0)), 2) AS avg_token_estimate
    FROM k GROUP BY source
    """
)
def prepare_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: clean, remove copies, describe what is left per source."""
    cleaned = clean_column(_docs(spark, sf_dir).select("doc_id", "source", "text"), "text")
    kept = D.exact_dedup(through_table(cleaned, "cleaned"), "text", "doc_id")
    return kept.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum("doc_id").cast("bigint").alias("id_sum"),
        F.sum(F.length("text")).alias("chars"),
        F.round(F.avg(X.estimated_tokens(F.col("text"))), 2).alias("avg_token_estimate"),
    )


@query()
def preprocess_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full job, tokens counted by the tokenizer, as its statistics row."""
    docs = _docs(spark, sf_dir)
    config = PreprocessConfig(chunk=True)
    return processing_stats(docs, preprocess(docs, "text", "doc_id", config))


@query()
def preprocess_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full job with a template and chunks, one row per chunk."""
    config = PreprocessConfig(
        template="alpaca", template_mapping={"instruction": "text", "output": "lang"}, chunk=True
    )
    rows = preprocess(_docs(spark, sf_dir, costly=True), "text", "doc_id", config)
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "token_count")


_SQL_TEMPLATED = f"""
    WITH c AS (SELECT doc_id, lang, {sql_clean('text')} AS text FROM documents),
    k AS (SELECT c.* FROM c JOIN (SELECT min(doc_id) AS doc_id FROM c GROUP BY text) USING (doc_id))
    SELECT doc_id,
      'Below is an instruction that describes a task. '
      || 'Write a response that appropriately completes the request.' || chr(10) || chr(10)
      || '### Instruction:' || chr(10) || text || chr(10) || chr(10) || '### Response:' || chr(10) || lang AS text
    FROM k
"""


@query(_SQL_TEMPLATED)
def preprocess_templated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clean, dedup and template of the full job; the token count is left off for SQL."""
    config = PreprocessConfig(
        template="alpaca", template_mapping={"instruction": "text", "output": "lang"}
    )
    return preprocess(_docs(spark, sf_dir), "text", "doc_id", config).select("doc_id", "text")


_SQL_PREPROCESSED = f"""
    SELECT doc_id, md5(text) AS text_hash, CAST(ceil(octet_length(encode(text)) / 4.0) AS BIGINT) AS token_count
    FROM (WITH RECURSIVE t AS ({_SQL_TEMPLATED}), s AS ({_sql_sentences('t')}), {_SQL_CHUNKS})
"""


def _preprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clean, dedup, template, chunk; tokens by the estimate from bytes, which SQL can repeat."""
    config = PreprocessConfig(
        template="alpaca", template_mapping={"instruction": "text", "output": "lang"}, chunk=True, token_counter=X.estimated_tokens
    )
    return preprocess(_docs(spark, sf_dir), "text", "doc_id", config)


@query(_SQL_PREPROCESSED)
def preprocess_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full job, one row per chunk."""
    return _preprocessed(spark, sf_dir).select("doc_id", F.md5("text").alias("text_hash"), long("token_count"))


@query(
    f"""
    SELECT (SELECT count(*) FROM documents) AS original_samples, count(*) AS final_samples,
           (SELECT count(*) FROM documents) - count(*) AS removed_samples, round(avg(token_count), 2) AS avg_tokens,
           min(token_count) AS min_tokens, max(token_count) AS max_tokens
    FROM ({_SQL_PREPROCESSED})
    """
)
def preprocess_chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics row of the full job."""
    return processing_stats(_docs(spark, sf_dir), _preprocessed(spark, sf_dir))
