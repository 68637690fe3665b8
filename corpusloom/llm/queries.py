"""Registered queries of the training-data operators and the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    compact_windows, decontaminate, embedding_dedup, exact_dedup, html_extract, language_id, lexical_search, merkle,
    minhash_dedup, mixing, packing, quality, suffix_dedup,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query(
    r"""
    WITH t AS (
      SELECT doc_id, length(coalesce(text, '')) AS n,
             regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body
      FROM documents)
    SELECT doc_id,
           first_value(doc_id) OVER w AS keep_id,
           count(*) OVER (PARTITION BY body) AS group_size,
           row_number() OVER w = 1 AS kept,
           sha256(body) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id)
    """
)
def op6_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


@_query(
    r"""
    WITH sized AS (
      SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS h,
             CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
      FROM documents),
    src AS (
      SELECT source, CAST(sum(size) AS BIGINT) AS s,
             1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
      FROM sized GROUP BY source),
    steps AS (
      SELECT 3 * s / w AS ratio,
             sum(s) OVER () - coalesce(sum(3 * s) OVER before, 0) AS words_left,
             sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS weight_left
      FROM src
      WINDOW before AS (ORDER BY 3 * s / w, w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    unit AS (SELECT arg_min(CAST(words_left AS DOUBLE) / weight_left, ratio) AS u FROM steps
             WHERE ratio >= CAST(words_left AS DOUBLE) / weight_left),
    targets AS (SELECT source, s, w, least(CAST(3 * s AS DOUBLE), u * w) AS target FROM src, unit),
    ends AS (
      SELECT doc_id, h, size, s, w, target, t.source,
             CASE WHEN s = 0 THEN 0 ELSE floor(target / s) END AS passes,
             sum(size) OVER (PARTITION BY t.source ORDER BY h, doc_id, size
                             ROWS UNBOUNDED PRECEDING) AS e
      FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
    extra AS (SELECT *, e <= target - passes * s AND size > 0 AS x FROM ends),
    gaps AS (SELECT source, max(target - passes * s) - coalesce(sum(size) FILTER (x), 0) AS gap
             FROM extra GROUP BY source),
    filled AS (
      SELECT e.*, gap, CASE WHEN NOT x AND size > 0 AND abs(size - gap) < gap
             THEN row_number() OVER (PARTITION BY e.source, x, size > 0 ORDER BY abs(size - gap), h, doc_id, size) = 1
             ELSE false END AS filler
      FROM extra e JOIN gaps g ON e.source IS NOT DISTINCT FROM g.source),
    taken AS (
      SELECT *, CASE WHEN size = 0 THEN 0
                     ELSE CAST(passes AS BIGINT) + CASE WHEN x OR filler THEN 1 ELSE 0 END END AS takes,
             CASE WHEN filler AND passes = 0 THEN greatest(target - gap, 0.0) ELSE e - size END / nullif(target, 0) AS y,
             CASE w WHEN 1 THEN 1.5 WHEN 2 THEN 1.0 ELSE 0.5 END AS w0,
             CASE w WHEN 1 THEN -1.0 WHEN 2 THEN 0.0 ELSE 1.0 END AS slope
      FROM filled)
    SELECT doc_id, size, s AS source_size, target, CAST(takes * size AS BIGINT) AS taken, CAST(takes AS BIGINT) AS takes,
           CASE WHEN takes > 0 THEN
             round(least(greatest(2 * y / (w0 + sqrt(greatest(w0 * w0 + 2 * slope * y, 0.0))), 0.0), 1.0), 6)
           END AS first_position
    FROM taken
    """
)
def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(_table(spark, sf_dir, "documents"))
    return plan.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "takes",
        F.round("first_position", 6).alias("first_position"),
    ).orderBy("first_position", "doc_id")


@_query()
def op7_least_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), keep_ids=False)


@_query()
def op2_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.minhash_dedup(
        _table(spark, sf_dir, "documents"), words=3, percent=85, bands=26, rows=5
    ).drop("class_id")


@_query()
def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query()
def op5_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


@_query()
def op10_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


@_query()
def op3_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(_table(spark, sf_dir, "embeddings"))


@_query()
def op4_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"))


@_query()
def op9_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.near_passages(_table(spark, sf_dir, "documents"))


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@_query(
    f"""
    WITH d AS (SELECT * FROM (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents) WHERE len(ws) > 0),
    s AS (SELECT count(*) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM d),
    tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) GROUP BY ALL),
    w AS (SELECT term, CAST(floor(1000 * ln((2.0 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, n_docs),
    i AS (SELECT row_number() OVER () AS k, item_id, {_TERMS} AS ws FROM benchmark),
    q AS (SELECT k, item_id, term, count(*) AS c FROM (SELECT k, item_id, unnest(ws) AS term FROM i) GROUP BY ALL),
    scored AS (
      SELECT k, item_id, doc_id, r,
             CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(ws) * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN tf USING (term) JOIN d USING (r), s GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
    """
)
def op11_range_maximum_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _sql_leaf(n_chars: str) -> str:
    fields = ["doc_id", "source", "lang", n_chars, "text"]
    told = [f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields]
    return f"sha256({' || '.join(told)})"


#: CRC-32 of the decimal id, a bit at a time.
_SQL_CRC = """
    xor(4294967295, list_reduce(
      list_concat([4294967295], flatten([[ascii(c), 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')])),
      lambda x, y: CASE WHEN xor(x, y) % 2 = 1 THEN xor(xor(x, y) // 2, 3988292384) ELSE xor(x, y) // 2 END))
"""


@_query(
    f"""
    WITH RECURSIVE leaves AS MATERIALIZED (
      SELECT doc_id, lang, {_sql_leaf('n_chars')} AS leaf,
             CASE WHEN {_SQL_CRC} % 7 = 0 THEN {_sql_leaf('(n_chars + 1)')} END AS edited FROM documents),
    placed AS MATERIALIZED (
      SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
             row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM leaves),
    tree AS (
      SELECT g, 0 AS lvl, p, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM placed
      UNION ALL
      SELECT g, lvl + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), (any_value(n) + 1) // 2 FROM tree WHERE n > 1 GROUP BY g, lvl, p // 2),
    tops AS MATERIALIZED (SELECT g, max(lvl) AS height, arg_max(h, lvl) AS subroot FROM tree GROUP BY g),
    crown AS (
      SELECT 0 AS lvl, g AS p, subroot AS h, count(*) OVER () AS n FROM tops
      UNION ALL
      SELECT lvl + 1, p // 2, sha256(string_agg(h, '' ORDER BY p)), (any_value(n) + 1) // 2 FROM crown WHERE n > 1 GROUP BY lvl, p // 2),
    whole AS MATERIALIZED (SELECT max(lvl) AS height, arg_max(h, lvl) AS root FROM crown),
    nodes AS MATERIALIZED (
      SELECT g, lvl, p, h FROM tree WHERE n > 1
      UNION ALL
      SELECT t.g, t.height + c.lvl, c.p, c.h FROM crown c, tops t WHERE c.n > 1),
    way AS MATERIALIZED (
      SELECT l.g, l.p, s.lvl, CASE WHEN s.lvl < t.height THEN l.p >> s.lvl ELSE l.g >> (s.lvl - t.height) END AS spot
      FROM placed l JOIN tops t USING (g), whole w, range(0, 80) s(lvl) WHERE s.lvl < t.height + w.height),
    sides AS MATERIALIZED (
      SELECT way.g, way.p, way.lvl, spot % 2 AS is_right, h FROM way LEFT JOIN nodes n ON n.g = way.g AND n.lvl = way.lvl AND n.p = xor(spot, 1)),
    proofs AS (SELECT g, p, sha256(coalesce(string_agg(h, '' ORDER BY lvl), '')) AS proof_sha256 FROM sides GROUP BY g, p),
    fold AS (
      SELECT g, p, 0::BIGINT AS lvl, coalesce(edited, leaf) AS h FROM placed
      UNION ALL
      SELECT f.g, f.p, f.lvl + 1, CASE WHEN s.h IS NULL THEN sha256(f.h) WHEN is_right = 1 THEN sha256(s.h || f.h) ELSE sha256(f.h || s.h) END
      FROM fold f JOIN sides s ON s.g = f.g AND s.p = f.p AND s.lvl = f.lvl),
    ends AS (SELECT g, p, arg_max(h, lvl) AS folded_root FROM fold GROUP BY g, p)
    SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
    FROM placed JOIN tops USING (g) LEFT JOIN proofs USING (g, p) JOIN ends USING (g, p), whole
    """
)
def op12_path_copying_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the documents, with one version for each of those that are edited."""
    is_edited = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    edits = {"n_chars": F.when(is_edited, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    told = merkle.manifest(
        _table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], group="lang", order="doc_id", edits=edits
    )
    return told.select(
        "doc_id", *[F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")], "proof_sha256",
        F.lower(F.hex("folded_root")).alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@_query(
    f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce({_TERMS}, []) AS ws FROM documents),
    i AS (SELECT * FROM (SELECT item_id, {_TERMS} AS ws FROM benchmark) WHERE len(ws) > 0),
    iw AS MATERIALIZED (
      SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[k : k + least(10, len(ws)) - 1], ' ') AS w
      FROM (SELECT *, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS k FROM i)),
    dw AS (
      SELECT r, k, n, array_to_string(ws[k : k + n - 1], ' ') AS w
      FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
    hits AS MATERIALIZED (SELECT r, k, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.w = iw.w),
    covered AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS place FROM hits) GROUP BY r),
    owners AS (
      SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY r)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered USING (r) LEFT JOIN owners USING (r)
    """
)
def op13_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["begin"])
    return told.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
