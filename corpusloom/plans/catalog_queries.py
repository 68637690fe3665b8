"""Queries over the catalog: orders, parts and customers stand for registry rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import catalog as G
from corpusloom.plans.registry import query, table


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderpriority").alias("base_model"),
        F.col("o_totalprice").alias("score"),
    )


@query(
    """
    SELECT o_orderkey AS run_id, o_orderpriority AS base_model, o_totalprice AS score,
           (SELECT count(*) FROM orders WHERE o_orderpriority = '2-HIGH') AS total,
           (SELECT count(*) FROM orders WHERE o_orderpriority = '2-HIGH') > 60 AS has_more
    FROM orders WHERE o_orderpriority = '2-HIGH' ORDER BY o_orderkey LIMIT 20 OFFSET 40
    """
)
def list_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.page(_models(spark, sf_dir), "run_id", 20, 40, {"base_model": "2-HIGH"})


@query(
    """
    WITH n AS (SELECT count(*) AS total FROM orders)
    SELECT o_orderkey AS run_id, o_orderpriority AS base_model, o_totalprice AS score, total, total > 1420 AS has_more
    FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders), n WHERE r BETWEEN 1401 AND 1420
    """
)
def list_models_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page far behind the first: found over the keys, then read by their range."""
    return G.page(_models(spark, sf_dir), "run_id", 20, 1400)


@query(
    """
    SELECT o_orderkey AS run_id, o_orderpriority AS base_model, o_totalprice AS score,
           CAST(1 AS BIGINT) AS total, false AS has_more FROM orders WHERE o_orderkey = 7
    """
)
def get_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.page(_models(spark, sf_dir), "run_id", 1, 0, {"run_id": 7})


def _exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as exports of their order; the return flag picks the format."""
    items = table(spark, sf_dir, "lineitem")
    form = F.when(F.col("l_returnflag") == "A", "adapter").when(F.col("l_returnflag") == "R", "merged").otherwise("gguf")
    return items.select(
        F.col("l_orderkey").alias("run_id"), form.alias("format"),
        F.concat_ws("/", F.lit("exports"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("path"),
        F.col("l_shipdate").alias("created_at"),
    )


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with one old adapter export each."""
    old = F.struct(F.concat(F.lit("old/"), F.col("o_orderkey")).alias("path"), F.col("o_orderdate").alias("created_at"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.create_map(F.lit("adapter"), old).alias("exports")
    )


_LATEST = """
  (SELECT l_orderkey AS run_id, CASE l_returnflag WHEN 'A' THEN 'adapter' WHEN 'R' THEN 'merged' ELSE 'gguf' END AS format,
          first(p ORDER BY l_shipdate DESC, p DESC) AS path
   FROM (SELECT *, concat_ws('/', 'exports', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS p FROM lineitem)
   GROUP BY 1, 2)
"""
_ALL_EXPORTS = f"""
  (SELECT o_orderkey AS run_id, coalesce(n.format, 'adapter') AS format, coalesce(n.path, 'old/' || o_orderkey) AS path
   FROM orders LEFT JOIN {_LATEST} n ON n.run_id = o_orderkey AND n.format = 'adapter'
   UNION ALL
   SELECT n.run_id, n.format, n.path FROM {_LATEST} n JOIN orders ON o_orderkey = n.run_id WHERE n.format <> 'adapter')
"""


@query(f"SELECT run_id, format, path FROM {_ALL_EXPORTS}")
def add_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    updated = G.add_exports(_registry(spark, sf_dir), _exports(spark, sf_dir))
    return updated.select("run_id", F.explode("exports").alias("format", "export")).select(
        "run_id", "format", "export.path"
    )


@query(
    f"""
    SELECT run_id, max(path) FILTER (format = 'gguf') AS path, string_agg(format, ',' ORDER BY format) AS available
    FROM {_ALL_EXPORTS} GROUP BY run_id
    """
)
def export_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    updated = G.add_exports(_registry(spark, sf_dir), _exports(spark, sf_dir))
    return G.export_lookup(updated, "gguf")


@query(
    """
    SELECT l_orderkey AS run_id, count(*) AS n FROM lineitem
    WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY l_orderkey
    """
)
def unknown_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("run_id"))
    rejected = G.unknown_exports(known, _exports(spark, sf_dir))
    return rejected.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    key = F.concat(F.col("p_brand"), F.lit("--"), F.col("p_type"), F.lit("/shard-"), F.col("p_partkey"), F.lit(".bin"))
    return parts.select(key.alias("object_name"), (F.col("p_partkey") * 1000003).alias("size"))


_OBJECTS = "(SELECT p_brand || '--' || p_type AS prefix, p_partkey * 1000003 AS size FROM part)"


@query(
    f"""
    SELECT replace(prefix, '--', '/') AS model_id, 's3://models/' || prefix AS s3_path,
           CAST(sum(size) AS BIGINT) AS total_size, round(sum(size) / 1073741824.0, 2) AS size_gb,
           count(*) AS files_count FROM {_OBJECTS} GROUP BY prefix
    """
)
def cached_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cached_models(_objects(spark, sf_dir))


@query(
    f"""
    SELECT CAST(sum(size) AS BIGINT) AS total_size, count(*) > 0 AS is_cached
    FROM {_OBJECTS} WHERE starts_with(prefix, 'Brand#4--SMALL')
    """
)
def cached_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cached_size(_objects(spark, sf_dir), "Brand#4/SMALL")


@query(
    """
    SELECT id, downloads, likes, split_part(id, '/', 2) AS name, split_part(id, '/', 1) AS author
    FROM (SELECT p_brand || '/' || p_name || '-' || p_partkey AS id, p_type, p_size AS likes,
                 coalesce(q, 0) AS downloads
          FROM part LEFT JOIN (SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY l_partkey)
            ON l_partkey = p_partkey)
    WHERE contains(lower(id), 'ring') AND p_type = 'SMALL' ORDER BY downloads DESC, id LIMIT 20
    """
)
def search_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as published models; downloads are the quantities sold."""
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.sum("l_quantity").cast("bigint").alias("downloads")
    )
    models = table(spark, sf_dir, "part").join(sold, "p_partkey", "left").select(
        F.concat("p_brand", F.lit("/"), "p_name", F.lit("-"), "p_partkey").alias("id"),
        F.coalesce("downloads", F.lit(0)).alias("downloads"),
        F.col("p_size").alias("likes"),
        F.array("p_type", "p_brand").alias("tags"),
    )
    return G.search_models(models, "RING", ["SMALL"], 20).drop("tags")


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    tags = F.when(F.col("c_acctbal") < 0, "").otherwise(F.concat_ws(",", "c_mktsegment", "c_nationkey"))
    return customers.select(
        F.col("c_custkey").alias("project_id"), F.col("c_name").alias("project_name"), tags.alias("tags"),
        F.lit("2024-01-01T00:00:00").alias("updated_at"),
    )


@query(
    """
    SELECT c_custkey AS project_id, c_name AS project_name,
           CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment || '|' || c_nationkey END AS tags,
           CASE WHEN c_acctbal < 0 THEN 0 ELSE 2 END AS n_tags
    FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 50
    """
)
def list_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.list_projects(_projects(spark, sf_dir), 50, 50)
    return rows.select(
        "project_id", "project_name", F.array_join("tags", "|").alias("tags"), F.size("tags").alias("n_tags")
    )


@query(
    """
    SELECT c_custkey AS project_id, coalesce(j.n, 0) AS job_count, coalesce(d.n, 0) AS dataset_count
    FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) j ON j.o_custkey = c_custkey
    LEFT JOIN (SELECT o_custkey, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey) d
      ON d.o_custkey = c_custkey
    """
)
def project_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("project_id"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    counted = G.project_counts(
        _projects(spark, sf_dir), {"job_count": orders, "dataset_count": items.join(orders, "o_orderkey")}
    )
    return counted.select("project_id", "job_count", "dataset_count")


@query(
    """
    WITH last AS (SELECT o_custkey, arg_max(o_orderpriority, row(o_orderdate, o_orderkey)) AS tag,
                         arg_max(o_orderstatus, row(o_orderdate, o_orderkey)) AS st FROM orders GROUP BY o_custkey)
    SELECT c_custkey AS project_id, coalesce(CASE WHEN st = 'F' THEN c_name || ' (done)' END, c_name) AS project_name,
           coalesce(tag, CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment || ',' || c_nationkey END) AS tags,
           CASE WHEN o_custkey IS NOT NULL THEN '2025-01-01T00:00:00' ELSE '2024-01-01T00:00:00' END AS updated_at
    FROM customer LEFT JOIN last ON o_custkey = c_custkey
    """
)
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of a customer changes its tags, and its name if the order is done."""
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("project_id")).agg(
        F.max_by(F.struct("o_orderpriority", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("o")
    )
    projects = _projects(spark, sf_dir)
    changes = last.join(projects.select("project_id", "project_name"), "project_id").select(
        "project_id",
        F.when(F.col("o.o_orderstatus") == "F", F.concat("project_name", F.lit(" (done)"))).alias("project_name"),
        F.col("o.o_orderpriority").alias("tags"),
    )
    return G.partial_update(
        projects, changes, "project_id", ["project_name", "tags"], F.lit("2025-01-01T00:00:00")
    )


@query(
    """
    SELECT c_custkey AS project_id, c_name AS project_name FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
    """
)
def delete_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("project_id"))
    return G.remove_rows(_projects(spark, sf_dir), gone, "project_id").select("project_id", "project_name")
