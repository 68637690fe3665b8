"""Model, cache and project tables: filters, pages, group sums, upserts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.positions import with_positions

MAX_PAGE = 100
EXPORT_FORMATS = ("adapter", "merged", "gguf")


def page(
    df: DataFrame,
    order_by: str,
    limit: int = 20,
    offset: int = 0,
    where: Mapping[str, object] | None = None,
) -> DataFrame:
    """One page of the rows that equal ``where``, with total and has_more on each row.

    A page within the first ``NEAR`` rows is a top-k, not a sort of the table; a
    deeper one comes from :func:`rows_from`, so no task holds the rows before it.
    The total is a scalar subquery over the same filter.
    """
    if not 0 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"need 0 <= limit <= {MAX_PAGE} and offset >= 0")
    for column, value in (where or {}).items():
        df = df.where(F.col(column) == F.lit(value))
    total = df.agg(F.count(F.lit(1))).scalar()
    rows = rows_from(df, order_by, limit, offset)
    return rows.withColumn("total", total).withColumn("has_more", F.col("total") > offset + limit)


#: Pages that end within so many rows are taken by top-k.
NEAR = 1_000


def rows_from(df: DataFrame, order_by: str, limit: int, offset: int) -> DataFrame:
    """The rows ``offset`` to ``offset + limit`` in the order of ``order_by``.

    A deep page is found over the sort keys alone: they are range-sorted, counts
    per range tell the range in which the page begins, and the rows between the
    keys at its two ends are read from the table, where the bounds are pushed to
    the scan.
    """
    if offset + limit <= NEAR:
        return df.orderBy(order_by).offset(offset).limit(limit)
    keys = with_positions(df.select(F.col(order_by).alias("key")), ["key"])
    on_page = keys.where(F.col("position").between(offset, offset + limit - 1))
    # Rows that tie with the first key but stand before the page are skipped.
    found = on_page.agg(F.min("key"), F.max("key"), F.count_if(F.col("key").isNull()), F.count(F.lit(1)), F.min("position")).first()
    low, high, nulls, n, start = found
    if not n:
        return df.limit(0)
    column = F.col(order_by)
    inside = F.lit(False) if low is None else column.between(F.lit(low), F.lit(high))
    before = keys.where(F.col("key").isNull() if nulls else F.col("key") == F.lit(low)).agg(F.min("position")).first()[0]
    rows = df.where((inside | column.isNull()) if nulls else inside)
    return rows.orderBy(order_by).offset(start - before).limit(limit)


def preview(df: DataFrame, order_by: str, limit: int = 10) -> DataFrame:
    """First rows with the size of the whole table; more than ``MAX_PAGE`` rows are refused."""
    if not 0 <= limit <= MAX_PAGE:
        raise ValueError(f"need 0 <= limit <= {MAX_PAGE}")
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.orderBy(order_by).limit(limit).withColumn("total", total)


def head_sample(df: DataFrame, order_by: str, n: int = 20) -> DataFrame:
    return df.orderBy(order_by).limit(n)


def add_exports(registry: DataFrame, exports: DataFrame) -> DataFrame:
    """Upsert exports into the registry's map; the latest per (run, format) wins.

    ``registry``: run_id, exports map<string, struct<path, created_at>>;
    ``exports``: run_id, format, path, created_at. Exports are reduced to one
    row per run before the join, so a busy run moves no more than its formats.
    A run the registry lacks is an error in a request; here its rows are the
    result of :func:`unknown_exports`.
    """
    latest = (
        exports.groupBy("run_id", "format")
        .agg(F.max(F.struct("created_at", "path")).alias("last"))
        .select("run_id", "format", F.struct("last.path", "last.created_at").alias("export"))
    )
    # Bounded group: one entry per export format.
    per_run = latest.groupBy("run_id").agg(
        F.map_from_entries(F.collect_list(F.struct("format", "export"))).alias("__new")
    )
    nothing = F.map_from_entries(F.array().cast("array<struct<k:string,v:struct<path:string,created_at:timestamp>>>"))
    old = F.coalesce(F.col("exports"), nothing)
    new = F.coalesce(F.col("__new"), nothing)
    untouched = F.map_filter(old, lambda name, _: ~F.map_contains_key(new, name))
    merged = F.map_concat(untouched, new)
    return registry.join(per_run, "run_id", "left").withColumn("exports", merged).drop("__new")


def unknown_exports(registry: DataFrame, exports: DataFrame) -> DataFrame:
    return exports.join(registry.select("run_id"), "run_id", "left_anti")


def export_lookup(registry: DataFrame, export_format: str) -> DataFrame:
    """Path of the format where a run has it, and the formats it does have."""
    return registry.select(
        "run_id",
        F.try_element_at("exports", F.lit(export_format))["path"].alias("path"),
        F.array_join(F.array_sort(F.map_keys("exports")), ",").alias("available"),
    )


def cached_models(objects: DataFrame, key: str = "object_name", size: str = "size", bucket: str = "models") -> DataFrame:
    """Objects grouped by the first part of their key: bytes, GiB and file count."""
    prefix = F.substring_index(key, "/", 1)
    sums = objects.groupBy(prefix.alias("prefix")).agg(
        F.sum(size).alias("total_size"), F.count(F.lit(1)).alias("files_count")
    )
    return sums.select(
        F.replace(F.col("prefix"), F.lit("--"), F.lit("/")).alias("model_id"),
        F.concat(F.lit(f"s3://{bucket}/"), F.col("prefix")).alias("s3_path"),
        "total_size",
        F.round(F.col("total_size") / F.lit(1024**3), 2).alias("size_gb"),
        "files_count",
    )


def cached_size(objects: DataFrame, model_id: str, key: str = "object_name", size: str = "size") -> DataFrame:
    """Bytes cached for one model (null if none) and whether it is cached."""
    mine = objects.where(F.startswith(F.col(key), F.lit(model_id.replace("/", "--"))))
    return mine.agg(
        F.nullif(F.sum(size), F.lit(0)).alias("total_size"),
        (F.count(F.lit(1)) > 0).alias("is_cached"),
    )


def search_models(
    models: DataFrame, query: str, tags: Sequence[str] = (), limit: int = 20, id_col: str = "id"
) -> DataFrame:
    """Models whose id contains the query and that carry all tags, most downloads first."""
    found = models.where(F.contains(F.lower(id_col), F.lit(query.lower())))
    for tag in tags:
        found = found.where(F.array_contains("tags", tag))
    scoped = F.contains(F.col(id_col), F.lit("/"))
    return (
        found.orderBy(F.desc("downloads"), id_col)
        .limit(limit)
        .withColumn("name", F.when(scoped, F.substring_index(id_col, "/", -1)).otherwise(F.col(id_col)))
        .withColumn("author", F.when(scoped, F.substring_index(id_col, "/", 1)).otherwise(F.lit("unknown")))
    )


def list_projects(projects: DataFrame, limit: int = 50, offset: int = 0, order_by: str = "project_id") -> DataFrame:
    """A page of projects; comma text becomes a list, empty text an empty list."""
    tags = F.when(F.coalesce(F.col("tags"), F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split("tags", ",")
    )
    return rows_from(projects, order_by, limit, offset).withColumn("tags", tags)


def project_counts(projects: DataFrame, members: Mapping[str, DataFrame], id_col: str = "project_id") -> DataFrame:
    """Add one count per member table. Members are counted first, then joined."""
    out = projects
    for name, table in members.items():
        counts = table.groupBy(id_col).agg(F.count(F.lit(1)).alias(name))
        out = out.join(counts, id_col, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    return out


def partial_update(
    table: DataFrame, changes: DataFrame, id_col: str, fields: Sequence[str], now: Column
) -> DataFrame:
    """Set the non-null fields of ``changes`` (one row per id) and stamp updated_at.

    Rows without a change keep everything, the stamp included.
    """
    renamed = changes.select(
        id_col, *[F.col(f).alias(f"__{f}") for f in fields], F.lit(True).alias("__changed")
    )
    joined = table.join(renamed, id_col, "left")
    updates = {f: F.coalesce(F.col(f"__{f}"), F.col(f)) for f in fields}
    updates["updated_at"] = F.when(F.col("__changed"), now).otherwise(F.col("updated_at"))
    return joined.withColumns(updates).select(*table.columns)


def remove_rows(table: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id is not listed (deleting projects, runs or streams)."""
    return table.join(ids.select(id_col), id_col, "left_anti")
