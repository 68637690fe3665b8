"""Loading dataset files as tables."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File suffixes and the words that mean a missing CSV value.
FORMAT_OF_SUFFIX = {".csv": "csv", ".json": "json", ".jsonl": "jsonl", ".txt": "txt", ".parquet": "parquet"}
MISSING_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def infer_format(path: str) -> str:
    """Format by suffix, case ignored; anything unknown is text."""
    return FORMAT_OF_SUFFIX.get(PurePosixPath(path.rstrip("/")).suffix.lower(), "txt")


def resolve_uri(path: str, buckets: Mapping[str, str] | None = None) -> str:
    """Replace the bucket alias of ``s3://alias/key`` by the URI it stands for.

    The reader then opens the object in place; nothing is copied first. Paths
    without a known alias are returned as they are.
    """
    scheme = "s3://"
    if not path.startswith(scheme):
        return path
    alias, _, key = path[len(scheme):].partition("/")
    base = (buckets or {}).get(alias)
    return path if base is None else f"{base.rstrip('/')}/{key}"


def load(
    spark: SparkSession,
    path: str,
    file_format: str | None = None,
    schema: T.StructType | str | None = None,
    buckets: Mapping[str, str] | None = None,
    multiline: bool = False,
) -> DataFrame:
    """Read a dataset; the suffix decides the format if none is given.

    ``schema`` saves the inference pass over CSV and JSON and should be given
    for large inputs. CSV files split over tasks; data with line breaks inside quotes
    needs ``multiline=True``, which reads a file in one task. JSON Lines always splits.
    """
    kind = file_format or infer_format(path)
    uri = resolve_uri(path, buckets)
    if kind == "parquet":
        return spark.read.parquet(uri)
    if kind == "txt":
        return spark.read.text(uri).withColumnRenamed("value", "text")
    if kind in ("json", "jsonl"):
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.option("multiLine", kind == "json").json(uri)
    if kind == "csv":
        return _load_csv(spark, uri, schema, multiline)
    raise ValueError(f"unsupported format: {kind}")


def _load_csv(spark: SparkSession, uri: str, schema: T.StructType | str | None, multiline: bool) -> DataFrame:
    raw = (
        spark.read.option("header", True)
        .option("multiLine", multiline)
        .option("quote", '"')
        .option("escape", '"')
        .option("inferSchema", False)
        .csv(uri)
    )

    def present(name: str) -> Column:
        value = F.col(f"`{name}`")
        return F.when(~value.isin(MISSING_WORDS), value)

    text = raw.select(*[present(c).alias(c) for c in raw.columns])
    if schema is None:
        types = _inferred_types(text)
    else:
        struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        types = {field.name: field.dataType.simpleString() for field in struct}
    return text.select(*[_typed(name, types.get(name, "string")) for name in text.columns])


def _typed(name: str, dtype: str) -> Column:
    value = F.col(f"`{name}`")
    if dtype == "string":
        return value
    return (F.trim(value) if dtype != "boolean" else value).cast(dtype).alias(name)


def _inferred_types(text: DataFrame) -> dict[str, str]:
    """Narrowest of bigint, double, boolean that reads every present value, else string.

    One aggregate over the file; the driver receives four counters per column.
    """
    checks = []
    for name in text.columns:
        value = F.col(f"`{name}`")
        trimmed = F.trim(value)
        # Letters other than an exponent (Java's ``1d``, ``1f``) do not make a number here.
        numeric = trimmed.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") | F.lower(trimmed).isin(
            "inf", "+inf", "-inf", "infinity", "-infinity"
        )
        whole = trimmed.rlike(r"^[+-]?\d+$") & trimmed.try_cast("bigint").isNotNull()
        checks.append(
            F.struct(
                F.count(value).alias("present"),
                F.count_if(whole).alias("bigint"),
                F.count_if(numeric).alias("double"),
                F.count_if(value.isin("True", "TRUE", "true", "False", "FALSE", "false")).alias("boolean"),
            ).alias(name)
        )
    counts = text.agg(*checks).first()
    types = {}
    for name in text.columns:
        seen = counts[name]
        fitting = [t for t in ("bigint", "double", "boolean") if seen["present"] and seen[t] == seen["present"]]
        types[name] = fitting[0] if fitting else "string"
    return types


def file_inventory(spark: SparkSession, path: str, prefix: str = "", buckets: Mapping[str, str] | None = None) -> DataFrame:
    """(path, size, modified) of the files below ``path`` whose key starts with ``prefix``; contents are not read."""
    base = resolve_uri(path, buckets).rstrip("/")
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(base)
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    )
    if not prefix:
        return files
    # Listed paths carry a scheme that the given one may lack.
    root = base.split("://")[-1].removeprefix("file:")
    return files.where(F.contains(F.col("path"), F.lit(f"{root}/{prefix.lstrip('/')}")))
