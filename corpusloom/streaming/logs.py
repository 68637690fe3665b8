"""Log streams with Structured Streaming: publishing, consuming, live state.

The checkpoint holds the reader's position, so a restarted consumer goes on
where it stopped. Append results go straight to files; of an aggregate, the rows
that a micro-batch changes are written to a folder of its own, which a repeated
batch overwrites with the same rows. Nothing passes through the driver.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from corpusloom.session import scratch_path


def read_events(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    file_format: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Streaming table over a folder (or glob) of event files."""
    reader = spark.readStream.format(file_format).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def publish(
    records: DataFrame, path: str, checkpoint: str, file_format: str = "json", available_now: bool = True
) -> StreamingQuery:
    """Append the records of a stream to a folder of files, exactly once."""
    writer = (
        records.writeStream.format(file_format)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def append_result(stream: DataFrame, label: str, root: str | None = None) -> DataFrame:
    """Run over what is there now in append mode; all rows appended so far as a table.

    ``root`` holds rows and position: a later call with the same folder goes on
    where the earlier one stopped. Without it, a new folder is used.
    """
    spark = stream.sparkSession
    root = root or scratch_path(spark, label)
    publish(stream, os.path.join(root, "rows"), os.path.join(root, "state"), "parquet").awaitTermination()
    return spark.read.schema(stream.schema).parquet(os.path.join(root, "rows"))


def _committed(spark: SparkSession, path: str) -> int:
    """The number in a one-row table, -1 if there is none yet."""
    try:
        return spark.read.parquet(path).first().id
    except AnalysisException:
        return -1


def live_result(
    parts: DataFrame, keys: Sequence[str], label: str, root: str | None = None, compact_every: int = 50
) -> DataFrame:
    """Run an aggregate over what is there now in update mode; the current row of every key as a table.

    A micro-batch writes only the rows that it changed, to a folder of its own
    that a repeated batch overwrites; the row of the latest batch counts. Every
    ``compact_every`` batches the current rows become a new base table, and older
    folders are not read any more. With ``root`` a later call goes on where the
    earlier one stopped.
    """
    spark = parts.sparkSession
    root = root or scratch_path(spark, label)
    changes, marker = os.path.join(root, "changes"), os.path.join(root, "base-number")
    schema = T.StructType([*parts.schema.fields, T.StructField("batch", T.LongType())])

    def current(upto: int | None = None) -> DataFrame:
        base = _committed(spark, marker)
        try:
            rows = spark.read.schema(schema).parquet(changes).where(F.col("batch") > base)
        except AnalysisException:  # no micro-batch so far
            rows = spark.createDataFrame([], schema)
        if upto is not None:
            rows = rows.where(F.col("batch") <= upto)
        if base >= 0:
            rows = rows.unionByName(spark.read.schema(schema).parquet(os.path.join(root, f"base-{base}")))
        others = [f.name for f in parts.schema.fields if f.name not in keys]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("last"), F.max("batch").alias("batch"))
        return last.select(*keys, *[F.col("last").getField(n).alias(n) for n in others], "batch")

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(os.path.join(changes, f"batch={batch_id}"))
        if batch_id - _committed(spark, marker) >= compact_every:
            current(batch_id).write.mode("overwrite").parquet(os.path.join(root, f"base-{batch_id}"))
            spark.range(batch_id, batch_id + 1).coalesce(1).write.mode("overwrite").parquet(marker)

    query = (
        parts.writeStream.outputMode("update")
        .option("checkpointLocation", os.path.join(root, "state"))
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return current().select(*parts.columns)


def replay(slices: Iterable[DataFrame], folder: str, follow: Callable[[], DataFrame]) -> DataFrame:
    """Deliver ``slices`` to a folder one after the other, each followed by a call of ``follow``, which resumes.

    The result is what the last call gave.
    """
    out = None
    for rows in slices:
        rows.write.mode("append").parquet(folder)
        out = follow()
    return out


def snapshot_result(stream: DataFrame, label: str, root: str | None = None) -> DataFrame:
    """Run an aggregate over what is there now; its full state as a table.

    Two folders take turns, so the last whole snapshot stays while the next one
    is written, and a long stream does not pile up old ones. With ``root``, a
    later call goes on where the earlier one stopped, and returns the last
    snapshot if nothing is new.
    """
    spark = stream.sparkSession
    root = root or scratch_path(spark, label)
    last = os.path.join(root, "last")

    def write(state: DataFrame, batch_id: int) -> None:
        state.write.mode("overwrite").parquet(os.path.join(root, f"snapshot-{batch_id % 2}"))
        spark.range(batch_id, batch_id + 1).coalesce(1).write.mode("overwrite").parquet(last)

    query = (
        stream.writeStream.outputMode("complete")
        .option("checkpointLocation", os.path.join(root, "state"))
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    try:
        batch_id = spark.read.parquet(last).first().id
    except AnalysisException:  # no micro-batch so far
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(os.path.join(root, f"snapshot-{batch_id % 2}"))
