"""Writing processed datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame


def save_jsonl(df: DataFrame, base: str, run_id: str) -> str:
    """Write one JSON object per line below ``base/run_id``, nulls included; returns the path.

    The dataset is a folder of part files, one per task.
    """
    path = f"{base.rstrip('/')}/{run_id}/processed_dataset.jsonl"
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path
