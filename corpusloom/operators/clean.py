"""Cleaning the text column of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import clean_text
from corpusloom.operators.profile import MISSING_AS_TEXT

NULL_POLICIES = ("drop", "keep", "literal")


def clean_column(
    df: DataFrame, text: str, aggressive: bool = False, null_policy: str = "literal"
) -> DataFrame:
    """Clean ``text`` in place.

    ``null_policy``: ``literal`` turns a missing text into the word the original
    tool leaves (``nan``), ``drop`` removes the row, ``keep`` leaves it missing.
    """
    if null_policy not in NULL_POLICIES:
        raise ValueError(f"null_policy must be one of {NULL_POLICIES}")
    value = F.col(text).cast("string")
    if null_policy == "drop":
        df = df.where(F.col(text).isNotNull())
    elif null_policy == "literal":
        value = F.coalesce(value, F.lit(MISSING_AS_TEXT))
    return df.withColumn(text, clean_text(value, aggressive))
