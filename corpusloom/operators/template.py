"""Applying a prompt template to a dataset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.templates import chatml_turn, prompt

OUTPUT_COLUMN = "text"


def apply_template(
    df: DataFrame, name: str, mapping: Mapping[str, str], keep: Sequence[str] = ()
) -> DataFrame:
    """The formatted prompt as column ``text``; of the old columns only ``keep`` stays."""
    formatted = prompt(df, name, mapping)
    return df.select(*[c for c in keep if c != OUTPUT_COLUMN], formatted.alias(OUTPUT_COLUMN))


def conversation_to_chatml(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conversation, turns, text): every whole conversation as one prompt, its turns in order.

    A missing role or text reads as empty. One conversation becomes one row.
    """
    part = F.struct(
        F.col(turn).alias("turn"),
        chatml_turn(F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))).alias("said"),
    )
    turns = F.array_sort(F.collect_list(part))
    return df.groupBy(conversation).agg(
        F.count(F.lit(1)).alias("turns"), F.array_join(F.transform(turns, lambda t: t["said"]), "\n").alias("text")
    )
