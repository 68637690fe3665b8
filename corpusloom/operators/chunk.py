"""Chunking: one output row per chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.chunks import character_pieces, sentence_chunks, sentences


def split_sentences(df: DataFrame, text: str) -> DataFrame:
    """One row per sentence, ``text`` replaced by it; adds ``sentence_id``."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(sentences(F.col(text))).alias("sentence_id", text))


def chunk_dataset(
    df: DataFrame,
    text: str,
    max_length: int = 512,
    overlap: int = 50,
    preserve_sentences: bool = True,
    details: bool = False,
) -> DataFrame:
    """One row per chunk with ``text`` replaced and the other columns repeated.

    A text without a sentence gives no row. ``details`` adds chunk_id, length
    and sentence_count, or start_pos and end_pos in character mode. Chunks are
    built inside one array per row, so the explode copies only the other
    columns, not the document.
    """
    others = [c for c in df.columns if c != text]
    if preserve_sentences:
        chunks = sentence_chunks(F.col(text), max_length, overlap)
        rows = df.select(*others, F.posexplode(chunks).alias("chunk_id", "__chunk"))
        extra = [F.col("__chunk.length").alias("length"), F.col("__chunk.sentence_count").alias("sentence_count")]
        body = F.col("__chunk.text").alias(text)
    else:
        pieces = character_pieces(F.col(text), max_length, overlap)
        rows = df.select(*others, F.posexplode(pieces).alias("chunk_id", "__chunk"))
        start = F.col("chunk_id") * (max_length - overlap)
        extra = [
            F.length("__chunk").alias("length"),
            start.alias("start_pos"),
            (start + max_length).alias("end_pos"),
        ]
        body = F.col("__chunk").alias(text)
    return rows.select(*others, body, *(["chunk_id", *extra] if details else []))
