"""Sentence splitting and chunking as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import WS, strip
from corpusloom.functions.tokens import portions

# White space that follows an end mark; looked back for only at white space.
SENTENCE_GAP = rf"{WS}(?<=[.!?]{WS}){WS}*"


def sentences(text: Column) -> Column:
    """Pieces between the white space that follows ``.``, ``!`` or ``?``."""
    stripped = strip(text)
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(
        F.split(stripped, SENTENCE_GAP)
    )


def _spans(lengths: list[int], max_length: int, overlap: int) -> list[tuple[int, int]]:
    """Greedy packing: (first sentence, one past the last) of each chunk, in time in proportion to the sentences."""
    spans, first, chars = [], 0, 0
    for i, length in enumerate(lengths):
        if i > first and chars + length > max_length:
            spans.append((first, i))
            # Trailing sentences that together fit the overlap come along.
            kept, at = 0, i
            while at > first and kept + lengths[at - 1] <= overlap:
                at -= 1
                kept += lengths[at]
            first, chars = at, kept
        chars += length
    if len(lengths) > first:
        spans.append((first, len(lengths)))
    return spans


# Sentences that become Python objects at a time.
_PORTION_SENTENCES = 1 << 14

_CHUNKS = "array<struct<text:string,length:int,sentence_count:int>>"


def sentence_chunks(text: Column, max_length: int = 512, overlap: int = 50) -> Column:
    """Array of (text, length, sentence_count), sentences kept whole.

    Sentences are split in the JVM and packed in portions of an Arrow batch.
    """

    def pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("length", pa.int32()), ("sentence_count", pa.int32())]))
        for part in (p for batch in batches for p in portions(batch, _PORTION_SENTENCES)):
            out = []
            for parts in part.to_pylist():
                if parts is None:
                    out.append(None)
                    continue
                chunks = []
                for first, end in _spans(list(map(len, parts)), max_length, overlap):
                    joined = " ".join(parts[first:end])
                    chunks.append({"text": joined, "length": len(joined), "sentence_count": end - first})
                out.append(chunks)
            yield pa.array(out, kind)

    return F.arrow_udf(pack, _CHUNKS)(sentences(text))


def character_pieces(text: Column, max_length: int = 512, overlap: int = 50) -> Column:
    """Array of windows of ``max_length`` characters, each ``overlap`` into the next.

    One regex pass: the look-ahead takes the window, the match itself moves on
    by the stride, so a long text costs time in proportion to its length.
    """
    if overlap < 0 or max_length <= overlap:
        raise ValueError("need 0 <= overlap < max_length")
    stride = max_length - overlap
    return F.regexp_extract_all(
        text, F.lit(rf"(?s)(?=(.{{1,{max_length}}})).{{1,{stride}}}"), F.lit(1)
    )
