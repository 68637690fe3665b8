"""Token counts and fixed-length training rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.tokens import decoded_text, portions, token_count, token_ids
from corpusloom.operators.positions import free_name, with_positions
from corpusloom.session import through_table

IGNORED_LABEL = -100


def count_tokens(
    df: DataFrame, text: str, vocabulary: str | None = None, special_tokens: bool = False
) -> DataFrame:
    """Add ``token_count``."""
    return df.withColumn("token_count", token_count(F.col(text), vocabulary, special_tokens))


def token_stats(df: DataFrame, counts: str = "token_count", by: Sequence[str] = ()) -> DataFrame:
    """Average (two decimals), least and most tokens; an empty table gives zeros."""
    value = F.coalesce(F.col(counts), F.lit(0)).cast("bigint")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.coalesce(F.round(F.avg(value), 2), F.lit(0.0)).alias("avg_tokens"),
        F.coalesce(F.min(value), F.lit(0)).alias("min_tokens"),
        F.coalesce(F.max(value), F.lit(0)).alias("max_tokens"),
    )


def _padded(ids: Column, length: Column, pad_id: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad_id), length - F.size(ids)))


def _mask(real: Column, length: Column) -> Column:
    return F.concat(
        F.array_repeat(F.lit(1), real), F.array_repeat(F.lit(0), length - real)
    )


def tokenize(
    df: DataFrame,
    text: str,
    max_length: int | None = None,
    padding: bool = False,
    pad_id: int = 0,
    vocabulary: str | None = None,
    special_tokens: bool = False,
) -> DataFrame:
    """Add input_ids, attention_mask and token_count; cut to ``max_length``, pad if asked."""
    if padding and max_length is None:
        raise ValueError("padding to a fixed length needs max_length")
    encoded = df.withColumn("input_ids", token_ids(F.col(text), vocabulary, special_tokens))
    if max_length is not None:
        encoded = encoded.withColumn("input_ids", F.slice("input_ids", 1, max_length))
    ids, real = F.col("input_ids"), F.size("input_ids")
    length = F.lit(max_length) if padding else real
    return encoded.select(
        *[c for c in df.columns if c not in ("input_ids", "attention_mask", "token_count")],
        (_padded(ids, length, pad_id) if padding else ids).alias("input_ids"),
        _mask(real, length).alias("attention_mask"),
        length.alias("token_count"),
    )


def token_windows(
    df: DataFrame, text: str, max_length: int, padding: bool = False, pad_id: int = 0,
    vocabulary: str | None = None, special_tokens: bool = False,
) -> DataFrame:
    """Like :func:`tokenize`, but a long text becomes several rows, numbered by ``window``: no id is lost.

    A text without ids is one empty window.
    """
    others = [c for c in df.columns if c not in _WINDOW_COLUMNS]
    encoded = df.select(*others, token_ids(F.col(text), vocabulary, special_tokens).alias("input_ids"))
    return cut_windows(encoded, "input_ids", max_length, padding, pad_id)


_WINDOW_COLUMNS = ("window", "input_ids", "attention_mask", "token_count")


def cut_windows(df: DataFrame, ids: str, max_length: int, padding: bool = False, pad_id: int = 0) -> DataFrame:
    """Consecutive windows of a column of id lists: rows (…, window, ids, attention_mask, token_count).

    No id is lost or repeated; a row without ids is one empty window. With
    ``padding`` every window is as long as ``max_length``.
    """
    if max_length < 1:
        raise ValueError("max_length must be at least 1")
    others = [c for c in df.columns if c not in (*_WINDOW_COLUMNS, ids)]
    last = F.greatest(F.ceil(F.size(ids) / F.lit(max_length)).cast("int"), F.lit(1)) - 1
    # All windows of a row at once: a row per window beside the whole list would cost the square of a text's length.
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.struct(k.alias("window"), F.slice(F.col(ids), k * max_length + 1, max_length).alias(ids)),
    )
    cut = df.select(*others, F.inline(windows))
    real = F.size(ids)
    length = F.lit(max_length) if padding else real
    return cut.select(
        *others,
        "window",
        (_padded(F.col(ids), length, pad_id) if padding else F.col(ids)).alias(ids),
        _mask(real, length).alias("attention_mask"),
        length.alias("token_count"),
    )


def byte_ids(text: Column) -> Column:
    """One id per UTF-8 byte, the byte + 1, so that 0 is free for padding; null has none."""

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in portions(batch):
                ends = np.cumsum(pc.binary_length(part).to_numpy(zero_copy_only=False), dtype=np.int32)
                data = np.frombuffer(b"".join(part.to_pylist()), np.uint8)
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                yield pa.ListArray.from_arrays(offsets, pa.array(data.astype(np.int32) + 1))

    return ids(F.coalesce(text, F.lit("")).cast("binary"))


def truncation_stats(df: DataFrame, max_length: int, counts: str = "token_count", by: Sequence[str] = ()) -> DataFrame:
    """What a cut at ``max_length`` would take: rows, truncated_rows, tokens, lost_tokens."""
    n = F.coalesce(F.col(counts), F.lit(0)).cast("bigint")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(n > max_length).alias("truncated_rows"),
        F.coalesce(F.sum(n), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.greatest(n - max_length, F.lit(0))), F.lit(0)).alias("lost_tokens"),
    )


def batch_rows(
    df: DataFrame, ids: str, order_by: Sequence[str] | str, batch_size: int = 64, padding: bool = True, pad_id: int = 0
) -> DataFrame:
    """Batches of neighbouring rows in the order of ``order_by``, each padded to its own longest row.

    Works on any column of id lists. Rows are numbered by a distributed sort
    (:func:`corpusloom.operators.positions.with_positions`), so a batch holds
    ``batch_size`` rows however the order's values are spread, and no far value
    makes one task larger. Adds batch_id, true_tokens (before padding),
    token_count (after) and attention_mask.
    """
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    place = free_name(df, "place")
    ranked = with_positions(df, order, position=place)
    numbered = ranked.withColumn("batch_id", F.floor(F.col(place) / F.lit(batch_size))).drop(place)
    numbered = numbered.withColumn("true_tokens", F.size(ids))
    longest = F.max("true_tokens").over(Window.partitionBy("batch_id")) if padding else F.col("true_tokens")
    sized = numbered.withColumn("token_count", longest)
    return sized.withColumn("attention_mask", _mask(F.col("true_tokens"), F.col("token_count"))).withColumn(
        ids, _padded(F.col(ids), F.col("token_count"), pad_id)
    )


def tokenize_batches(
    df: DataFrame,
    text: str,
    id_col: str,
    batch_size: int = 64,
    max_length: int | None = None,
    padding: bool = True,
    pad_id: int = 0,
    vocabulary: str | None = None,
    special_tokens: bool = False,
) -> DataFrame:
    """Tokenize in batches of neighbouring ids, each padded to its own longest row.

    See :func:`batch_rows`. ``token_count`` is the length after padding,
    ``true_tokens`` the one before.
    """
    encoded = tokenize(df, text, max_length=max_length, vocabulary=vocabulary, special_tokens=special_tokens)
    # Encoded once: sampling the sort's splitters reads the written ids again, not the tokenizer.
    encoded = through_table(encoded.drop("attention_mask", "token_count"), "encoded")
    return batch_rows(encoded, "input_ids", id_col, batch_size, padding, pad_id)


def causal_labels(df: DataFrame, pad_id: int, ids: str = "input_ids") -> DataFrame:
    """Add ``labels``: the ids themselves, with padding marked to be ignored."""
    labels = F.transform(ids, lambda i: F.when(i == pad_id, F.lit(IGNORED_LABEL)).otherwise(i))
    return df.withColumn("labels", labels)


def decode_tokens(
    df: DataFrame, ids: str = "input_ids", alias: str = "decoded", vocabulary: str | None = None
) -> DataFrame:
    return df.withColumn(alias, decoded_text(F.col(ids), vocabulary))


def round_trip_audit(df: DataFrame, text: str, vocabulary: str | None = None) -> DataFrame:
    """Rows, tokens, and rows whose text does not survive encoding and decoding."""
    encoded = df.select(F.col(text), token_ids(F.col(text), vocabulary).alias("input_ids"))
    decoded = decode_tokens(encoded, vocabulary=vocabulary)
    return decoded.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.size("input_ids")).alias("tokens"),
        F.count_if(F.col("decoded") != F.col(text)).alias("changed"),
    )
