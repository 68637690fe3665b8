"""Sub-word tokenizers inside Arrow batches.

A tokenizer is named by its vocabulary file; the suffix picks the library:
``.json`` (tokenizers), ``.tiktoken`` (rank file) or ``.model`` (sentencepiece).
The file must be readable by every executor: a shared path, a package resource,
or one shipped with ``spark.sparkContext.addFile``. Each Python worker loads it
once and keeps it.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how rank-file vocabularies split text before their merges.
RANK_FILE_PATTERN = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)


@dataclass(frozen=True)
class Codec:
    """The two directions, batch-wise, as plain functions."""

    encode: Callable[[list[str]], Iterable[list[int]]]
    decode: Callable[[list[list[int]]], list[str]]


def default_vocabulary() -> str:
    """Vocabulary used when the caller names none (a packaged public one)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _local(path: str) -> str:
    if os.path.exists(path):
        return path
    from pyspark import SparkFiles

    return SparkFiles.get(os.path.basename(path))


@lru_cache(maxsize=8)
def codec(vocabulary: str, special_tokens: bool = False) -> Codec:
    path = _local(vocabulary)
    if path.endswith(".tiktoken"):
        if special_tokens:
            raise ValueError("a rank file has no special tokens")
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        ranked = tiktoken.Encoding(
            "ranks", pat_str=RANK_FILE_PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        known = len(ranks)

        def decode(batch: list[list[int]]) -> list[str]:
            return [ranked.decode([i for i in ids if i < known]) for ids in batch]

        return Codec(lambda texts: (ranked.encode_ordinary(t) for t in texts), decode)
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return Codec(
            lambda texts: pieces.encode(texts, num_threads=1, add_bos=special_tokens),
            lambda batch: pieces.decode(batch, num_threads=1),
        )
    # One thread per Python worker: Spark already runs one worker per core.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True

    def encode(texts: list[str]) -> Iterable[list[int]]:
        for encoding in tokenizer.encode_batch_fast(texts, add_special_tokens=special_tokens):
            yield encoding.ids

    return Codec(encode, lambda batch: tokenizer.decode_batch(batch, skip_special_tokens=True))


#: Bytes of text (or ids) that a worker handles at a time: a batch of 10,000 long texts never becomes Python objects as a whole.
PORTION = 1 << 20


def portions(column: pa.Array, size: int = PORTION) -> Iterator[pa.Array]:
    """Slices of a column of texts, bytes or lists that hold at most ``size`` bytes or elements, or one row."""
    lengths = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
    ends = np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin = 0
    while begin < len(column):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield column.slice(begin, end - begin)
        begin = end


def _present(column: pa.Array) -> tuple[np.ndarray, list]:
    """Which entries are null, and the values of the others."""
    return column.is_null().to_numpy(zero_copy_only=False), column.drop_null().to_pylist()


def token_ids(text: Column, vocabulary: str | None = None, special_tokens: bool = False) -> Column:
    """``array<int>`` of token ids; null text gives null."""
    vocabulary = vocabulary or default_vocabulary()

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = codec(vocabulary, special_tokens)
        for texts in batches:
            for part in portions(texts):
                missing, values = _present(part)
                ids = [np.asarray(x, np.int32) for x in tokenizer.encode(values)]
                lengths = np.zeros(len(part), np.int32)
                lengths[~missing] = list(map(len, ids))
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
                flat = pa.array(np.concatenate([np.empty(0, np.int32), *ids]), pa.int32())
                yield pa.ListArray.from_arrays(offsets, flat, mask=pa.array(missing))

    return encode(text)


def token_count(text: Column, vocabulary: str | None = None, special_tokens: bool = False) -> Column:
    """Number of tokens. Only the count leaves the worker, not the ids. Null text has 0."""
    vocabulary = vocabulary or default_vocabulary()

    @F.arrow_udf("int")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = codec(vocabulary, special_tokens)
        for texts in batches:
            for part in portions(texts):
                # A missing text is an empty one here.
                encoded = tokenizer.encode(part.fill_null("").to_pylist())
                yield pa.array([len(ids) for ids in encoded], pa.int32())

    return count(text)


def decoded_text(ids: Column, vocabulary: str | None = None) -> Column:
    vocabulary = vocabulary or default_vocabulary()

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokenizer = codec(vocabulary)
        for encoded in batches:
            for part in portions(encoded):
                missing, values = _present(part)
                texts = np.full(len(part), None, object)
                texts[~missing] = tokenizer.decode(values)
                yield pa.array(texts, pa.string())

    return decode(ids)
