"""Token rules and per-pair scores used by the evaluation operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.stemming import stem
from corpusloom.functions.text import WS

# The published mteval-13a tokenisation, literals first, then patterns.
# The symbols are listed one by one and "not a digit" is spelled as two ranges of
# UTF-16 units: Java tests such classes much faster. Half of a wide character is
# no digit either, so the outcome is the same. The published symbol class also
# names the blank, which splitting on blanks makes idle.
MTEVAL_13A_LITERALS = [
    ("<skipped>", ""),
    ("-\n", ""),
    ("\n", " "),
    ("&quot;", '"'),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
]
MTEVAL_13A_PATTERNS = [
    (r"""([!"#$%&()*+/:;<=>?@\[\\\]^_`{|}~])""", " $1 "),
    (r"([\x{0}-/:-\x{FFFF}])([.,])", "$1 $2 "),
    (r"([.,])([\x{0}-/:-\x{FFFF}])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]


def bleu_tokens(text: Column) -> Column:
    spaced = F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))
    for literal, replacement in MTEVAL_13A_LITERALS:
        spaced = F.replace(spaced, F.lit(literal), F.lit(replacement))
    for pattern, replacement in MTEVAL_13A_PATTERNS:
        spaced = F.regexp_replace(spaced, pattern, replacement)
    return F.array_remove(F.split(spaced, rf"{WS}+"), "")


def rouge_tokens(text: Column) -> Column:
    """Lower case, letters a-z and digits only."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(lowered, "[^a-z0-9]+"), "")


class _TokenColumn:
    """A batch of token lists as one run of integer codes with row bounds."""

    def __init__(self, codes: np.ndarray, bounds: np.ndarray):
        self.codes, self.bounds = codes, bounds

    def rows(self, start: int, stop: int) -> _TokenColumn:
        low, high = self.bounds[start], self.bounds[stop]
        return _TokenColumn(self.codes[low:high], self.bounds[start:stop + 1] - low)


# Tokens of both sides handled at a time, which bounds the memory of a batch.
_BLOCK_TOKENS = 2_000_000


def _coded(mine: pa.Array, theirs: pa.Array, stemming: bool) -> tuple[_TokenColumn, _TokenColumn]:
    """Both sides with shared token codes; each distinct token is stemmed once."""
    flat = [pc.list_flatten(side) for side in (mine, theirs)]
    coded = pa.concat_arrays(flat).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype("int64")
    if stemming:
        stems = [stem(t) if len(t) > 3 else t for t in coded.dictionary.to_pylist()]
        merged = pa.array(stems, type=pa.string()).dictionary_encode().indices
        codes = merged.to_numpy(zero_copy_only=False).astype("int64")[codes]
    sides, start = [], 0
    for side, tokens in zip((mine, theirs), flat):
        lengths = pc.list_value_length(side).fill_null(0).to_numpy(zero_copy_only=False)
        bounds = np.concatenate(([0], np.cumsum(lengths))).astype("int64")
        sides.append(_TokenColumn(codes[start:start + len(tokens)], bounds))
        start += len(tokens)
    return sides[0], sides[1]


def _shared_grams(mine: _TokenColumn, theirs: _TokenColumn, orders: Sequence[int]) -> list[np.ndarray]:
    """Per order and row, the size of the intersection of the two multisets of n-grams.

    An n-gram is numbered by the number of its first n - 1 tokens and its last
    token, starting from the row, so equal numbers mean equal grams of one row.
    """
    rows = len(mine.bounds) - 1
    codes = np.concatenate((mine.codes, theirs.codes))
    row = np.concatenate([np.repeat(np.arange(rows), np.diff(side.bounds)) for side in (mine, theirs)])
    end = np.concatenate((mine.bounds[1:], theirs.bounds[1:] + len(mine.codes)))
    end = end[row + np.where(np.arange(len(codes)) < len(mine.codes), 0, rows)]
    words = int(codes.max()) + 1 if len(codes) else 1
    number, place = row, np.arange(len(codes))
    found = []
    for n in range(1, max(orders, default=0) + 1):
        keep = place + n <= end[place]
        place, number = place[keep], number[keep]
        grams, number = np.unique(number * words + codes[place + n - 1], return_inverse=True)
        if n in orders:
            is_mine = place < len(mine.codes)
            left = np.bincount(number[is_mine], minlength=len(grams))
            right = np.bincount(number[~is_mine], minlength=len(grams))
            owner = np.zeros(len(grams), dtype="int64")
            owner[number] = row[place]
            shared = np.bincount(owner, weights=np.minimum(left, right), minlength=rows)
            found.append(shared.astype("int64"))
    return found


def _subsequence_length(left: list[int], right: list[int]) -> int:
    """Longest common subsequence, one bit per element of ``left``.

    A row of the classic table is one big integer, so a step of ``right`` costs
    len(left) / 64 word operations, and one row is all the memory used.
    """
    where: dict[int, int] = {}
    for i, token in enumerate(left):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << len(left)) - 1
    row = full
    for token in right:
        hit = row & where.get(token, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(left) - row.bit_count()


def _subsequences(mine: _TokenColumn, theirs: _TokenColumn) -> np.ndarray:
    left, right = mine.codes.tolist(), theirs.codes.tolist()
    a, b = mine.bounds.tolist(), theirs.bounds.tolist()
    lengths = [
        _subsequence_length(left[a[i]:a[i + 1]], right[b[i]:b[i + 1]]) for i in range(len(a) - 1)
    ]
    return np.array(lengths, dtype="int64")


def _blocks(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``_BLOCK_TOKENS`` tokens, or of one row if that row is longer."""
    start = 0
    while start < len(bounds) - 1:
        stop = int(np.searchsorted(bounds, bounds[start] + _BLOCK_TOKENS, side="right")) - 1
        stop = max(stop, start + 1)
        yield start, stop
        start = stop


def overlap_counts(
    mine: Column, theirs: Column, orders: Sequence[int], stemming: bool = False, subsequence: bool = False
) -> Column:
    """Array of counts per pair of token lists: shared n-grams for each order, then the
    length of the longest common subsequence if asked.

    The counts are a matter of one row, so they are taken where the row is: no
    n-gram is shuffled or even becomes a row. A batch is one vectorised pass.
    """

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def count(left: pa.Array, right: pa.Array) -> pa.Array:
        a, b = _coded(left, right, stemming)
        blocks = []
        for start, stop in _blocks(a.bounds + b.bounds):
            x, y = a.rows(start, stop), b.rows(start, stop)
            columns = _shared_grams(x, y, orders)
            if subsequence:
                columns.append(_subsequences(x, y))
            blocks.append(np.stack(columns, axis=1))
        width = len(orders) + int(subsequence)
        table = np.concatenate(blocks) if blocks else np.zeros((0, width), dtype="int64")
        offsets = np.arange(0, (len(table) + 1) * width, width, dtype="int32")
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(table.ravel()))

    return count(mine, theirs)


def gram_total(tokens: Column, n: int) -> Column:
    """Number of n-grams of a token list."""
    return F.greatest(F.size(tokens) - (n - 1), F.lit(0)).cast("bigint")
