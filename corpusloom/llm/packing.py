"""Packing documents into fixed windows by non-negative least squares over their lengths.

A document is cut into whole windows and one remainder. The histogram of the
remainders has at most ``window`` bins, however large the table: combinations of
up to three lengths that fill a window are enumerated, their repeat counts are
fitted to the histogram by non-negative least squares and rounded, and what is
left is packed greedily.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import portions, sole_memory, written

WINDOW = 1024
END_ID = 0
#: A sequence of left-over remainders may have this share of padding; else it is cut at powers of two.
PADDING = 0.02
#: Words that a worker remembers: fewer than two thirds of 2^20, where the table of a dict would double.
UNITS = 600_000
#: Bytes of text that a task turns into Python strings at a time.
PORTION = 1 << 20

_UNIT = re.compile("[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+")
_TAILED = re.compile(r"([ \n]?[^\W\d_]+)([.,;:!?]+)")
#: Letters in every version of Unicode that splitters know.
_LETTERS = "A-Za-z" + "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: All ASCII marks: behind a letter or digit they never share an id with it.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = re.compile(rf"([ \n]?)([{_LETTERS}]+)")
#: What a text without runs of white space, and with no white space but blanks and line ends, does not hold.
_RUNS = ("  ", " \n", "\n ", "\n\n", "\t", "\x0b", "\x0c", "\r", "\x00")
#: White space that only some of the splitters' rules count as such: such texts are encoded whole.
_ODD_SPACE = re.compile(
    "[\x1c-\x1f"
    + "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
    + "]"
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder(dict):
    """Ids of texts as little-endian 32-bit bytes.

    The byte-level splitter never joins characters across the start of a run of
    white space, so a text's ids are those of its words, each with the space
    before it, in turn; words are remembered. A new word of plain letters is one
    piece to the splitter and goes to the model at once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        splitter = self.tokenizer.pre_tokenizer
        self.model = self.letters = None
        if (
            isinstance(splitter, ByteLevel) and splitter.use_regex and not splitter.add_prefix_space
            and self.tokenizer.normalizer is self.tokenizer.truncation is self.tokenizer.padding is None
            and not any(
                re.fullmatch(rf"[ \n{_LETTERS}0-9]*[{re.escape(_MARKS)}]*", t.content)
                for t in self.tokenizer.get_added_tokens_decoder().values()
            )
        ):
            self.model = self.tokenizer.model
            # How the splitter writes the bytes of a blank and of each letter.
            known = [chr(c) for c in range(0x250) if _PLAIN.fullmatch(chr(c))]
            self.bytes = [struct.pack("<I", n) for n in range(max(self.tokenizer.get_vocab().values(), default=0) + 1)]
            self.letters = {ord(c): splitter.pre_tokenize_str(c)[0][0] for c in [" ", *known]}

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= UNITS:
            self.clear()
        plain = _PLAIN.fullmatch(unit) if self.model is not None else None
        if plain is not None:
            if plain[1] == "\n":  # a line end is a piece of its own
                value = self["\n"] + self.piece(plain[2].translate(self.letters))
            elif unit.isascii():  # only the blank is written otherwise
                value = self.piece(self.letters[0x20] + unit[1:] if plain[1] else unit)
            else:
                value = self.piece(unit.translate(self.letters))
        else:
            stem = unit.rstrip(_MARKS) if self.model is not None else unit
            if stem != unit and stem[-1:] < "\u0250" and stem.lstrip(" \n").isalnum():
                known = stem in self
                value = self[stem] + self[unit[len(stem) :]]
                if not known:  # a rare word: what is behind it hardly comes again
                    return value
            else:
                parts = _TAILED.fullmatch(unit)  # letters and the marks after them never share an id
                value = self[parts[1]] + self[parts[2]] if parts else self.whole(unit)
        self[unit] = value
        return value

    def piece(self, text: str) -> bytes:
        return b"".join([self.bytes[token.id] for token in self.model.tokenize(text)])

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if _ODD_SPACE.search(text):
            return self.whole(text)
        if any(run in text for run in _RUNS) or text[:1] in " \n" or text[-1:] in " \n":
            return b"".join(map(self.__getitem__, _UNIT.findall(text)))
        # Each word but the first with the one blank or line end before it.
        units = text.replace("\n", " \n").replace(" ", "\x00 ").replace("\x00 \n", "\x00\n").split("\x00")
        return b"".join(map(self.__getitem__, units))


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of this process, so that what it remembers serves later tasks too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    sole_memory(_ENCODERS[path])
    return _ENCODERS[path]


def ship_vocabulary(spark: SparkSession, path: str) -> str:
    """Send the vocabulary file to every executor; returns the name it has there."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def _powers(length: int) -> list[int]:
    return [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


def _cutter(file: str, window: int, end_id: int, keep_ids: bool) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(SparkFiles.get(file)), np.array([end_id], dtype="<u4").tobytes()
        for batch in portions(batches, "text", PORTION):
            rows: dict[str, list] = {c: [] for c in ("row", "start", "length", "ids_crc32", "doc_tokens", "cut_crcs", "ids")}
            for at, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder.encode(text or "") + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    length, crcs, begin = len(piece) // 4, [], 0
                    if length < window:
                        for size in _powers(length):
                            crcs.append(zlib.crc32(piece[4 * begin : 4 * (begin + size)]))
                            begin += size
                    rows["row"].append(at)
                    rows["start"].append(start)
                    rows["length"].append(length)
                    rows["ids_crc32"].append(zlib.crc32(piece))
                    rows["doc_tokens"].append(total)
                    rows["cut_crcs"].append(crcs)
                    rows["ids"].append(np.frombuffer(piece, "<u4").astype(np.int32) if keep_ids else None)
            columns = [
                batch.column(0).take(pa.array(rows["row"], pa.int64())),
                *(pa.array(rows[c], pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens")),
                pa.array(rows["cut_crcs"], pa.list_(pa.int64())),
                pa.array(rows["ids"], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(
                columns, ["id", "start", "length", "ids_crc32", "doc_tokens", "cut_crcs", "ids"]
            )

    return cut


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All ways to fill a window with two or three of the lengths, as rows (a, b, c); 0: no third length."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    low = lengths[lengths <= window // 2]
    pairs = np.array([(a, window - a, 0) for a in low if have[window - a]], dtype=np.int64).reshape(-1, 3)
    triples = []
    for a in lengths[lengths <= window // 3]:
        b = lengths[(lengths >= a) & (lengths <= (window - a) // 2)]
        b = b[have[window - a - b]]
        triples.append(np.stack([np.full(len(b), a), b, window - a - b], axis=1))
    return np.concatenate([pairs, *triples]).astype(np.int64)


def nonnegative_least_squares(combos: np.ndarray, histogram: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Repeat counts x >= 0 with the least squared error of the lengths used against the histogram.

    Multiplicative updates: x is scaled by the ratio of the two halves of the gradient.
    """
    slots, target = combos.ravel(), histogram.astype(float)
    owners = np.repeat(np.arange(len(combos)), 3)
    owners, slots = owners[slots > 0], slots[slots > 0]
    want = np.bincount(owners, target[slots], minlength=len(combos))
    x = np.full(len(combos), target.sum() / max(len(slots), 1))
    for _ in range(rounds):
        used = np.bincount(slots, x[owners], minlength=len(target))
        x *= want / np.maximum(np.bincount(owners, used[slots], minlength=len(combos)), 1e-12)
    return x


def plan_sequences(histogram: dict[int, int], window: int = WINDOW, padding: float = PADDING) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, from the histogram alone.

    Rows (length, first_rank, seq_base, offset, cut): the piece with a rank of at
    least first_rank among those of its length belongs to sequence
    seq_base + rank - first_rank at that offset. With ``cut``, it is cut at the
    powers of two in its length, each a sequence of its own without padding.
    """
    left = np.zeros(window + 1, dtype=np.int64)
    for length, count in histogram.items():
        left[length] = count
    used = np.zeros(window + 1, dtype=np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def place(pattern: list[int], times: int) -> None:
        nonlocal sequences
        offset = 0
        for length in pattern:
            rows.append((length, int(used[length]), sequences, offset, 0))
            used[length] += times
            left[length] -= times
            offset += length
        sequences += times

    def room(pattern: list[int]) -> int:
        return min(int(left[n]) // pattern.count(n) for n in pattern)

    if left[window]:
        place([window], int(left[window]))
    lengths = np.flatnonzero(left)
    combos = combinations(lengths, window)
    if len(combos):
        x = nonnegative_least_squares(combos, left)
        order = np.argsort(-x, kind="stable")
        patterns = [[n for n in combo if n] for combo in combos[order].tolist()]
        for whole in (True, False):  # first the counts rounded down, then what still fills a window
            for pattern, count in zip(patterns, x[order], strict=True):
                times = min(int(count), room(pattern)) if whole else room(pattern)
                if times:
                    place(pattern, times)
    while left.any():
        pattern: list[int] = []
        free = window
        stock = left.copy()
        while free and (fits := np.flatnonzero(stock[: free + 1])).size:
            pattern.append(int(fits[-1]))
            stock[fits[-1]] -= 1
            free -= int(fits[-1])
        filled = window - free
        if free <= padding * window or filled & (filled - 1) == 0:
            place(pattern, room(pattern))
        else:
            length, times = pattern[0], int(left[pattern[0]])
            rows.append((length, int(used[length]), sequences, 0, 1))
            used[length] += times
            left[length] = 0
            sequences += times * bin(length).count("1")
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "first_rank", "seq_base", "offset", "cut"), table.T, strict=True))


def _placer(plan: dict[str, np.ndarray], schema: pa.Schema, rank_bits: int = 42) -> Callable:
    keys = (plan["length"] << rank_bits) + plan["first_rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("start", "length", "ids_crc32", "rank")}
            slot = np.searchsorted(keys, (get["length"] << rank_bits) + get["rank"], side="right") - 1
            behind = get["rank"] - plan["first_rank"][slot]
            cut = plan["cut"][slot].astype(bool)
            rows = [np.flatnonzero(~cut)]
            out = {
                "start": [get["start"][~cut]], "length": [get["length"][~cut]], "ids_crc32": [get["ids_crc32"][~cut]],
                "sequence_id": [(plan["seq_base"][slot] + behind)[~cut]], "offset": [plan["offset"][slot][~cut]],
            }
            for at in np.flatnonzero(cut):
                sizes = np.array(_powers(int(get["length"][at])), dtype=np.int64)
                rows.append(np.full(len(sizes), at))
                out["start"].append(get["start"][at] + np.cumsum(sizes) - sizes)
                out["length"].append(sizes)
                out["ids_crc32"].append(np.array(batch.column("cut_crcs")[at].as_py(), dtype=np.int64))
                base = plan["seq_base"][slot[at]] + behind[at] * len(sizes)
                out["sequence_id"].append(base + np.arange(len(sizes)))
                out["offset"].append(np.zeros(len(sizes), dtype=np.int64))
            rows_all = pa.array(np.concatenate(rows))
            columns = {n: pa.array(np.concatenate(v), pa.int64()) for n, v in out.items()}
            columns |= {n: batch.column(n).take(rows_all) for n in ("id", "doc_tokens")}
            if "ids" in schema.names:
                whole = batch.column("ids").take(rows_all).to_pylist()
                first = get["start"][np.concatenate(rows)]
                begin, size = np.concatenate(out["start"]) - first, np.concatenate(out["length"])
                columns["ids"] = pa.array(
                    [x[b : b + n] for x, b, n in zip(whole, begin, size, strict=True)], pa.list_(pa.int32())
                )
            yield pa.RecordBatch.from_arrays([columns[n] for n in schema.names], schema=schema)

    return place


def pack(
    docs: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    vocabulary: str | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
    keep_ids: bool = True,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if kept, ids.

    A document's ids are those of its text followed by ``end_id``; each lies in
    exactly one piece. Sequences hold at most ``window`` ids, gapless from 0, and
    nearly all are full; those that would need much padding are cut to powers of two.

    The driver holds the histogram and the plan (at most ``window`` bins and one
    row per combination of lengths used). Ranks of pieces within a length come
    from counts in about sqrt(n) slices, so one frequent length is numbered by
    many tasks.

    Null and empty texts are the end id alone. Repeated rows are packed each. An
    empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    file = ship_vocabulary(spark, vocabulary or default_vocabulary())
    source = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    pieces = written(
        source.mapInArrow(
            _cutter(file, window, end_id, keep_ids),
            f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, cut_crcs array<bigint>, ids array<int>",
        ),
        "pieces",
    )
    histogram = {row.length: row["count"] for row in pieces.groupBy("length").count().collect()}
    plan = plan_sequences(histogram, window)
    slices = max(1, int(sum(histogram.values()) ** 0.5))
    cut = pieces.withColumn("slice", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(slices)))
    counts = cut.groupBy("length", "slice").count()
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "slice").orderBy("id", "start", "ids_crc32")
    ranked = (
        cut.withColumn("place", F.row_number().over(inside))
        .join(counts, ["length", "slice"])
        .withColumn("rank", F.col("before") + F.col("place") - 1)
        .drop("slice", "before", "place")
    )
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    ddl = f"id {kind}, " + ", ".join(f"{n} bigint" for n in names) + (", ids array<int>" if keep_ids else "")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    placed = ranked.mapInArrow(_placer(plan, to_arrow_schema(StructType.fromDDL(ddl))), ddl)
    return placed.withColumnRenamed("id", id_column)


def sequences(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Whole sequences (sequence_id, ids) from pieces with ids; a group holds at most ``window`` ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
