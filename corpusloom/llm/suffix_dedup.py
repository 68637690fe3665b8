"""Removal of repeated byte strings with suffix arrays built by linear grouping.

Every string of ``length`` bytes is assigned to its least gram, its anchor: equal
strings have equal anchors, wherever they stand. The strings of an anchor form a
segment, and the segments of one anchor are sorted together in a suffix array;
a string repeats when a neighbour in the array begins with the same bytes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import mix, written

#: Length of the strings that must not repeat, and of the grams that anchor them.
LENGTH = 200
GRAM = 64
#: Anchors with more different segments are divided by longer grams.
#: A segment has a few hundred bytes, so an array has about one million suffixes at most.
ARRAY_SEGMENTS = 4_096

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, in this order, modulo 2^64, at least ``n``."""
    if not _POWERS or len(_POWERS[0]) < n:
        both = []
        for base in (_BASE, _INVERSE):
            steps = np.full(max(n, 1 << 17), base, dtype=np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _POWERS[:] = both
    return _POWERS


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every run of ``gram`` bytes: differences of running sums, scaled to the power at the start."""
    n = len(data)
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    return mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])


def anchored(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Per anchor: gram hash, segment hash, and the bytes [low, high) that its strings cover."""
    if len(data) < length:
        return (np.empty(0, np.int64),) * 4
    hashes = gram_hashes(data, gram)
    width = length - gram + 1
    # Least of each window of ``width`` hashes, by doubling; the leftmost of equals.
    best, span = np.arange(len(hashes)), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(hashes[right] < hashes[left], right, left)
        span += step
    first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    last = np.append(first[1:], len(best)) - 1
    low, high, place = first, last + length, best[first]
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    whole = (sums[high] - sums[low]) * inverse[low]
    segment = mix(mix(whole) + (place - low).astype(np.uint64) * np.uint64(4099) + (high - low).astype(np.uint64))
    return hashes[place].view(np.int64), segment.view(np.int64), low, high


def suffix_array(texts: list[bytes] | list[str]) -> list[int]:
    """Sorted suffixes of all texts, each as text number * 2^32 + start, by linear grouping.

    A suffix points to its previous smaller suffix. Groups start as one per
    letter. From the largest group down, each group is final when it is reached:
    its suffixes then share their Lyndon prefix. The suffixes that they point to
    leave their groups for new ones right above, the more of the final group they
    precede the higher, as their own Lyndon prefixes go on with that many copies
    of it. Then groups take one stretch of the array each. From the smallest
    placed suffix on, the one before it and the chain of its pointers are put at
    the fronts of their groups, so every group is emitted in order and nothing is
    renamed or sorted. Equal suffixes of different texts keep the order of the
    texts.
    """
    # One place before each text stands for no suffix; it counts as placed.
    name, pointer, ends = [], [], []
    letters = sorted(set().union(*texts))
    rank = dict(zip(letters, range(len(letters)), strict=True))
    members: list[list[int]] = [[] for _ in letters]
    for k, text in enumerate(texts):
        base = len(name) + 1
        name.append(-1)
        pointer.append(-1)
        tails = [text[i:] for i in range(len(text))]
        stack: list[int] = []  # suffixes without a next smaller one yet, each smaller than the one above it
        for i, tail in enumerate(tails):
            while stack and tails[stack[-1]] > tail:
                stack.pop()
            pointer.append(base + stack[-1] if stack else -1)
            stack.append(i)
            members[rank[text[i]]].append(base + i)
        name += range(k << 32, (k << 32) + len(text))
        ends.append(len(name) - 1)
    group = [0] * len(name)
    for number, own in enumerate(members):
        for s in own:
            group[s] = number
    size = [len(own) for own in members]
    below, above = list(range(-1, len(letters) - 1)), [*range(1, len(letters)), -1]
    final: list[list[int]] = []

    def lift(old: int, moved: list[int]) -> None:
        if len(moved) == size[old]:
            return  # the whole group: its place among the others stays
        new, higher = len(members), above[old]
        members.append(moved)
        size.append(len(moved))
        size[old] -= len(moved)
        below.append(old)
        above.append(higher)
        below[higher] = above[old] = new
        for s in moved:
            group[s] = new

    at = len(letters) - 1
    while at >= 0:
        own = members[at]
        if len(own) > size[at]:
            own = members[at] = [s for s in own if group[s] == at]
        final.append(own)
        if len(own) == 1:
            s = pointer[own[0]]
            if s >= 0 and size[group[s]] > 1:
                lift(group[s], [s])
        else:
            times = Counter(map(pointer.__getitem__, own))
            times.pop(-1, None)
            moves: dict[int, dict[int, list[int]]] = {}
            for s, n in times.items():
                if size[group[s]] > 1:
                    moves.setdefault(n, {}).setdefault(group[s], []).append(s)
            for n in sorted(moves, reverse=True):
                for old, moved in moves[n].items():
                    lift(old, moved)
        at = below[at]
    front, total = [0] * len(members), 0
    for own in reversed(final):
        front[group[own[0]]] = total
        total += len(own)
    order = [0] * total
    waits = bytearray(b"\1") * len(name)
    for k, text in enumerate(texts):
        waits[ends[k] - len(text)] = 0

    def put(s: int) -> None:
        while s >= 0 and waits[s]:
            waits[s] = 0
            g = group[s]
            order[front[g]] = s
            front[g] += 1
            s = pointer[s]

    for end in ends:
        put(end)  # the empty suffix comes before all others
    for place in range(total):
        put(order[place] - 1)
    return [name[s] for s in order]


def folded(segments: list[bytes], anchor: int, gram: int) -> list[str]:
    """The segments of an anchor with their bytes from the anchor on as one letter, above all bytes and in the order of these ends."""
    place, before = [], None
    for s in segments:
        at = s.find(before) if before else -1
        if at < 0:
            hashes = gram_hashes(np.frombuffer(s, np.uint8), gram).view(np.int64)
            at = int(np.flatnonzero(hashes == anchor)[0])  # the leftmost of equals, as in ``anchored``
            before = s[at : at + gram]
        place.append(at)
    ends = [s[at:] for s, at in zip(segments, place, strict=True)]
    letter = {end: chr(256 + k) for k, end in enumerate(sorted(set(ends)))}
    return [s[:at].decode("latin-1") + letter[end] for s, at, end in zip(segments, place, ends, strict=True)]


def repeated_starts(segments: list[bytes], length: int, anchor: int, gram: int) -> list[np.ndarray]:
    """Starts of the strings of each segment of an anchor that another place of the segments has too."""
    array = suffix_array(folded(segments, anchor, gram))
    hit = [np.zeros(len(s), bool) for s in segments]
    last, last_key = None, b""
    for place in array:
        k, i = place >> 32, place & 0xFFFFFFFF
        key = segments[k][i : i + length]
        if len(key) == length:
            if key == last_key:
                hit[k][i] = True
                hit[last[0]][last[1]] = True
            last, last_key = (k, i), key
    return [np.flatnonzero(h) for h in hit]


def _runs(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs covered by strings of ``length`` bytes at the sorted starts."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.append(0, gap + 1)].tolist(), (starts[np.append(gap, len(starts) - 1)] + length).tolist(), strict=True))


_ANCHOR = pa.struct([("anchor", pa.int64()), ("segment", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])


def _anchors(length: int, gram: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, hashes, parts, counts = [], [], [], [0]
            for data in batch.column(2).to_pylist():
                sizes.append(len(data))
                hashes.append(sha256(data).hexdigest())
                parts.append(anchored(np.frombuffer(data, np.uint8), length, gram))
                counts.append(len(parts[-1][0]))
            columns = [np.concatenate([p[k] for p in parts]) if parts else np.empty(0) for k in range(4)]
            values = pa.StructArray.from_arrays(
                [pa.array(c, f.type) for c, f in zip((x.astype(t) for x, t in zip(columns, (np.int64, np.int64, np.int32, np.int32), strict=True)), _ANCHOR, strict=True)],
                fields=list(_ANCHOR),
            )
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), values)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), lists],
                ["id", "digest", "n_bytes", "sha256", "anchors"],
            )

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments of each text."""
    for batch in batches:
        out: dict[str, list] = {n: [] for n in ("anchor", "segment", "segments", "body")}
        for data, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for w in wanted:
                for n in ("anchor", "segment", "segments"):
                    out[n].append(w[n])
                out["body"].append(data[w["low"] : w["high"]])
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))


_FOUND = ["anchor", "segment", "begin", "stop"]


def _found(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], _FOUND)


def _sorted_groups(length: int, gram: int) -> Callable:
    """Rows sorted by anchor: one suffix array per anchor; repeated runs of each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, group = None, []

        def search() -> list[tuple[int, int, int, int]]:
            starts = repeated_starts([b for _, b in group], length, own, gram) if len(group) > 1 else [np.empty(0, np.int64)]
            return [(own, s, a, b) for (s, _), at in zip(group, starts, strict=True) for a, b in _runs(at, length)]

        for batch in batches:
            rows: list = []
            for anchor, segment, body in zip(*(batch.column(n).to_pylist() for n in ("anchor", "segment", "body")), strict=True):
                if anchor != own:
                    rows += search() if group else []
                    own, group = anchor, []
                group.append((segment, body))
            yield _found(rows)
        if group:
            yield _found(search())

    return run


def finer_grams(length: int, gram: int) -> list[int]:
    """Lengths of the grams that divide a frequent anchor, one after the other: each halves what a string has besides its gram."""
    out = []
    while gram < length:
        gram = length - (length - gram) // 2
        out.append(gram)
    return out


def _divided(length: int, gram: int) -> Callable:
    """The segments of frequent anchors, cut into those of the least longer grams of their strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, segment, body in zip(*(batch.column(n).to_pylist() for n in ("anchor", "segment", "body")), strict=True):
                anchors, segments, low, high = anchored(np.frombuffer(body, np.uint8), length, gram)
                n = len(anchors)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, anchor)), pa.array(np.full(n, segment)), pa.array(anchors), pa.array(segments), pa.array(low.astype(np.int64)),
                     pa.array(high.astype(np.int64)), pa.array([body[x:y] for x, y in zip(low.tolist(), high.tolist(), strict=True)], pa.binary())],
                    ["of_anchor", "of_segment", "anchor", "segment", "low", "high", "body"],
                )

    return run


def _repeated_runs(cut: DataFrame, length: int, gram: int, grams: list[int], array_segments: int) -> DataFrame:
    """Runs of each segment (anchor, segment, begin, stop) covered by strings that another segment of its anchor, or another place of it, has too.

    ``cut`` holds the different segments of each anchor, a hash of ``gram`` bytes, and their number. An anchor
    with more than ``array_segments`` is divided by the least longer gram of each
    string: equal strings have equal ones. Its parts are treated alike; with a gram
    of the whole length a part has a single segment.
    """
    few = F.col("segments") <= array_segments if grams else F.lit(True)
    runs = (
        cut.where(few).select("anchor", "segment", "body")
        .repartition("anchor").sortWithinPartitions("anchor", "segment")
        .mapInArrow(_sorted_groups(length, gram), "anchor bigint, segment bigint, begin bigint, stop bigint")
    )
    many = cut.where(~few)
    if not grams or many.isEmpty():
        return runs
    parts = written(
        many.select("anchor", "segment", "body").mapInArrow(
            _divided(length, grams[0]),
            "of_anchor bigint, of_segment bigint, anchor bigint, segment bigint, low bigint, high bigint, body binary",
        ),
        "finer-anchors",
    )
    segments = written(
        parts.groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("times"), F.first("body").alias("body")), "finer-segments"
    )
    several = segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("segments")).where("segments > 1")
    finer = written(
        _repeated_runs(segments.join(several, "anchor").select("anchor", "segment", "segments", "body"), length, grams[0], grams[1:], array_segments),
        "finer-runs",
    )
    places = parts.select("of_anchor", "of_segment", "anchor", "segment", "low", "high")
    of = [F.col("of_anchor").alias("anchor"), F.col("of_segment").alias("segment")]
    inside = places.join(finer, ["anchor", "segment"]).select(
        *of, (F.col("low") + F.col("begin")).alias("begin"), (F.col("low") + F.col("stop")).alias("stop")
    )
    whole = places.join(segments.where("times > 1").select("anchor", "segment"), ["anchor", "segment"], "left_semi").select(
        *of, F.col("low").alias("begin"), F.col("high").alias("stop")
    )
    return runs.unionByName(inside).unionByName(whole)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, spans, hashes = [], [], []
        for data, marks in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            out, kept, end = [], [], 0
            for begin, stop in sorted((m["begin"], m["stop"]) for m in marks):
                if out and begin <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], stop)
                else:
                    out.append([begin, stop])
            for begin, stop in out:
                kept.append(data[end:begin])
                end = stop
            kept = b"".join([*kept, data[end:]])
            removed.append(len(data) - len(kept))
            spans.append(len(out))
            hashes.append(sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(hashes, pa.string()), batch.column(2)],
            ["digest", "n_removed", "n_spans", "kept_sha256", "marks"],
        )


def suffix_dedup(
    docs: DataFrame, text: str = "text", id_column: str = "doc_id", length: int = LENGTH, gram: int = GRAM,
    array_segments: int = ARRAY_SEGMENTS,
) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed when a string of ``length`` bytes over it also starts
    elsewhere, in the same text or another one. Equal texts are handled once:
    with two or more of them all strings repeat. Segments of an anchor that are
    equal repeat as a whole; of the different ones each goes once into the suffix
    array of its anchor. Anchors with more than ``array_segments`` different
    segments (a passage in very many documents) would put one key into one task:
    they are divided by longer grams of their strings until every array is small.

    A null text is empty. Texts below ``length`` bytes lose nothing. Rows that
    repeat are equal texts. An empty table gives an empty result. Other columns
    are not read.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    source = docs.select(F.col(id_column).alias("id"), F.unhex(F.md5(body)).alias("digest"), body.alias("data"))
    kind = source.schema["id"].dataType.simpleString()
    rows = written(
        source.mapInArrow(
            _anchors(length, gram),
            f"id {kind}, digest binary, n_bytes bigint, sha256 string, "
            "anchors array<struct<anchor bigint, segment bigint, low int, high int>>",
        ),
        "anchors",
    )
    every = rows.select("digest", F.inline("anchors"))
    place = F.struct("digest", "low")
    frequent = every.groupBy("anchor").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b").select("anchor")
    places = written(
        every.join(frequent, "anchor").groupBy("anchor", "segment", "digest", "low", "high").agg(F.count(F.lit(1)).alias("copies")),
        "places",
    )
    segments = places.groupBy("anchor", "segment").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("digest", "low", "high")).alias("at")
    )
    segments = written(segments, "segments")
    several = segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("segments")).where("segments > 1")
    texts = written(
        source.groupBy("digest").agg(F.first("data").alias("data")).join(places.select("digest").distinct(), "digest", "left_semi"),
        "texts",
    )
    wanted = (
        segments.join(several, "anchor")
        .groupBy("at.digest")
        .agg(F.collect_list(F.struct("anchor", "segment", "segments", "at.low", "at.high")).alias("wanted"))
    )
    cut = written(
        texts.join(wanted, "digest").select("data", "wanted")
        .mapInArrow(_cut, "anchor bigint, segment bigint, segments bigint, body binary"),
        "segment-bytes",
    )
    runs = written(_repeated_runs(cut, length, gram, finer_grams(length, gram), array_segments), "runs")
    partial = runs.join(places.select("anchor", "segment", "digest", "low"), ["anchor", "segment"])
    whole = places.join(segments.where("times > 1").select("anchor", "segment"), ["anchor", "segment"], "left_semi")
    marks = partial.select("digest", (F.col("low") + F.col("begin")).alias("begin"), (F.col("low") + F.col("stop")).alias("stop"))
    marks = marks.unionByName(whole.select("digest", F.col("low").cast("bigint").alias("begin"), F.col("high").cast("bigint").alias("stop")))
    by_text = marks.groupBy("digest").agg(F.collect_list(F.struct("begin", "stop")).alias("marks"))
    removed = written(
        texts.join(by_text, "digest").select("digest", "data", "marks").mapInArrow(
            _remove, "digest binary, n_removed bigint, n_spans bigint, kept_sha256 string, marks array<struct<begin bigint, stop bigint>>"
        ),
        "removed",
    )
    copies = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return (
        rows.select("id", "digest", "n_bytes", "sha256")
        .join(copies.where("copies > 1"), "digest", "left")
        .join(removed.drop("marks"), "digest", "left")
        .withColumn("gone", F.coalesce(gone, F.lit(False)))
        .select(
            F.col("id").alias(id_column), "n_bytes",
            F.when(F.col("gone"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("bigint").alias("n_removed"),
            F.when(F.col("gone"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
            F.when(F.col("gone"), F.lit(sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha256")).alias("kept_sha256"),
        )
    )
