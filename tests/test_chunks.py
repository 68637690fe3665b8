import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import chunks as K
from corpusloom.operators.chunk import chunk_dataset

RELAXED = settings(
    max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
PROSE = st.lists(st.sampled_from(["a", "bb", "ccc.", "dddd!", "ee?", " ", "\n", ".", "f" * 30 + "."]), max_size=40).map(" ".join)
EDGES = [
    "", "   ", "no end here", "?! x", "One. Two! Three? Four", "a." + " b." * 50, "x" * 40 + ". y.",
    "tail is longer than overlap. " + "z" * 30 + ".", "a.\u2003b.\x1cc.", "1.5 stays. done.",
]


def spec_sentences(text):
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]


def spec_chunks(text, limit, overlap):
    """Independent statement of the packing rule: (first sentence, end) spans."""
    parts = spec_sentences(text)
    spans, first, size = [], 0, 0
    for i, part in enumerate(parts):
        if size + len(part) > limit and i > first:
            spans.append((first, i))
            first, size = i, 0
            while overlap > 0 and first > spans[-1][0] and size + len(parts[first - 1]) <= overlap:
                first -= 1
                size += len(parts[first])
        size += len(part)
    if first < len(parts):
        spans.append((first, len(parts)))
    return [(" ".join(parts[a:b]), b - a) for a, b in spans]


def got_chunks(evaluate, values, limit, overlap):
    found = evaluate(values, K.sentence_chunks(F.col("text"), limit, overlap))
    assert all(c.length == len(c.text) for row in found for c in row)
    return [[(c.text, c.sentence_count) for c in row] for row in found]


def test_sentences(evaluate):
    assert evaluate(EDGES, K.sentences(F.col("text"))) == [spec_sentences(t) for t in EDGES]


@pytest.mark.parametrize("limit,overlap", [(512, 50), (20, 10), (10, 0), (1, 0), (30, 100)])
def test_sentence_chunks_on_edges(evaluate, limit, overlap):
    assert got_chunks(evaluate, EDGES, limit, overlap) == [spec_chunks(t, limit, overlap) for t in EDGES]


@RELAXED
@given(st.lists(PROSE, min_size=1, max_size=20), st.integers(1, 60), st.integers(0, 40))
def test_sentence_chunks_on_any_prose(evaluate, values, limit, overlap):
    assert got_chunks(evaluate, values, limit, overlap) == [spec_chunks(t, limit, overlap) for t in values]


def spec_pieces(text, limit, overlap):
    return [text[s:s + limit] for s in range(0, len(text), limit - overlap)]


@RELAXED
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), min_size=1, max_size=20), st.integers(1, 12), st.integers(0, 11))
def test_character_pieces(evaluate, values, limit, overlap):
    if overlap >= limit:
        with pytest.raises(ValueError):
            K.character_pieces(F.col("text"), limit, overlap)
    else:
        got = evaluate(values, K.character_pieces(F.col("text"), limit, overlap))
        assert got == [spec_pieces(t, limit, overlap) for t in values]


def test_chunk_rows_repeat_other_columns_and_drop_empty_texts(texts):
    df = texts(["One two. Three four.", "", "abcdefghij"]).withColumn("tag", F.lit("t"))
    rows = chunk_dataset(df, "text", 9, 0).orderBy("id").collect()
    assert [(r.id, r.tag, r.text) for r in rows] == [
        (0, "t", "One two."), (0, "t", "Three four."), (2, "t", "abcdefghij"),
    ]
    pieces = chunk_dataset(df.where("id = 2"), "text", 6, 2, preserve_sentences=False, details=True)
    assert [(r.text, r.start_pos, r.end_pos) for r in pieces.orderBy("chunk_id").collect()] == [
        ("abcdef", 0, 6), ("efghij", 4, 10), ("ij", 8, 14),
    ]


def test_one_huge_document(texts):
    text = " ".join(f"Sentence number {i} goes here." for i in range(20_000))
    got = chunk_dataset(texts([text]), "text", details=True).collect()
    assert [(r.text, r.sentence_count) for r in sorted(got, key=lambda r: r.chunk_id)] == spec_chunks(text, 512, 50)


def test_a_text_of_many_sentences_takes_time_in_proportion(spark):
    long = spark.range(1).select(
        F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda k: F.concat(F.lit("Sentence "), k.cast("string"), F.lit("."))), " ").alias("t")
    )
    begun = time.perf_counter()
    chunks = long.select(F.inline(K.sentence_chunks(F.col("t"), 60, 20))).agg(F.count(F.lit(1)), F.sum("sentence_count")).first()
    assert chunks[0] > 20_000 and chunks[1] >= 100_000
    assert time.perf_counter() - begun < 30
