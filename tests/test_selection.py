"""Masking, flags, splits, balance, windows of tokens, and stopping rules on small frames."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.tokens import token_ids
from corpusloom.operators import events as E
from corpusloom.operators import redact as R
from corpusloom.operators import sampling as S
from corpusloom.operators import tokenize as N
from corpusloom.operators.catalog import preview
from corpusloom.operators.template import conversation_to_chatml


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(digits)) % 10 == 0


def test_cards_and_masks(evaluate):
    numbers = ["4111 1111 1111 1111", "4111111111111112", "5500-0000-0000-0004", "12345678901234567890", "378282246310005"]
    texts = [*numbers, f"pay {numbers[0]}, or a@b.example.com now", "ssn 123-45-6789 call 555-123-4567", "", None]
    got = evaluate(texts, R.card_numbers(F.col("text")))
    want = [[n] if luhn(n) and len([c for c in n if c.isdigit()]) <= 19 else [] for n in numbers]
    assert got[:5] == want and got[-1] is None
    masked = evaluate(texts, R.redact(F.col("text")))
    assert masked[5:] == ["pay [CARD], or [EMAIL] now", "ssn [SSN] call [PHONE]", "", None]


def test_quality_flags(texts):
    rows = R.quality_flags(texts(["fine text", "ab", None, "bad\x01 text"]), "text").orderBy("id").collect()
    assert [r.low_quality for r in rows] == [False, True, True, True]
    assert [r.encoding_issue for r in rows] == [False, False, False, True]


def test_split_shares_and_range(spark):
    counts = {r.split: r["count"] for r in S.split(spark.range(20_000), "id", 0.8).groupBy("split").count().collect()}
    assert abs(counts["train"] - 16_000) < 300 and abs(counts["test"] - 3_000) < 200 and abs(counts["validation"] - 1_000) < 150
    with pytest.raises(ValueError):
        S.split(spark.range(1), "id", 0.99)


def test_balanced_keeps_as_many_of_each(spark):
    rows = spark.range(500).withColumn("label", F.when(F.col("id") < 30, "a").when(F.col("id") < 480, "b"))
    counts = {r.label: r["count"] for r in S.balanced(rows, "label", "id").groupBy("label").count().collect()}
    assert counts == {"a": 30, "b": 30}
    weights = {r.label: r.weight for r in S.class_weights(rows, "label").collect()}
    assert weights["a"] == pytest.approx(480 / 60) and weights["b"] == pytest.approx(480 / 900)


def test_columns_must_exist(spark):
    with pytest.raises(ValueError):
        S.select_columns(spark.range(1), "label", ["id"])


def test_windows_of_tokens_lose_nothing(texts):
    frame = texts(["", "one two three four five six seven eight nine ten", "short"])
    whole = {r.id: r.ids for r in frame.select("id", token_ids(F.col("text")).alias("ids")).collect()}
    rows = N.token_windows(frame, "text", 4, padding=True, pad_id=9).orderBy("id", "window").collect()
    for i, ids in whole.items():
        mine = [r for r in rows if r.id == i]
        assert [r.window for r in mine] == list(range(len(mine)))
        assert [x for r in mine for x, m in zip(r.input_ids, r.attention_mask) if m] == ids
        assert all(len(r.input_ids) == r.token_count == 4 for r in mine)
    stats = N.truncation_stats(N.count_tokens(frame, "text"), 4).first()
    assert (stats.rows, stats.tokens) == (3, sum(map(len, whole.values())))
    assert stats.lost_tokens == sum(max(0, len(v) - 4) for v in whole.values())


def test_batches_of_sparse_ids(spark):
    frame = spark.createDataFrame([(1, "a b c"), (2, "d"), (70, "e f"), (10**9, "g")], "id bigint, text string")
    rows = N.tokenize_batches(frame, "text", "id", batch_size=2).collect()
    assert {r.id: r.batch_id for r in rows} == {1: 0, 2: 0, 70: 1, 10**9: 1}


def test_genuine_replacement_character_stays(spark):
    bad = spark.sql("SELECT cast(X'61EFBFBDFF62' AS STRING) AS text")
    assert bad.select(X.fix_encoding(F.col("text"))).first()[0] == "a�b"


def test_limits_are_refused_not_clamped(spark):
    with pytest.raises(ValueError):
        preview(spark.range(3), "id", 101)


def test_special_tokens_of_a_rank_file_are_refused(texts):
    with pytest.raises(Exception, match="rank file"):
        N.count_tokens(texts(["a"]), "text", special_tokens=True).collect()


def test_whole_conversations(spark):
    rows = spark.createDataFrame(
        [(1, 2, "assistant", "hi"), (1, 1, "user", "hello"), (2, 1, "user", None)], "conv_id int, turn int, role string, text string"
    )
    got = {r.conv_id: (r.turns, r.text) for r in conversation_to_chatml(rows).collect()}
    assert got[1] == (2, "<|im_start|>user\nhello<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>")
    assert got[2] == (1, "<|im_start|>user\n<|im_end|>")


def test_early_stopping(spark):
    values = {"a": [5, 4, 4.5, 4.2, 3, 3.1, 3.2, 3.3], "b": [3, 2, 1], "c": [1, 2, None, 3, 4]}
    rows = [(run, k, k, v and float(v)) for run, vs in values.items() for k, v in enumerate(vs)]
    frame = spark.createDataFrame(rows, "run_id string, ts int, event_id int, value double")
    got = {r.run_id: (r.stop_event, r.best) for r in E.early_stopping(frame, "value", 3).collect()}
    assert got == {"a": (7, 3.0), "c": (4, 1.0)}
