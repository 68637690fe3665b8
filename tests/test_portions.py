"""Long columns pass a Python worker in bounded portions, and windows do not repeat their list."""

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.functions import tokens as K
from corpusloom.operators import tokenize as N


def test_portions_are_bounded_and_whole():
    texts = pa.array(["a" * 40, None, "", "é" * 30, "b" * 300, *["c" * 9] * 50, None])
    parts = list(K.portions(texts, 100))
    assert pa.concat_arrays(parts).equals(texts)
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p.to_pylist()) <= 100 for p in parts)
    lists = pa.array([[1] * 70, None, [], [2] * 40, [3] * 300], pa.list_(pa.int32()))
    parts = list(K.portions(lists.slice(1), 100))
    assert pa.concat_arrays(parts).equals(lists.slice(1)) and len(parts) == 2
    assert list(K.portions(texts.slice(0, 0))) == []


def test_tokens_of_several_portions(texts):
    from tokenizers import Tokenizer

    values = ["word ä " * (30_000 * (k % 3)) for k in range(7)] + [None, "", "end"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df = texts(values).coalesce(1)
    ids = df.withColumn("ids", K.token_ids(F.col("text"))).withColumn("back", K.decoded_text(F.col("ids")))
    got = {r.id: r for r in ids.withColumn("n", K.token_count(F.col("text"))).withColumn("bytes", N.byte_ids(F.col("text"))).collect()}
    for i, text in enumerate(values):
        mine = None if text is None else library.encode(text, add_special_tokens=False).ids
        assert got[i].ids == mine and got[i].back == text and got[i].n == len(mine or [])
        assert got[i].bytes == [b + 1 for b in (text or "").encode()]


def test_a_window_does_not_carry_the_whole_list(spark):
    rows = spark.range(1).select("id", F.sequence(F.lit(1), F.lit(50_000)).alias("ids"))
    cut = N.cut_windows(rows.repartition(2), "ids", 8)
    assert "explode(" not in cut._jdf.queryExecution().optimizedPlan().toString()
    got = cut.orderBy("window").collect()
    assert [i for r in got for i in r.ids] == list(range(1, 50_001)) and len(got) == 6_250
