import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import templates as TP
from corpusloom.functions.tokens import default_vocabulary
from corpusloom.operators import tokenize as N
from corpusloom.operators.template import apply_template
from corpusloom.plans.preparation import PreprocessConfig, preprocess, preprocess_and_save, processing_stats, run_stages

public_tokenizers = pytest.importorskip("public_tokenizers")
SAMPLES = ["Hello world, this is text.", "", "<|endoftext|> is ordinary here", "naïve café ☕ 日本", "a  b\n\nc\t"]


def rows_of(df):
    return [r.text for r in df.orderBy("id").collect()]


@pytest.fixture
def fields(spark):
    return spark.createDataFrame(
        [(0, "Do it", "with this", "done"), (1, "Do it", "", "done"), (2, "Do it", None, None)],
        "id bigint, q string, c string, a string",
    )


def test_alpaca_layouts(fields):
    got = rows_of(apply_template(fields, "alpaca", {"instruction": "q", "input": "c", "output": "a"}, keep=["id"]))
    assert got[0] == (
        "Below is an instruction that describes a task, paired with an input that provides further context. "
        "Write a response that appropriately completes the request.\n\n### Instruction:\nDo it\n\n"
        "### Input:\nwith this\n\n### Response:\ndone"
    )
    plain = (
        "Below is an instruction that describes a task. Write a response that appropriately completes the "
        "request.\n\n### Instruction:\nDo it\n\n### Response:\n"
    )
    assert got[1:] == [plain + "done", plain]
    with pytest.raises(ValueError):
        apply_template(fields, "alpaca", {"input": "c"})


def test_chat_layouts(fields):
    mapping = {"system": "c", "user": "q", "assistant": "a"}
    assert rows_of(apply_template(fields, "chatml", mapping, keep=["id"])) == [
        "<|im_start|>system\nwith this<|im_end|>\n<|im_start|>user\nDo it<|im_end|>\n<|im_start|>assistant\ndone<|im_end|>",
        "<|im_start|>user\nDo it<|im_end|>\n<|im_start|>assistant\ndone<|im_end|>",
        "<|im_start|>user\nDo it<|im_end|>",
    ]
    assert rows_of(apply_template(fields, "llama2", mapping, keep=["id"])) == [
        "<s>[INST] <<SYS>>\nwith this\n<</SYS>>\n\nDo it [/INST] done",
        "<s>[INST] Do it [/INST] done",
        "<s>[INST] Do it [/INST] ",
    ]
    assert rows_of(apply_template(fields, "completion", {"text": "q", "completion": "missing"}, keep=["id"])) == ["Do it"] * 3


def test_registry(fields):
    with pytest.raises(ValueError, match="alpaca"):
        apply_template(fields, "nope", {})
    TP.register_template("shout", lambda f: F.upper(f["text"]))
    assert rows_of(apply_template(fields, "shout", {"text": "q"}, keep=["id"])) == ["DO IT"] * 3


def ids_by_library(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken"])
def test_counts_agree_with_the_library(texts, name):
    df = texts([*SAMPLES, None])
    got = N.count_tokens(df, "text", public_tokenizers.path(name)).orderBy("id").collect()
    assert [r.token_count for r in got] == [len(ids_by_library(t)) for t in SAMPLES] + [0]


def test_sentence_piece_vocabulary(texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    got = N.count_tokens(texts(SAMPLES), "text", path).orderBy("id").collect()
    assert [r.token_count for r in got] == [len(pieces.encode(t)) for t in SAMPLES]


def test_fixed_length_rows_and_labels(texts):
    rows = N.causal_labels(N.tokenize(texts(SAMPLES), "text", 6, padding=True, pad_id=50256), 50256).orderBy("id").collect()
    for row, text in zip(rows, SAMPLES):
        ids = ids_by_library(text)[:6]
        assert row.input_ids == ids + [50256] * (6 - len(ids))
        assert row.attention_mask == [1] * len(ids) + [0] * (6 - len(ids))
        assert row.token_count == 6
        assert row.labels == [i if i != 50256 else -100 for i in row.input_ids]
    with pytest.raises(ValueError):
        N.tokenize(texts(SAMPLES), "text", padding=True)


def test_batches_pad_to_their_own_longest(texts):
    rows = N.tokenize_batches(texts(SAMPLES), "text", "id", batch_size=2, pad_id=0).orderBy("id").collect()
    true = [len(ids_by_library(t)) for t in SAMPLES]
    longest = [max(true[0], true[1])] * 2 + [max(true[2], true[3])] * 2 + [true[4]]
    assert [r.true_tokens for r in rows] == true
    assert [r.token_count for r in rows] == longest == [len(r.input_ids) for r in rows] == [len(r.attention_mask) for r in rows]
    assert [sum(r.attention_mask) for r in rows] == true


def test_round_trip_and_stats(texts):
    audit = N.round_trip_audit(texts(SAMPLES), "text").first()
    assert (audit.rows, audit.changed) == (5, 0)
    stats = N.token_stats(N.count_tokens(texts(SAMPLES), "text")).first()
    counts = [len(ids_by_library(t)) for t in SAMPLES]
    assert tuple(stats) == (5, round(float(np.mean(counts)), 2), min(counts), max(counts))
    assert tuple(N.token_stats(N.count_tokens(texts(["x"]).where("id < 0"), "text")).first()) == (0, 0.0, 0, 0)
    assert default_vocabulary().endswith(".tiktoken")


def test_preprocess_job(texts, spark, tmp_path):
    df = texts([" Same  text here. ", "Same text here.", "Other words. More words.", None]).withColumn("extra", F.lit(1))
    config = PreprocessConfig(chunk=True, max_length=12, chunk_overlap=0)
    rows = preprocess(df, "text", "id", config).orderBy("id", "text").collect()
    assert [(r.id, r.text) for r in rows] == [(0, "Same text here."), (2, "More words."), (2, "Other words."), (3, "nan")]
    stats = processing_stats(df, preprocess(df, "text", "id", config)).first()
    assert (stats.original_samples, stats.final_samples, stats.removed_samples) == (4, 4, 0)
    saved = preprocess_and_save(df, "text", "id", str(tmp_path), "r1", config)
    assert saved["processing_stats"] == {k: stats[k] for k in saved["processing_stats"]}
    back = spark.read.json(saved["processed_dataset_path"])
    assert back.count() == 4 and set(back.columns) == {"id", "text", "extra", "token_count"}


def test_templates_come_before_chunks_and_stages_can_be_added(texts):
    config = PreprocessConfig(template="completion", template_mapping={"text": "text", "completion": "id"})
    rows = preprocess(texts(["b.", "a."]), "text", "id", config).orderBy("id").collect()
    assert [r.text for r in rows] == ["b.0", "a.1"]
    doubled = run_stages(texts(["b"]), [lambda d: d.withColumn("text", F.repeat("text", 2)), lambda d: d.where("id = 0")])
    assert doubled.first().text == "bb"


def test_windows_lose_no_id_and_pad_to_length(spark):
    rows = spark.createDataFrame([(1, list(range(1, 12))), (2, []), (3, [5] * 4)], "id int, ids array<int>")
    got = {(r.id, r.window): (r.ids, r.attention_mask, r.token_count) for r in N.cut_windows(rows, "ids", 4, padding=True).collect()}
    assert got[(1, 2)] == ([9, 10, 11, 0], [1, 1, 1, 0], 4) and got[(2, 0)] == ([0] * 4, [0] * 4, 4) and len(got) == 5
    loose = {(r.id, r.window): r.ids for r in N.cut_windows(rows, "ids", 4).collect()}
    assert sum((loose[(1, k)] for k in range(3)), []) == list(range(1, 12)) and loose[(2, 0)] == []


def test_byte_ids(evaluate):
    texts = ["aé", "", None, "\x00z"]
    assert evaluate(texts, N.byte_ids(F.col("text"))) == [[b + 1 for b in (t or "").encode()] for t in texts]


def test_batches_hold_their_number_of_rows_beside_a_far_id(spark):
    ids = [*range(100), 10**17]
    rows = spark.createDataFrame([(i, [1] * (k % 7)) for k, i in enumerate(ids)], "id bigint, ids array<int>").repartition(4)
    got = N.batch_rows(rows, "ids", "id", batch_size=10).collect()
    assert {r.id: r.batch_id for r in got} == {i: k // 10 for k, i in enumerate(ids)}
    for r in got:
        own = [len(range(k % 7)) for k in range(101) if k // 10 == r.batch_id]
        assert r.token_count == max(own) == len(r.ids) and sum(r.attention_mask) == r.true_tokens
