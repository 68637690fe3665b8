"""What a worker of the packing operator holds at a time."""

import random
import sys

import pyarrow as pa

from corpusloom.llm import packing


def batch_of(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["id", "text"])


def cut(monkeypatch, batch):
    class Files:
        get = staticmethod(lambda name: name)

    monkeypatch.setattr(packing, "SparkFiles", Files)
    return list(packing._cutter(packing.default_vocabulary(), 64, 0, True)(iter([batch])))


def test_a_large_batch_is_cut_in_portions_with_the_same_pieces(monkeypatch):
    r = random.Random(3)
    words = ["".join(r.choices("abcdefgh", k=r.randrange(1, 9))) for _ in range(500)]
    texts = [" ".join(r.choices(words, k=r.randrange(400))) for _ in range(3_000)] + [None, "", " ".join(words * 800)]
    batch = batch_of(texts)
    assert batch.column(1).nbytes > 4 * packing.PORTION
    found = cut(monkeypatch, batch)
    assert len(found) > 3
    with monkeypatch.context() as m:
        m.setattr(packing, "PORTION", 1 << 40)
        (whole,) = cut(m, batch)
    assert pa.Table.from_batches(found).to_pylist() == whole.to_pylist()
    assert cut(monkeypatch, batch_of([])) == []


def test_the_memory_of_words_stays_in_a_table_of_bounded_size(monkeypatch):
    encoder = packing.Encoder(packing.default_vocabulary())
    encoder.whole = lambda text: b"\0\0\0\0"
    largest = 0
    for k in range(1_450_000):
        encoder[f" {k}"]
        if k % 50_000 == 0:
            largest = max(largest, sys.getsizeof(encoder))
    assert largest < 24 << 20
