"""Repeated strings where texts are longer than the tables of powers."""

import hashlib
import random
from collections import defaultdict

import numpy as np

from corpusloom.llm import suffix_dedup


def test_hashes_stay_the_same_while_the_powers_grow():
    data = np.frombuffer(random.Random(1).randbytes(500), np.uint8)
    suffix_dedup._POWERS.clear()
    before = suffix_dedup.anchored(data, 200, 64)
    for n in (1 << 18, 1 << 19):
        suffix_dedup._powers(n)
        for old, new in zip(before, suffix_dedup.anchored(data, 200, 64), strict=True):
            assert (old == new).all()


def test_long_and_short_texts_share_their_strings(spark):
    r = random.Random(2)

    def letters(n):
        return "".join(r.choices("abcdefgh ", k=n))

    shared = [letters(260) for _ in range(4)]
    texts = [
        shared[0] + letters(50), letters(140_000) + shared[0] + letters(10) + shared[1], letters(30) + shared[1],
        letters(290_000) + shared[2], shared[2] + shared[3], letters(7) + shared[3], "q" * 450, None, "ä" * 150, "ü" * 90,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    got = {x.doc_id: x for x in suffix_dedup.suffix_dedup(docs).collect()}
    data = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for d in data:
        for k in range(len(d) - 199):
            seen[hash(d[k : k + 200])] += 1
    for i, d in enumerate(data):
        gone = np.zeros(len(d), bool)
        for k in range(len(d) - 199):
            if seen[hash(d[k : k + 200])] > 1:
                gone[k : k + 200] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(d), gone.sum(), spans, kept)
    assert got[0].n_removed == 260 and got[6].n_removed == 450
