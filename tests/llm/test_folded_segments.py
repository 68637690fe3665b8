"""Suffix arrays over segments whose bytes from the anchor on are one letter."""

import random
from collections import Counter, defaultdict

import numpy as np

from corpusloom.llm import suffix_dedup


def segments_by_anchor(texts, length, gram):
    out = defaultdict(dict)
    for t in texts:
        anchors, segments, low, high = suffix_dedup.anchored(np.frombuffer(t, np.uint8), length, gram)
        for a, s, x, y in zip(anchors.tolist(), segments.tolist(), low.tolist(), high.tolist(), strict=True):
            out[a][s] = t[x:y]
    return {a: list(v.values()) for a, v in out.items() if len(v) > 1}


def test_repeats_of_folded_segments_against_brute_force():
    r, groups, hits, whole, sorted_ = random.Random(3), 0, 0, 0, 0
    for letters in (b"ab", b"abcdefgh", bytes(range(0xC0, 0xF5))):
        pieces = [bytes(r.choices(letters, k=r.randrange(20, 60))) for _ in range(12)] + [bytes(r.choices(letters, k=3)) * 12]
        texts = [b"".join(bytes(r.choices(letters, k=r.randrange(8))) + p for p in r.choices(pieces, k=8)) for _ in range(60)]
        for anchor, segments in segments_by_anchor(texts, 24, 8).items():
            arrays = suffix_dedup.folded(segments, anchor, 8)
            assert len({(s[len(a) - 1 :][:8]) for s, a in zip(segments, arrays, strict=True)}) == 1
            got = suffix_dedup.repeated_starts(segments, 24, anchor, 8)
            seen = Counter(s[i : i + 24] for s in segments for i in range(len(s) - 23))
            for s, a, starts in zip(segments, arrays, got, strict=True):
                assert starts.tolist() == [i for i in range(len(s) - 23) if seen[s[i : i + 24]] > 1]
                assert len(a) >= len(s) - 23  # every string of the segment starts in the array
                hits += len(starts)
                whole += len(s)
                sorted_ += len(a)
            groups += 1
    assert groups > 50 and hits > 500
    assert sorted_ < 0.6 * whole
