"""The trained operators against plain Python: language profiles and the ordinal fit."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import language_id, quality

SPEECH = {
    "aa": "abendar lomi ester ulamin dor".split(), "bb": "krzek wystrz pchla zdrow mgnie".split(), "cc": "ñandú él ciónes años über".split(),
}


def letter_vector(letter):
    code = 0 if letter == " " else ord(letter)
    bits = np.random.default_rng([language_id.SEED, code]).integers(0, 2, language_id.DIMENSIONS, dtype=np.int8)
    return [2 * int(b) - 1 for b in bits]


def bundle(text, letters):
    kept = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    if not kept.strip():
        return None
    kept, total = f" {' '.join(kept.split())} ", [0] * language_id.DIMENSIONS
    for (a, b, c), n in Counter(zip(kept, kept[1:], kept[2:], strict=False)).items():
        x, y, z = (letters.setdefault(k, letter_vector(k)) for k in (a, b, c))
        for i in range(language_id.DIMENSIONS):
            total[i] += n * x[i - 2] * y[i - 1] * z[i]
    return total


def unit(vector):
    norm = math.sqrt(sum(v * v for v in vector))
    return [v / norm for v in vector]


def test_language_equals_plain_vectors(spark):
    r, rows = random.Random(3), []
    for k in range(36):
        lang = r.choice(list(SPEECH))
        text = ", ".join(r.choice(SPEECH[lang]) for _ in range(r.randrange(1, 9))) + r.choice(["", " 12!", " X"])
        rows.append((k, text, r.choice([lang, lang, lang, None])))
    rows += [(100, None, "aa"), (101, "12 34", "bb"), (None, "lomi ester", "aa")]
    letters, sums = {}, {}
    for doc, text, lang in rows:
        if lang is not None and zlib.crc32(str("" if doc is None else doc).encode()) % 4 != 2:
            vector = bundle(text, letters)
            if vector is not None:
                sums[lang] = [a + b for a, b in zip(sums.get(lang, [0] * len(vector)), unit(vector), strict=True)]
    wanted = {}
    for doc, text, _ in rows:
        vector = bundle(text, letters)
        if vector is None:
            wanted[doc] = ("und", 0.0)
            continue
        scores = {lang: sum(a * b for a, b in zip(unit(vector), unit(total), strict=True)) for lang, total in sums.items()}
        best = max(sorted(scores), key=scores.get)
        wanted[doc] = (best, min(max(scores[best], 0.0), 1.0))
    got = language_id.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)).collect()
    assert {x.doc_id: x.lang_pred for x in got} == {k: v[0] for k, v in wanted.items()}
    assert {x.doc_id: x.score for x in got} == pytest.approx({k: v[1] for k, v in wanted.items()}, abs=1e-5)


def plain_loss(x, rows, weights, penalty):
    w, cuts, total = x[:3], (x[3], x[3] + math.exp(x[4])), 0.0
    for features, grade in rows:
        score = sum(w[i] * v for i, v in features)
        above = [1.0, *[1 / (1 + math.exp(c - score)) for c in cuts], 0.0]
        total -= weights[grade] * math.log(above[grade] - above[grade + 1])
    return total + penalty / 2 * sum(v * v for v in w)


def test_fit_equals_a_plain_descent():
    r, rows = random.Random(11), []
    for _ in range(150):
        a, b = r.gauss(0, 1), r.gauss(0, 1)
        noisy = 1.5 * a - b + r.gauss(0, 0.7)
        rows.append(([(0, a), (1, b), (2, 1.0)], 0 if noisy < -1 else 1 if noisy < 0.8 else 2))
    seen = Counter(g for _, g in rows)
    weights = {g: min(max(len(rows) / (3 * seen[g]), 1.0), quality.RARE_WEIGHT) for g in range(3)}
    x, step = [0.0, 0.0, 0.0, -1.0, 0.0], 0.01
    value = plain_loss(x, rows, weights, 0.5)
    for _ in range(300):  # descent along numeric slopes, the step halved or grown
        slope = []
        for i in range(5):
            up, down = list(x), list(x)
            up[i] += 1e-5
            down[i] -= 1e-5
            slope.append((plain_loss(up, rows, weights, 0.5) - plain_loss(down, rows, weights, 0.5)) / 2e-5)
        new = [a - step * g for a, g in zip(x, slope, strict=True)]
        new_value = plain_loss(new, rows, weights, 0.5)
        if new_value < value:
            x, value, step = new, new_value, step * 1.3
        else:
            step /= 2
    index = np.array([i for f, _ in rows for i, _ in f])
    amounts = np.array([v for f, _ in rows for _, v in f])
    model = quality.fit(index, amounts, np.arange(0, 3 * len(rows), 3), np.array([g for _, g in rows]), 3, size=3, steps=200, penalty=0.5)
    found = [*map(float, model.weights), float(model.thresholds[0]), math.log(model.thresholds[1] - model.thresholds[0])]
    assert plain_loss(found, rows, weights, 0.5) <= value + 0.02
    scores = [sum(model.weights[i] * v for i, v in f) for f, _ in rows]
    plain = [sum(x[i] * v for i, v in f) for f, _ in rows]
    tails = model.tails(np.array(scores))
    wanted = [[1 / (1 + math.exp(c - s)) for c in (x[3], x[3] + math.exp(x[4]))] for s in plain]
    assert np.abs(tails - np.array(wanted)).max() < 0.02
