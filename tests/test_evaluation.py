import math
import random
from collections import Counter

import pytest

from corpusloom.functions.stemming import stem
from corpusloom.operators import compare as C
from corpusloom.operators import evaluate as E
from corpusloom.plans.preparation import evaluate_and_compare

PAIRS = [
    ("the cat sat on the mat", "the cat sat on the mat"),
    ("  The CAT sat. ", "the cat sat."),
    ("", "something"),
    ("something", ""),
    ("", ""),
    ("word", "word"),
    ("a a a a b a a", "a b a b a"),
    ("running runs quickly, 1,000.5 times-2!", "run run quick 1,000.5 time-2"),
    ("smile 😀, ok &amp; fine &lt;tag&gt;", "smile 😀 , ok & fine <tag>"),
    ("line one\nline-\ntwo", "line one line two"),
    ("one,,two..3,4,,5 x.y", "one,two.3,4,5 x . y"),
]


def spec_13a(text):
    """The published tokenisation, stated with Python's own patterns."""
    import re

    text = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for entity, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = text.replace(entity, char)
    text = f" {text} "
    text = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", text)
    text = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", text)
    text = re.sub(r"([\.,])([^0-9])", r" \1 \2", text)
    text = re.sub(r"([0-9])(-)", r"\1 \2 ", text)
    return text.split()


def grams(tokens, n):
    return Counter(tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1))


def spec_bleu(pairs):
    match, total, mine, theirs = [0] * 4, [0] * 4, 0, 0
    for left, right in pairs:
        a, b = spec_13a(left), spec_13a(right)
        mine, theirs = mine + len(a), theirs + len(b)
        for n in range(1, 5):
            match[n - 1] += sum((grams(a, n) & grams(b, n)).values())
            total[n - 1] += max(len(a) - n + 1, 0)
    if not match[0] or not all(total):
        return 0.0
    smooth, logs = 1.0, 0.0
    for m, t in zip(match, total):
        if m == 0:
            smooth *= 2
        logs += math.log(m / t if m else 1 / (smooth * t))
    brevity = 1.0 if mine > theirs else math.exp(1 - theirs / mine)
    return 100 * brevity * math.exp(logs / 4)


def spec_rouge(left, right, stemming):
    import re

    def tokens(text):
        words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
        return [stem(w) if stemming and len(w) > 3 else w for w in words]

    a, b = tokens(left), tokens(right)

    def f(match, x, y):
        return 0.0 if match == 0 else 2 * match / (x + y)

    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    out = []
    for n in (1, 2):
        p, r = grams(a, n), grams(b, n)
        out.append(f(sum((p & r).values()), sum(p.values()), sum(r.values())))
    return [*out, f(table[-1][-1], len(a), len(b))]


@pytest.fixture
def pairs(spark):
    def make(values):
        rows = [(i, p, r) for i, (p, r) in enumerate(values)]
        return spark.createDataFrame(rows, "id bigint, prediction string, reference string")

    return make


def random_pairs(seed, n=60):
    rng = random.Random(seed)
    words = ["alpha", "beta", "running", "1,5", "x.", "é", "cats", "(a)", "it's"]
    return [tuple(" ".join(rng.choices(words, k=rng.randint(0, 25))) for _ in range(2)) for _ in range(n)]


@pytest.mark.parametrize("values", [PAIRS, random_pairs(1), random_pairs(2), [("a b", "a b")], [("x", "y")], [("", "")]])
def test_scores_equal_the_definitions(pairs, values):
    assert math.isclose(E.corpus_bleu(pairs(values)).first().bleu, spec_bleu(values), rel_tol=1e-9, abs_tol=1e-12)
    for stemming in (True, False):
        rows = E.pair_scores(pairs(values), keep=["id"], stemming=stemming).orderBy("id").collect()
        for row, (left, right) in zip(rows, values):
            assert [row.rouge1, row.rouge2, row.rougeL] == pytest.approx(spec_rouge(left, right, stemming))
            assert row.exact == int(left.strip() == right.strip())


def test_smoothing_of_orders_without_a_match(pairs):
    values = [("a b c d e", "a x c y e")]
    assert math.isclose(E.corpus_bleu(pairs(values)).first().bleu, spec_bleu(values), rel_tol=1e-12)


def test_blocks_do_not_change_the_counts(pairs, monkeypatch):
    import numpy as np

    from corpusloom.functions import scoring

    bounds = np.array([0, 5, 5, 30, 31])
    monkeypatch.setattr(scoring, "_BLOCK_TOKENS", 6)
    assert list(scoring._blocks(bounds)) == [(0, 2), (2, 3), (3, 4)]


def test_stems():
    known = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster",
        "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall",
        "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam",
        "triplicate": "triplic", "formative": "form", "electrical": "electr", "hopefulness": "hope", "revival": "reviv",
        "allowance": "allow", "adjustable": "adjust", "adoption": "adopt", "probate": "probat", "controlling": "control",
        "dying": "die", "news": "news", "enjoy": "enjoy", "died": "die", "generalizations": "gener", "oscillators": "oscil",
    }
    assert {word: stem(word) for word in known} == known


def test_pairs_perplexity_f1(spark, pairs):
    samples = spark.createDataFrame([(1, "in", "lab")], "id bigint, text string, label string")
    predicted = spark.createDataFrame([(1, "p"), (2, "q")], "id bigint, prediction string")
    assert E.extract_pairs(samples, predicted, "id").collect()[0].asDict() == {
        "id": 1, "input": "in", "reference": "lab", "prediction": "p",
    }
    losses = spark.createDataFrame([(1.0, 3), (2.0, 1)], "loss double, n int")
    assert E.perplexity(losses, "loss", "n").first()[0] == pytest.approx(math.exp(5 / 4))
    assert E.perplexity(losses.where("n > 5"), "loss", "n").first()[0] == float("inf")
    judged = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "guess string, label string")
    f1 = E.f1_scores(judged, "guess", "label").first()
    assert f1.f1_micro == pytest.approx(0.5) and f1.f1_macro == pytest.approx((0.5 + 2 / 3 + 0) / 3)
    assert E.exact_match(pairs([(" a", "a "), ("b", "c")])).first().accuracy == 0.5
    assert E.exact_match(pairs([("a", "a")]).where("id < 0")).first().accuracy == 0.0


def test_comparison(spark):
    metrics = spark.createDataFrame(
        [("b", "bleu", 10.0), ("t", "bleu", 15.0), ("b", "perplexity", 4.0), ("t", "perplexity", 3.0),
         ("b", "zero", 0.0), ("t", "zero", 2.0), ("b", "minus", -1.0), ("t", "minus", 1.0), ("t", "only", 1.0)],
        "model string, metric string, value double",
    )
    compared = C.compare_models(metrics, "b", "t")
    assert {r.metric: (r.absolute, r.relative_percent) for r in compared.collect()} == {
        "bleu": (5.0, 50.0), "perplexity": (-1.0, 25.0), "zero": (2.0, 0.0), "minus": (2.0, 0.0),
    }
    table = C.comparison_table(compared).collect()
    assert [(r.metric, r.base_model, r.improvement) for r in table] == [
        ("bleu", "10.0000", "+50.00%"), ("minus", "-1.0000", "0.00%"),
        ("perplexity", "4.0000", "+25.00%"), ("zero", "0.0000", "0.00%"),
    ]
    assert tuple(C.comparison_summary(compared).first()) == (2, 4, "bleu", 50.0)
    report = C.comparison_report(compared).first().report
    assert "| bleu | 10.0000 | 15.0000 | +50.00% |\n| minus" in report
    assert report.endswith("- **Metrics improved**: 2/4\n- **Best improvement**: bleu (50.00%)\n")
    responses = spark.createDataFrame(
        [(1, "b", 10, 100), (1, "t", 12, 80), (2, "b", 5, 50)], "id int, model string, tokens int, latency_ms int"
    )
    deltas = C.paired_response_delta(responses, "b", "t", "id")
    assert [tuple(r) for r in deltas.collect()] == [(1, 2, -20)]
    assert tuple(C.delta_summary(deltas).first()) == (1, 2.0, -20.0, 1)


def test_two_models_end_to_end(spark):
    rows = [("base", i, p, r) for i, (p, r) in enumerate(random_pairs(3))]
    rows += [("tuned", i, r, r) for i, (_, r) in enumerate(random_pairs(3))]
    table = spark.createDataFrame(rows, "model string, id bigint, prediction string, reference string")
    got = {r.metric: r for r in evaluate_and_compare(table, "base", "tuned").collect()}
    assert set(got) == {"bleu", "rouge1", "rouge2", "rougeL", "accuracy"}
    assert got["bleu"].tuned_value == pytest.approx(100.0)
    assert got["bleu"].base_value == pytest.approx(spec_bleu(random_pairs(3)))
