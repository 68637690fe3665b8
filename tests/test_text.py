import random
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators.clean import clean_column

RELAXED = settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
ANY_TEXT = st.text(st.characters(exclude_categories=["Cs"]), max_size=40)
# Characters the rules are about, so that random texts hit them often.
TRICKY = st.text(
    st.sampled_from(list("ab1_é٣ \t\n\x00\x0b\x0c\x1c\x1f\x7f\x85\xa0@.%+-|/:") + ["\u2003", "\u3000", "\ufb01", "\uff21", "\u0301", "\u200b"]),
    max_size=30,
)
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
DIRTY = [
    "", "   ", "\x00a\x0bb\x0cc\x1fd\x7fe", "a\x85b\xa0c\u2003d\u3000e", "ﬁ Ａ ① ½", "e\u0301",
    "see http://x.org/a?b=1 and mail a.b@c.org now", "é@x.org ée@x.org", "\ufffd kept", "http s://no",
    "https://x\u2003y", "a|b@c.d|e", "x@y.zz|", "\x1c\x1d lead",
]


def spec_whitespace(text):
    return re.sub(r"\s+", " ", text).strip()


def spec_clean(text, aggressive=False):
    text = unicodedata.normalize("NFKC", text)
    text = spec_whitespace(re.sub(r"[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F]", "", text))
    if aggressive:
        text = re.sub(r"http[s]?://\S+", "", text)
        text = spec_whitespace(re.sub(EMAIL, "", text))
    return text


def test_stable_ranges_need_no_normalising():
    chars = [chr(c) for low, high in X.NFKC_STABLE for c in range(low, high + 1)]
    assert all(unicodedata.is_normalized("NFKC", c) and not unicodedata.combining(c) for c in chars)
    mixed = "".join(random.Random(1).choices(chars, k=200_000))
    assert unicodedata.normalize("NFKC", mixed) == mixed


def test_space_points_are_python_spaces():
    assert [c for c in range(0x110000) if chr(c).isspace()] == X.SPACE_POINTS


@pytest.mark.parametrize("aggressive", [False, True])
def test_clean_fixture(evaluate, aggressive):
    got = evaluate(DIRTY, X.clean_text(F.col("text"), aggressive))
    assert got == [spec_clean(t, aggressive) for t in DIRTY]


@RELAXED
@given(st.lists(st.one_of(ANY_TEXT, TRICKY), min_size=1, max_size=40))
def test_clean_any_text(evaluate, values):
    assert evaluate(values, X.clean_text(F.col("text"), True)) == [spec_clean(t, True) for t in values]


@RELAXED
@given(st.lists(TRICKY, min_size=1, max_size=40))
def test_single_steps(evaluate, values):
    text = F.col("text")
    assert evaluate(values, X.normalize_whitespace(text)) == [spec_whitespace(t) for t in values]
    assert evaluate(values, X.strip(text)) == [t.strip() for t in values]
    assert evaluate(values, X.normalize_unicode(text)) == [unicodedata.normalize("NFKC", t) for t in values]


def test_pii_predicates(evaluate):
    values = [
        "a@b.org", "é@b.org", "x a@b.org.", "no at b.org", "call 555-123-4567", "5551234567", "555.123.4567",
        "15551234567", "x555-123-4567", "ssn 123-45-6789", "1123-45-6789", "١٢٣-٤٥-٦٧٨٩", "123-45-67890",
    ]
    patterns = {
        "email": EMAIL, "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    }
    for kind, pattern in patterns.items():
        got = evaluate(values, X.PII_PREDICATES[kind](F.col("text")))
        assert got == [bool(re.search(pattern, t)) for t in values], kind


def test_invalid_bytes_are_dropped_and_valid_text_is_kept(spark):
    rows = spark.sql("SELECT cast(x as string) AS text FROM VALUES (X'61FF62'), (X'61EFBFBD62') AS t(x)")
    assert [r[0] for r in rows.select(X.fix_encoding(F.col("text"))).collect()] == ["ab", "a\ufffdb"]


def test_null_policies(texts):
    df = texts([None, " a  b "])

    def out(policy):
        return [r.text for r in clean_column(df, "text", null_policy=policy).orderBy("id").collect()]

    assert out("literal") == ["nan", "a b"]
    assert out("keep") == [None, "a b"]
    assert out("drop") == ["a b"]
    with pytest.raises(ValueError):
        out("other")
