"""Masking of personal data, card numbers, and quality flags per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import PII_PATTERNS, has_encoding_issue
from corpusloom.operators.profile import as_text
from corpusloom.operators.validate import MIN_TEXT_LENGTH

# Fixed value: a card number has 13 to 19 digits, in groups parted by single blanks or hyphens.
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
MASKS = {"email": "[EMAIL]", "phone": "[PHONE]", "ssn": "[SSN]"}
CARD_MASK = "[CARD]"


def passes_luhn(number: Column) -> Column:
    """Luhn check of the digits of a text: from the right, every second digit counts double."""
    digits = F.regexp_replace(number, "[^0-9]", "")
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, k: _luhn(d.cast("int"), k))
    return F.aggregate(places, F.lit(0), lambda total, d: total + F.coalesce(d, F.lit(0))) % 10 == 0


def _luhn(digit: Column, place: Column) -> Column:
    doubled = digit * 2
    return F.when(place % 2 == 1, doubled - F.when(doubled > 9, 9).otherwise(0)).otherwise(digit)


def card_numbers(text: Column) -> Column:
    """The card numbers of a text, as written: runs of 13 to 19 digits that pass the Luhn check."""
    return F.filter(F.regexp_extract_all(text, F.lit(CARD), F.lit(0)), passes_luhn)


def redact(text: Column) -> Column:
    """The text with e-mail addresses, social security numbers, card and phone numbers masked; null stays null.

    Card numbers are masked first, one replacement for each valid number.
    """
    out = F.aggregate(card_numbers(text), text, lambda t, card: F.replace(t, card, F.lit(CARD_MASK)))
    for kind in ("email", "ssn", "phone"):
        out = F.regexp_replace(out, PII_PATTERNS[kind], MASKS[kind])
    return F.when(text.isNotNull(), out)


def pii_redact(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn(text, redact(F.col(text)))


def quality_flags(df: DataFrame, text: str) -> DataFrame:
    """Add too_short, encoding_issue and low_quality: the predicates behind the counts, kept per row."""
    read = as_text(df, text)
    short, broken = F.length(read) < MIN_TEXT_LENGTH, has_encoding_issue(read)
    return df.withColumns({"too_short": short, "encoding_issue": broken, "low_quality": short | broken})
