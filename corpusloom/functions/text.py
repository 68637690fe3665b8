"""Column expressions for text clean-up and text predicates.

Every expression stays in the JVM. The one exception is NFKC, which Spark
lacks: the Python worker sees only the rows whose text can change.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The code points that Python's ``str.isspace`` and ``\\s`` accept.
SPACE_POINTS = [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
WHITESPACE_CHARS = "".join(map(chr, SPACE_POINTS))


def _points(points: list[int]) -> str:
    """Code points one by one: below 256 a regex engine keeps them in one bit table."""
    return "".join(rf"\x{{{p:X}}}" for p in points)


# Classes are written for speed in Java's engine: no negation and no character
# beyond 16 bits, which would switch it to slower matching by code point, and
# ``[\x80-\xFFFF&&[...]]`` around the rest, which rules out the usual character
# by one comparison instead of one per range. Half of a wider character counts
# as a character of its own here and is never white space.
_BEYOND_ASCII = r"\x{80}-\x{FFFF}"
_NARROW_SPACES = [p for p in SPACE_POINTS if p < 0x80 and p != 0x20]
_WIDE_SPACES = _points([p for p in SPACE_POINTS if p >= 0x80 and not 0x2000 <= p <= 0x200A]) + r"\x{2000}-\x{200A}"
_WS_NOT_SPACE = rf"{_points(_NARROW_SPACES)}[{_BEYOND_ASCII}&&[{_WIDE_SPACES}]]"
WS = rf"[ {_WS_NOT_SPACE}]"
NOT_WS = rf"[^ {_points(_NARROW_SPACES)}{_WIDE_SPACES}]"

_WS_RUN = rf"{WS}+"

# Control characters removed by cleaning (with DEL) and those
# reported as encoding issues (without DEL).
_KEPT_CONTROLS = (0x09, 0x0A, 0x0D)
_CONTROL_POINTS = [p for p in range(0x20) if p not in _KEPT_CONTROLS]
CONTROL_CHARS = f"[{_points([*_CONTROL_POINTS, 0x7F])}]"
ENCODING_ISSUE_CHARS = f"[{_points(_CONTROL_POINTS)}]"

# Python's word character is any letter, any number or the underscore.
_W = r"[\p{L}\p{N}_]"
_EDGE = rf"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"

# Patterns for personal data, in reporting order.
EMAIL = rf"{_EDGE}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}{_EDGE}"
_D = r"[0-9[\x{80}-\x{10FFFF}&&\p{Nd}]]"
PHONE = rf"{_EDGE}{_D}{{3}}[-.]?{_D}{{3}}[-.]?{_D}{{4}}{_EDGE}"
SSN = rf"{_EDGE}{_D}{{3}}-{_D}{{2}}-{_D}{{4}}{_EDGE}"
URL = rf"https?://{NOT_WS}+"

# Ranges in which every character, alone or next to any other
# of them, is already in NFKC form. Text made only of these needs no Python.
NFKC_STABLE = [
    (0x00, 0x7F), (0xA1, 0xA7), (0xA9, 0xA9), (0xAB, 0xAE), (0xB0, 0xB1), (0xB6, 0xB7),
    (0xBB, 0xBB), (0xBF, 0x131), (0x134, 0x13E), (0x141, 0x148), (0x14A, 0x17E),
    (0x400, 0x482), (0x48A, 0x52F), (0x2010, 0x2010), (0x2012, 0x2016), (0x2018, 0x2023),
    (0x20A0, 0x20A7), (0x20A9, 0x20C0), (0x3001, 0x3029), (0x3041, 0x3096), (0x30A1, 0x30FA),
    (0x4E00, 0x9FFF), (0xAC00, 0xD7A3),
]


def _outside(ranges: list[tuple[int, int]], low: int, high: int) -> str:
    """Regex ranges for what the sorted ranges leave out between ``low`` and ``high``."""
    gaps = []
    for start, end in ranges:
        if low < start:
            gaps.append(rf"\x{{{low:X}}}-\x{{{start - 1:X}}}")
        low = max(low, end + 1)
    return "".join(gaps) + rf"\x{{{low:X}}}-\x{{{high:X}}}"


# Halves of wider characters lie in a gap, so such text counts as unsure.
_NFKC_UNSURE = rf"[{_BEYOND_ASCII}&&[{_outside(NFKC_STABLE, 0x80, 0xFFFF)}]]"
_REPLACEMENT_CHARACTER = chr(0xFFFD)
_ASIDE = chr(0xFDD0) + chr(0xFDD1)


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    # Arrow's own utf8_normalize gives other results than Python for 75 of 200 whole texts.
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def normalize_unicode(text: Column) -> Column:
    """NFKC form. Rows that cannot change reach Python as null, not as text."""
    may_change = F.when(text.rlike(_NFKC_UNSURE), text)
    return F.coalesce(_nfkc(may_change), text)


def strip(text: Column) -> Column:
    """Remove leading and trailing white space, Unicode spaces included."""
    return F.trim(text, F.lit(WHITESPACE_CHARS))


def normalize_whitespace(text: Column) -> Column:
    """Each run of white space becomes one space; none is left at the ends."""
    return F.trim(F.regexp_replace(text, _WS_RUN, " "))


def remove_control_characters(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL_CHARS, "")


def fix_encoding(text: Column) -> Column:
    """Drop byte sequences that are not UTF-8; valid text is returned untouched.

    A replacement character that is really in the text is put aside as two code
    points that no text may hold, so that only the repaired bytes are dropped.
    """
    marked = F.replace(text, F.lit(_REPLACEMENT_CHARACTER), F.lit(_ASIDE))
    repaired = F.regexp_replace(F.make_valid_utf8(marked), _REPLACEMENT_CHARACTER, "")
    repaired = F.replace(repaired, F.lit(_ASIDE), F.lit(_REPLACEMENT_CHARACTER))
    return F.when(F.is_valid_utf8(text), text).otherwise(repaired)


def remove_urls(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("://")), F.regexp_replace(text, URL, "")).otherwise(text)


def remove_emails(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, EMAIL, "")).otherwise(text)


def clean_text(text: Column, aggressive: bool = False) -> Column:
    """Encoding, NFKC, control characters, white space; then URLs and e-mails if asked."""
    cleaned = normalize_whitespace(remove_control_characters(normalize_unicode(fix_encoding(text))))
    if aggressive:
        cleaned = normalize_whitespace(remove_emails(remove_urls(cleaned)))
    return cleaned


def has_email(text: Column) -> Column:
    return F.contains(text, F.lit("@")) & text.rlike(EMAIL)


def has_phone(text: Column) -> Column:
    return text.rlike(PHONE)


def has_ssn(text: Column) -> Column:
    return F.contains(text, F.lit("-")) & text.rlike(SSN)


# The kinds of personal data looked for, in reporting order.
PII_PATTERNS = {"email": EMAIL, "phone": PHONE, "ssn": SSN}
PII_PREDICATES = {"email": has_email, "phone": has_phone, "ssn": has_ssn}


def has_encoding_issue(text: Column) -> Column:
    return text.rlike(ENCODING_ISSUE_CHARS)


def text_digest(text: Column) -> Column:
    """16-byte key standing for a text where only equality matters; null stays null."""
    return F.unhex(F.md5(text))


def estimated_tokens(text: Column) -> Column:
    """Tokenizer-free size estimate: a quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(text) / F.lit(4))
