"""Row-wise cleaning: keys for comparing, printable text, redaction, coercion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# HTML entities of titles, and what they stand for; the ampersand comes last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}
# Blanks and invisible characters that become a plain blank in shown text.
ODD_BLANKS = " ​‌‍   ⁠　﻿"
# Parts of a key whose value is secret.
SECRET_KEYS = "key|token|secret|password"


def unescape(text: Column) -> Column:
    """HTML entities replaced once."""
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def title_key(text: Column) -> Column:
    """Key of a title: unescaped, lower case, only a-z, 0-9 and blanks, trimmed (inner runs of blanks stay)."""
    return F.trim(F.regexp_replace(F.lower(unescape(text)), "[^a-z0-9 ]", ""))


def match_key(text: Column, length: int = 80) -> Column:
    """Key for matching answers to questions: lower case letters and digits only, the first ``length`` of them."""
    return F.left(F.regexp_replace(F.lower(text), "[^a-z0-9]", ""), F.lit(length))


def shown(text: Column) -> Column:
    """Text for showing: odd blanks to blanks, control characters but line ends out, runs of blanks to one, trimmed."""
    plain = F.translate(text, ODD_BLANKS, " " * len(ODD_BLANKS))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[\x00-\x09\x0B-\x1F]", ""), r"(?U)\s+", " "))


def redacted(values: Column, length: int = 500) -> Column:
    """A map whose secret keys are masked and whose other values are cut at ``length``."""
    return F.transform_values(values, lambda k, v: F.when(F.lower(k).rlike(SECRET_KEYS), "<redacted>").otherwise(F.left(v, F.lit(length))))


def blank_to_null(text: Column) -> Column:
    """NULL for texts that say there is nothing."""
    return F.when(~F.lower(F.trim(text)).isin("", "none", "n/a", "null", "not applicable"), text)


def clamp(value: int, low: int, high: int) -> int:
    """An argument forced into a range, while the plan is built."""
    return max(low, min(high, value))


def has_fence(text: Column) -> Column:
    """Whether an answer holds a code fence."""
    return F.contains(text, F.lit("```"))


def has_preamble(text: Column) -> Column:
    """Whether an answer starts with neither an object nor a fence."""
    t = F.trim(text)
    return ~(F.startswith(t, F.lit("{")) | F.startswith(t, F.lit("```")))
