"""Text functions as column expressions: all stay inside the JVM."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words too common in contract clauses to say anything.
LEGAL_STOP_WORDS = (
    "shall such any each may will must pursuant hereof hereto herein thereof thereto therein whether respect accordance provided "
    "including means time times date dates clause agreement party parties subject under upon other otherwise person persons applicable"
).split()
# Families of indicators, and the wordings that mention them.
INDICATOR_WORDINGS = {
    "sma_50": ["sma 50", "sma50", "50-day", "50 day", "fifty-day"],
    "sma_200": ["sma 200", "sma200", "200-day", "200 day", "two-hundred-day"],
    "trend_cross": ["golden cross", "death cross", "moving average cross"],
    "rsi": ["rsi", "relative strength", "overbought", "oversold"],
    "macd": ["macd", "signal line", "histogram", "convergence"],
    "bollinger": ["bollinger", "upper band", "lower band", "%b", "band width", "squeeze"],
    "volatility": ["volatility", "annualised vol", "annualized vol"],
    "sentiment": ["sentiment", "headline", "news flow"],
    "valuation": ["p/e", "pe ratio", "price-to-earnings", "valuation", "multiple"],
    "price_action": ["52-week", "52 week", "ytd", "year-to-date", "momentum"],
}
# Stems that relate two observations.
RELATIONAL_STEMS = [
    "confirm", "corroborat", "consistent with", "reinforce", "align", "diverg", "conflict", "contradict", "disagree", "tension", "at odds",
    "despite", "however", "although", "whereas", "while", "but ", "offset", "outweigh", "override", "dominat", "on balance", "net of",
    "combined", "together", "taken as a whole", "in aggregate", "suggests that", "implies", "points to", "indicat",
]
# Signs of currencies; wordings, states and names of errors.
CURRENCY_SIGNS = {"USD": "$", "GBP": "£", "EUR": "€", "LKR": "Rs "}
MALFORMED_CALLS = ["tool_use_failed", "failed to parse tool call", "failed_generation", "invalid tool call"]
RETRYABLE_STATUS = [408, 409, 413, 429, 500, 502, 503, 504]
RETRYABLE_ERRORS = ["RateLimitError", "APITimeoutError", "APIConnectionError", "InternalServerError"]
# Patterns of abbreviations, numbers, tokens.
ABBREVIATION = r"(?i)\b(?:e\.g|i\.e|vs|etc|approx|Inc|Corp|Ltd|Q[1-4])\."
NUMBER = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
OVERLAP_TOKEN = "[a-z0-9_.:%-]+"
KEYWORD = r"[a-z][a-z\-']{3,}"
_MARKS = re.compile(r'\\.|[{}"]', re.S)
TERM = r"[\p{L}\p{N}_]{2,}"


def words(text: Column) -> Column:
    """Number of blank-separated words; 0 for an empty or blank text."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"(?U)\s+")))


def sentences(text: Column) -> Column:
    """Number of pieces between runs of closing marks; marks in decimal numbers and behind a few short forms close nothing."""
    masked = F.regexp_replace(F.regexp_replace(text, r"\d+\.\d+", "0"), ABBREVIATION, "X")
    return F.size(F.filter(F.split(masked, r"[.!?]+(?:\s|$)"), lambda x: F.trim(x) != ""))


def indicators_mentioned(text: Column) -> Column:
    """Sorted families of indicators that a text mentions."""
    lower = F.lower(text)
    hit = [F.when(F.array_contains(F.transform(F.array(*map(F.lit, w)), lambda x: F.contains(lower, x)), True), F.lit(k)) for k, w in INDICATOR_WORDINGS.items()]
    return F.array_sort(F.array_compact(F.array(*hit)))


def has_relation(text: Column) -> Column:
    """Whether a text relates observations to each other."""
    lower = F.lower(text)
    return F.exists(F.array(*map(F.lit, RELATIONAL_STEMS)), lambda x: F.contains(lower, x))


def all_matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def keywords(text: Column) -> Column:
    """Keyword tokens of a text, in order and with repeats, without stop words."""
    stop = F.array(*map(F.lit, LEGAL_STOP_WORDS))
    return F.filter(all_matches(F.lower(text), KEYWORD), lambda x: ~F.array_contains(stop, x))


def overlap_tokens(text: Column) -> Column:
    """Tokens for measures of overlap."""
    return all_matches(F.lower(F.coalesce(text, F.lit(""))), OVERLAP_TOKEN)


def terms(text: Column) -> Column:
    """Unicode word tokens of at least two characters, lower case."""
    return all_matches(F.lower(text), TERM)


def grams(tokens: Column) -> Column:
    """The tokens and their neighbouring pairs."""
    last = F.greatest(F.size(tokens) - 1, F.lit(0))  # slices, as a lambda would work out the tokens anew at each element
    return F.concat(tokens, F.zip_with(F.slice(tokens, 1, last), F.slice(tokens, 2, last), lambda a, b: F.concat_ws(" ", a, b)))


def numbers(text: Column) -> Column:
    """Distinct numbers of a text, thousands separators read."""
    return F.array_distinct(F.transform(all_matches(F.coalesce(text, F.lit("")), NUMBER), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")))


def numbers_found(term: Column, text: Column) -> Column:
    """Whether a term has numbers and each is among those of the text, to one in a million."""
    own, there = numbers(term), numbers(text)
    near = F.forall(own, lambda v: F.exists(there, lambda c: F.abs(v - c) <= F.greatest(F.lit(1e-6), F.abs(v) * 1e-6)))
    return (F.size(own) > 0) & near


def first_turn(messages: Column, role: str) -> Column:
    """Content of the first message of a role; NULL if there is none."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(1))["content"]


def salvaged_json(text: Column) -> Column:
    """The text if it is JSON, else its part from the first brace to the last if that is; else NULL."""
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(text).isNotNull(), text).when(F.try_parse_json(inner).isNotNull(), inner)


def _first_object(text: str) -> str | None:
    """The first balanced object of a text that parses.

    One pass over braces and quotes finds all balanced pairs behind a start; only braces that it took for parts of strings
    are starts of further passes.
    """
    start = text.find("{")
    while start >= 0:
        quoted, stack, pairs, hidden = False, [], [], -1
        for m in _MARKS.finditer(text, start):
            mark = m[0]
            if mark == '"':
                quoted = not quoted
            elif quoted:
                if mark == "{" and hidden < 0:
                    hidden = m.start()
            elif mark == "{":
                stack.append(m.start())
            elif mark == "}" and stack:
                pairs.append((stack.pop(), m.end()))
                if not stack:  # an outermost object: try it and what it holds, from the left
                    for a, b in sorted(pairs):
                        try:
                            json.loads(text[a:b])
                            return text[a:b]
                        except ValueError:
                            continue
                    pairs = []
        for a, b in sorted(pairs):
            try:
                json.loads(text[a:b])
                return text[a:b]
            except ValueError:
                continue
        start = hidden
    return None


def balanced_json(text: Column) -> Column:
    """The first balanced object of a text that parses, fences taken off; braces inside strings don't count."""

    @F.pandas_udf(T.StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(_first_object, na_action="ignore")

    return run(text)


def pruned_json(raw: Column, schema: str) -> Column:
    """An object with only the keys that ``schema`` declares, NULLs left out; NULL where it is no object."""
    return F.to_json(F.from_json(F.when(F.json_object_keys(raw).isNotNull(), raw), schema))


def money(value: Column, currency: Column) -> Column:
    """An amount with thousands separators, two places and the sign of its currency; n/a for NULL."""
    signs = F.create_map(*[F.lit(x) for pair in CURRENCY_SIGNS.items() for x in pair])
    return F.when(value.isNull(), "n/a").otherwise(F.concat(F.coalesce(F.try_element_at(signs, currency), F.lit("")), F.format_number(value, 2)))


def sign_class(value: Column) -> Column:
    """pos, neg, na for NULL, or nothing for 0: how a signed figure is to be shown."""
    return F.when(value.isNull(), "na").when(value > 0, "pos").when(value < 0, "neg").otherwise("")


def aligned_block(facts: dict[str, Column]) -> Column:
    """Lines ``label : value`` with the colons below each other; NULL facts read 'unavailable'."""
    width = max(map(len, facts), default=0)
    return F.concat_ws("\n", *[F.concat(F.lit(f"{k:<{width}} : "), F.coalesce(v.cast("string"), F.lit("unavailable"))) for k, v in facts.items()])


def outline(title: Column, sections: dict[str, Column]) -> Column:
    """A title and sections below headings; a section is a text or a list of texts, and one without content is left out."""
    parts = []
    for name, body in sections.items():
        text = F.when(F.trim(body) != "", body)
        parts.append(F.when(text.isNotNull(), F.concat(F.lit(f"{name.upper()}\n"), text)))
    return F.concat_ws("\n\n", title, *parts)


def bullets(items: Column) -> Column:
    """A list of texts as lines with a dash; an empty or NULL list is NULL."""
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"))


def content_text(raw: Column) -> Column:
    """The text of a message content: a plain text as it is, of a JSON list its texts and its blocks of text joined; NULL is empty.

    Blocks of another kind (reasoning, calls) are left out.
    """
    blocks = F.from_json(raw, "array<string>")
    piece = lambda b: F.when(
        F.startswith(F.ltrim(b), F.lit("{")),
        F.when(F.coalesce(F.get_json_object(b, "$.type"), F.lit("text")) == "text", F.coalesce(F.get_json_object(b, "$.text"), F.lit(""))).otherwise(""),
    ).otherwise(b)
    listed = F.startswith(F.ltrim(raw), F.lit("[")) & blocks.isNotNull() & F.try_parse_json(raw).isNotNull()
    return F.when(raw.isNull(), "").when(listed, F.array_join(F.transform(blocks, piece), "")).otherwise(raw)


def malformed_call(error: Column) -> Column:
    """Whether an error says that a model's own call of a tool couldn't be read."""
    return F.coalesce(F.lower(error).rlike("|".join(MALFORMED_CALLS)), F.lit(False))


def retryable(status: Column, error: Column) -> Column:
    """Whether a failed call may be tried again, by its status or the name of its error."""
    return F.coalesce(status.isin(*RETRYABLE_STATUS), F.lit(False)) | F.coalesce(error.isin(*RETRYABLE_ERRORS), F.lit(False))


def as_text(df, name: str) -> Column:
    """A column of any kind as text: texts as they are, lists, maps and structs as JSON, others cast."""
    kind = df.schema[name].dataType
    return F.to_json(name) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) else F.col(name).cast("string")


def signed_percent(value: Column, places: int = 2) -> Column:
    """A percentage with its sign, or a dash."""
    return F.when(value.isNull(), "-").otherwise(F.format_string(f"%+.{places}f%%", value))
