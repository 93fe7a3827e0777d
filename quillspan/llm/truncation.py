"""Texts cut off by a field limit or on the way.

Intact texts are cut artificially to get positives, a hashed logistic regression is trained on how a text closes
(characters, punctuation, length against the limits of its source), and every record is scored.  What may stand
behind the break, such as closing lines, references and lists, is told by how often its wording closes documents, and
placeholders by how often they are a whole text.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.shared import spread, written

#: Texts that the regression is trained on at most (a random sample of the intact ones; all else covers all data).
TRAINING_TEXTS = 5_000
#: A wording closes documents as a matter of form if this share of all distinct texts, and at least three, have it.
FORM_SHARE = 0.0003
FORM_LEAST = 3
#: Longest closing line.
FORM_CHARS = 90
#: A length is a limit of a source if this share of its texts, and at least five, have exactly it.
LIMIT_SHARE = 0.02
LIMIT_LEAST = 5
#: Words that stand for a text that isn't there.
PLACEHOLDERS = frozenset(". - -- n/a na n.a. none null nil void tbd tba pending withdrawn empty unknown".split())
#: Most words and characters of a text that is told by its whole wording rather than its close.
FEW_WORDS, FEW_CHARS = 3, 25
#: Hash buckets of the regression.
BUCKETS = 1 << 18

_HIDDEN = "​‌‍⁠﻿­"
_CLOSERS = "\"'”’»›)]}"
_END = re.compile(rf"[.!?。！？][{re.escape(_CLOSERS)}]*$")
_ELLIPSIS = re.compile(r"\s*(?:\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\)|\.\.\.+|…)$")
_LIST_ITEM = re.compile(r"^\s*(?:[-*•–·]|\d{1,3}[.)]|\(?[a-z]\))\s+\S")
_BROKEN_BYTES = re.compile("�+$")
_TITLE = re.compile(r"^[A-Z]{3,}(?: [A-Z]{3,})* - ")
_BLANK = " \t\r\n\x0b\x0c\xa0\u2003\u3000" + _HIDDEN
_JAVA_BLANK = "".join(f"\\x{{{ord(x):X}}}" for x in _BLANK)
_WRAPPER = re.compile(r"(?:[\"']?\s*[}\]]|<[^<>]{0,40}|&[a-z]{0,6})+$")


def _at_end(pattern: re.Pattern, text: str) -> re.Match | None:
    """The match of a pattern for the very end of a text; such ends are short, so the search starts near it."""
    return pattern.search(text, max(0, len(text) - 200))


def wording(line: str) -> str:
    """A line with its names, numbers, addresses and links taken out."""
    out = []
    for i, token in enumerate(line.split()):
        if "://" in token:
            out.append("url")
        elif "@" in token:
            out.append("@")
        elif any(c.isdigit() for c in token):
            out.append("#")
        elif i and token[:1].isupper():
            out.append("W" + token[-1] * (not token[-1].isalnum()))
        else:
            out.append(token.lower())
    return " ".join(out)


def _lines(text: str) -> list[str]:
    lines = [x.strip(" \t\r" + _HIDDEN) for x in text.replace("\r\n", "\n").split("\n")]
    while lines and not lines[-1]:
        lines.pop()
    return lines


def closing_wordings(text: str | None) -> list[str]:
    """The wordings that might close this text as a matter of form: its last short lines without a sentence's end,
    and its last sentence if that ends with an ellipsis."""
    if not text:
        return []
    lines, out = _lines(text), []
    for line in reversed([x for x in lines if x][-5:]):
        if ellipsis := _at_end(_ELLIPSIS, line):
            sentence = wording(_last_sentence(line[: ellipsis.start()]))
            if len(sentence.split()) >= 4:
                out.append(sentence + "…")
            break
        if _LIST_ITEM.match(line):
            continue
        if len(line) > FORM_CHARS or _at_end(_END, line):
            break
        out.append(wording(line))
    return out


def _last_sentence(text: str) -> str:
    parts = re.split(r"(?<=[.!?。])\s+", text.strip())
    return parts[-1] if parts else ""


@dataclass
class Forms:
    """What is known of the corpus: wordings that close documents, the lengths each source cuts at, texts that are placeholders."""

    wordings: frozenset[str] = frozenset()
    limits: dict[str, frozenset[int]] = field(default_factory=dict)
    placeholders: frozenset[str] = PLACEHOLDERS


@dataclass
class Close:
    """How a text closes: ``rest`` is the running text, without what stands behind it."""

    rest: str
    finished: bool
    lists: int = 0
    forms: int = 0
    trailer: str = ""


def close_of(text: str, forms: Forms) -> Close:
    """Take closing lines, lists and marks of omission off the end of a text."""
    lines = _lines(text)
    lists = formed = 0
    while lines:
        line = lines[-1]
        if not line:
            lines.pop()
        elif _LIST_ITEM.match(line) and not (len(line) > FORM_CHARS):
            lines.pop()
            lists += 1
        elif len(line) <= FORM_CHARS and not _at_end(_END, line) and wording(line) in forms.wordings:
            lines.pop()
            formed += 1
        else:
            break
    rest = "\n".join(lines).rstrip()
    trailer = ""
    for _ in range(4):
        if mark := _at_end(_BROKEN_BYTES, rest):
            rest, trailer = rest[: mark.start()].rstrip(), trailer + "b"
        elif mark := _at_end(_ELLIPSIS, rest):
            head = rest[: mark.start()].rstrip()
            if wording(_last_sentence(head.split("\n")[-1])) + "…" in forms.wordings:
                return Close(rest, True, lists, formed, trailer)
            rest, trailer = head, trailer + "e"
        elif not _at_end(_END, rest) and (mark := _at_end(_WRAPPER, rest)):
            rest, trailer = rest[: mark.start()].rstrip(), trailer + "w"
        else:
            break
    return Close(rest, bool(_at_end(_END, rest)), lists, formed, trailer)


def _bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % BUCKETS


def features(text: str, source: str | None, forms: Forms, length: int | None = None, close: Close | None = None) -> list[int]:
    """Hash buckets of the features of a text: closing characters, punctuation and length to limit."""
    c = close or close_of(text, forms)
    rest = c.rest
    words = rest[-120:].split()
    last = words[-1] if words else ""
    before = words[-2].lower()[:24] if len(words) > 1 else ""
    number = last[:-1].replace(",", "").isdigit() and last[-1:] == "."
    shape = "".join("d" if x.isdigit() else "u" if x.isupper() else "l" if x.isalpha() else " " if x.isspace() else x for x in rest[-6:])
    length = len(text) if length is None else length
    limits = forms.limits.get(source or "", frozenset())
    few = len(rest) <= FEW_CHARS and len(words) <= FEW_WORDS
    title = bool(_TITLE.match(rest)) and len(rest) <= FORM_CHARS and "\n" not in rest.strip()
    names = [
        "bias",
        f"end={c.finished}",
        f"last1={rest[-1:]}",
        f"last2={rest[-2:]}",
        f"last3={rest[-3:]}",
        f"word={last.lower()[:24]}",
        f"shape={shape}",
        f"shape3={shape[-3:]}",
        f"closers={rest[-1:] in _CLOSERS}",
        f"open={rest.count('(') > rest.count(')')}",
        f"number={number}",
        f"number,before={number},{before}",
        f"end,lists={c.finished},{min(c.lists, 2)}",
        f"end,forms={c.finished},{min(c.forms, 2)}",
        f"end,trailer={c.finished},{c.trailer}",
        f"limit={length in limits}",
        f"end,limit={c.finished},{length in limits}",
        f"empty={not rest}",
        f"end,colon={c.finished},{rest[-1:] == ':' and c.lists > 0}",
        f"words={min(len(words), 4)}",
        f"few,end={few},{c.finished}",
        f"placeholder={whole(text) in forms.placeholders}",
        f"title,lists={title},{c.lists > 0}",
    ]
    return [_bucket(x) for x in names]


def _fit(rows: list[list[int]], labels: np.ndarray, epochs: int = 15, seed: int = 3) -> np.ndarray:
    """Logistic regression by Adam over all rows in small batches, with a light L2 penalty."""
    x = np.array(rows, dtype=np.int64)
    y = labels.astype(float)
    rng = np.random.default_rng(seed)
    w, m, v, step = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 512):
            part = order[at : at + 512]
            p = 1 / (1 + np.exp(-np.clip(w[x[part]].sum(1), -30, 30)))
            grad = np.bincount(x[part].ravel(), np.repeat((p - y[part]) / len(part), x.shape[1]), BUCKETS) + 1e-5 * w
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


@dataclass
class Model:
    """Weights of the regression and what it knows of the corpus."""

    weights: np.ndarray
    forms: Forms

    def score(self, text: str, source: str | None) -> float:
        """Probability that the running text breaks off; 0 for a text of blanks and invisible characters only."""
        if not text.strip(_BLANK):
            return 0.0
        z = float(self.weights[features(text, source, self.forms)].sum())
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def artificial_cuts(texts: list[tuple[str, str | None]], forms: Forms, seed: int = 5) -> tuple[list[list[int]], np.ndarray]:
    """Features and labels of intact texts, of their short parts that are intact, and of the same texts cut inside a sentence.

    Intact are also the last words of a sentence, what stands behind the running text alone or behind a title, and placeholders.
    """
    rng = np.random.default_rng(seed)
    rows, labels = [], []

    def intact(part: str) -> None:
        rows.append(features(part, source, forms))
        labels.append(0)

    held = sorted(forms.placeholders)
    for number, (text, source) in enumerate(texts):
        intact(text)
        close = close_of(text, forms)
        body = close.rest
        behind = text[text.rfind(body) + len(body) :] if body else ""
        if number % 4 == 0:
            intact(" ".join(body.split()[-int(rng.integers(1, 4)) :]))
            intact(held[number // 4 % len(held)])
            if behind.strip() and (close.lists or close.forms):
                intact(behind.strip())
            if close.lists and (head := text.split("\n", 1)[0].strip()) and len(head) <= FORM_CHARS and not _at_end(_END, head):
                intact(head + "\n" + behind.strip())
            if len(body) > FEW_CHARS:  # a few characters of the start
                cut = body[: int(rng.integers(3, FEW_CHARS))]
                if whole(cut) not in forms.placeholders and not close_of(cut, forms).lists and not _at_end(_END, cut.rstrip()):
                    rows.append(features(cut, source, forms))
                    labels.append(1)
        limits = [x for x in forms.limits.get(source or "", ()) if 40 < x < len(body)]
        for k in range(2):
            if limits and k == 0:
                at = int(rng.choice(limits))
            elif len(body) > 40:
                at = int(rng.integers(len(body) // 4, len(body) - 2))
            else:
                continue
            cut = body[:at]
            close = close_of(cut, forms)
            if close.lists or close.finished and not (cut.endswith(".") and body[at : at + 1].isalnum()):
                continue  # a sentence or a list was finished there
            tail = ("", "", "…", " [...]", "...", "�", '"}', behind, behind)[int(rng.integers(9))]
            rows.append(features(cut + tail, source, forms, length=at if limits and k == 0 else None))
            labels.append(1)
    return rows, np.array(labels)


def whole(text: str) -> str:
    """A text without blanks and full stops around it, lower case."""
    return text.strip(_BLANK).rstrip(".").lower() or text.strip(_BLANK)


def closings(rows: DataFrame) -> DataFrame:
    """What is counted of each text (columns text, source): source, length, hash, closing wordings, whether it ends like a finished
    one, and a short text as it is.  One pass over the texts, written; nothing else of the corpus is read for the counts."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(closing_wordings)

    intact = (F.length("text") > 60) & F.rtrim("text").rlike(r"[.!?…\]\w-]$")
    short = F.when(F.length("text") <= FORM_CHARS, F.lower(F.regexp_replace(F.regexp_replace("text", rf"^[{_JAVA_BLANK}]+|[{_JAVA_BLANK}]+$", ""), r"(?<=[^.])\.+$", "")))
    return written(rows.where("text is not null").select("source", F.length("text").alias("length"), F.xxhash64("text").alias("hash"), F.array_distinct(found("text")).alias("wordings"), intact.alias("intact"), short.alias("short")), "closings")


def learn_forms(counted: DataFrame) -> Forms:
    """Wordings, limits and placeholders of the whole corpus, from its ``closings``.

    All lists are bounded: at most 5 / FORM_SHARE wordings, 1 / FORM_SHARE placeholders, and 1 / LIMIT_SHARE lengths a source can
    reach their shares; of sources, the driver holds those with a limit.  A placeholder is a whole text of at most FEW_CHARS
    characters that as many rows have as texts must have a wording.
    """
    total, texts = counted.agg(F.count("*"), F.approx_count_distinct("hash", 0.01)).first()
    lines = counted.select("hash", F.explode("wordings").alias("wording")).distinct()
    wordings = [r[0] for r in lines.groupBy("wording").count().where(F.col("count") >= max(FORM_LEAST, FORM_SHARE * texts)).select("wording").collect()]
    repeated = counted.where(f"short <> '' and length(short) <= {FEW_CHARS}").groupBy("short").count().where(F.col("count") >= max(FORM_LEAST, FORM_SHARE * total))
    placeholders = [r[0] for r in repeated.select("short").collect()]
    by_length = counted.where("length > 0").select("source", "length", "hash").distinct().groupBy("source", "length").agg(F.count("*").alias("n"))
    sizes = by_length.groupBy("source").agg(F.sum("n").alias("all"))
    limits: dict[str, set[int]] = {}
    for source, length in by_length.where(f"length > 40 and n >= {LIMIT_LEAST}").join(sizes, "source").where(F.col("n") >= LIMIT_SHARE * F.col("all")).select("source", "length").collect():
        limits.setdefault(source, set()).add(length)
    return Forms(frozenset(wordings), {k: frozenset(v) for k, v in limits.items()}, PLACEHOLDERS | frozenset(placeholders))


def train(rows: DataFrame, most: int = TRAINING_TEXTS) -> Model:
    """Learn the corpus's forms over all rows and fit the regression on artificial cuts of about ``most`` intact texts.

    The sample is drawn by a hash of the text at a rate that gives that many, so the driver gets no more however large the
    corpus is.
    """
    counted = closings(rows)
    forms = learn_forms(counted)
    total = counted.where("intact").agg(F.approx_count_distinct("hash", 0.01)).first()[0]
    intact = rows.where(F.length("text") > 60).where(F.rtrim("text").rlike(r"[.!?…\]\w-]$")).select("text", "source")
    unit = F.shiftrightunsigned(F.xxhash64("text", F.lit(11)), 11) / F.lit(float(2**53))
    sample = intact.where(unit < most / max(1, total)).limit(2 * most).collect()
    texts = sorted(((r["text"], r["source"]) for r in sample if close_of(r["text"], forms).finished), key=lambda x: (x[0], x[1] or ""))
    if not texts:
        return Model(np.zeros(BUCKETS), forms)
    features_, labels = artificial_cuts(texts, forms)
    return Model(_fit(features_, labels), forms)


def score_truncation(rows: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source", model: Model | None = None) -> DataFrame:
    """(id, source, cut_score, truncated) of every row.

    ``truncated`` is true where the running text most likely breaks off inside a word or sentence, whatever stands behind
    it.  NULL, empty and blank texts have score 0; all others, placeholders and titles too, are scored by the regression.  Repeated rows are
    scored alike; other columns are ignored; an empty table gives an empty table.
    """
    read = spread(rows.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(source).alias("source")))
    known = read.sparkSession.sparkContext.broadcast(model or train(read))

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series, sources: pd.Series) -> pd.Series:
        m = known.value
        return pd.Series([m.score(t, s) if isinstance(t, str) else 0.0 for t, s in zip(texts, sources, strict=True)], dtype=float)

    scored = read.select("id", "source", score("text", "source").alias("cut_score"))
    return scored.select(F.col("id").alias(id), F.col("source").alias(source), "cut_score", (F.col("cut_score") >= 0.5).alias("truncated"))


def truncation_rates(scored: DataFrame, source: str = "source") -> DataFrame:
    """(source, texts, truncated, rate) of the scored rows; a NULL source is a source of its own."""
    return scored.groupBy(source).agg(F.count("*").alias("texts"), F.count_if("truncated").alias("truncated")).withColumn("rate", F.round(F.col("truncated") / F.col("texts"), 6))
