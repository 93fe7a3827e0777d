"""Texts that read the same, brought to the same characters.

A transducer is compiled once from a conflict-checked mapping: widths, joined letters, special blanks, hyphens,
invisible characters and look-alike letters fold character by character, and a trie of decomposed sequences puts
accents back on their letters by longest match.  It runs over the extended grapheme clusters of a text, as the Unicode
standard bounds them, in one pass; runs of plain ASCII are left alone.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.shared import spread, written
from quillspan.skew import salted_lookup, salted_pairs

# Letters of other scripts that the published table of confusable characters gives the shape of a Latin letter, and
# that letter, pair by pair.  Left out are those whose other case has the shape of another letter (ν is v, but Ν is N).
CYRILLIC = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX аa еe оo рp сc уy хx ѕs іi јj һh ԁd ԛq ԝw ԚQ ԜW ҮY үy ӏl ѴV ѵv"
GREEK = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo ρp ϲc ϹC ϳj ͿJ"
ARMENIAN = "օo սu հh ՕO ՏS ոn զq ցg"
CHEROKEE = "ᎠD ᎡR ᎢT ᎥI ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᎽY ᏀG ᏃZ ᏔW ᏙV ᏚS ᏞL ᏟC ᏢP ᏦK ᏴB"
COPTIC = "ⲂB ⲎH ⲒI ⲔK ⲘM ⲚN ⲞO ⲟo ⲢP ⲣp ⲤC ⲥc ⲦT ⲨY ⲬX"
# Letters for the notation of sounds that have the shape of a plain one.
PHONETIC = "ɡg ɑa"
# Hyphens with the shape of the ASCII one (dashes and the minus sign are longer, so they differ).
HYPHENS = "‐‑⁃˗﹣－"
# Characters that show nothing, besides those of the general category Cf (first and last of each run).
INVISIBLE = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF))
# Characters of category Cf that do show (Arabic and other number signs).
VISIBLE_CF = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}

#: Code points that are looked at when the mapping is built; those beyond are ideographs without another form, and private ones.
_SPAN = (range(0x80, 0x30000), range(0xE0000, 0xE1000))


def lookalikes() -> dict[str, str]:
    """Letter of another script → the Latin letter of its shape."""
    return {pair[0]: pair[1] for group in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, COPTIC, PHONETIC) for pair in group.split()}


@lru_cache(maxsize=1)
def mapping() -> dict[str, str]:
    """Character → the decomposed characters it reads as, for every character that isn't its own form.

    Raises ValueError where two rules give one character different forms, where a form would be mapped on, or where
    an ASCII character would be changed.
    """
    found: dict[str, str] = {}

    def rule(char: str, form: str) -> None:
        if found.setdefault(char, form) != form:
            raise ValueError(f"U+{ord(char):04X} has two forms")

    shapes = lookalikes()
    for span in _SPAN:
        for code in span:
            char = chr(code)
            kind, parts = unicodedata.category(char), unicodedata.decomposition(char)
            if (kind == "Cf" and code not in VISIBLE_CF) or any(a <= code <= b for a, b in INVISIBLE):
                rule(char, "")
            elif kind == "Zs":
                rule(char, " ")
            elif char in HYPHENS:
                rule(char, "-")
            elif char in shapes:
                rule(char, shapes[char])
            elif 0xAC00 <= code <= 0xD7A3 or parts and parts[0] != "<":
                rule(char, unicodedata.normalize("NFD", char))
            elif parts.startswith(("<wide>", "<narrow>")) or parts.startswith("<compat>") and ("LIGATURE" in unicodedata.name(char, "") or 0x2160 <= code <= 0x217F):
                rule(char, unicodedata.normalize("NFD", "".join(chr(int(x, 16)) for x in parts.split()[1:])))
    for _ in range(3):  # a form may itself hold mapped characters, as a wide hyphen or an accented look-alike does
        found = {char: "".join(found.get(x, x) for x in form) for char, form in found.items()}
    for char, form in found.items():
        if any(x in found for x in form) or char.isascii():
            raise ValueError(f"U+{ord(char):04X} is not mapped to a final form")
    return found


class Transducer:
    """Longest-match transducer over grapheme clusters."""

    def __init__(self) -> None:
        self.fold = mapping()
        self.trie: dict = {}
        for char, form in self.fold.items():
            if len(form) > 1 and unicodedata.normalize("NFC", form) == char:
                self._add(form, char)
        for code in _SPAN[0]:  # accented forms of letters that themselves have look-alikes keep their own code
            char = chr(code)
            if char not in self.fold or unicodedata.normalize("NFC", self.fold[char]) == char:
                continue
            composed = unicodedata.normalize("NFC", self.fold[char])
            if len(composed) == 1 and len(self.fold[char]) > 1:
                self._add(self.fold[char], composed)
        # a cluster that isn't a plain ASCII character; invisible characters that end a cluster may stand before further accents
        hidden = "".join(regex.escape(c) for c, form in self.fold.items() if not form)
        self.cluster = regex.compile(f"(?=[\\x00-\\x7f]?[^\\x00-\\x7f])\\X(?:[{hidden}]+[\\p{{M}}ﾞﾟ]+)*")
        self.known: dict[str, str] = {}

    def _add(self, sequence: str, output: str) -> None:
        node = self.trie
        for char in sequence:
            node = node.setdefault(char, {})
        if node.setdefault("out", output) != output:
            raise ValueError(f"{sequence!r} has two outputs")

    def _one(self, match: regex.Match) -> str:
        cluster = match[0]
        out = self.known.get(cluster)
        if out is None:
            out = self._run(cluster)
            if len(self.known) < 1_000_000:  # a bound for memory only; further clusters are worked out each time
                self.known[cluster] = out
        return out

    def _run(self, cluster: str) -> str:
        symbols = [x for c in cluster for x in self.fold.get(c, c)]
        start = 0  # accents in canonical order: by class, within the runs behind each base
        for i, char in enumerate([*symbols, "a"]):
            if not unicodedata.combining(char):
                symbols[start:i] = sorted(symbols[start:i], key=unicodedata.combining)
                start = i + 1
        out, i = [], 0
        while i < len(symbols):
            node, best, end = self.trie, symbols[i], i + 1
            for j in range(i, len(symbols)):
                node = node.get(symbols[j])
                if node is None:
                    break
                if "out" in node:
                    best, end = node["out"], j + 1
            out.append(best)
            i = end
        return "".join(out)

    def __call__(self, text: str) -> str:
        return text if text.isascii() else self.cluster.sub(self._one, text)


@lru_cache(maxsize=1)
def transducer() -> Transducer:
    """The compiled transducer, one per process."""
    return Transducer()


def unify(text: str | None) -> str | None:
    """The form of a text that all texts reading the same share; NULL stays NULL, empty stays empty."""
    return None if text is None else transducer()(text)


def unified(column: Column) -> Column:
    """``unify`` as a column expression (Arrow batches)."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        apply = transducer()
        return texts.map(apply, na_action="ignore")

    return run(column)


def _formed(rows: DataFrame, field: str, id: str, text: str) -> DataFrame:
    """(id, key, odd): the unified form of each text under its field, and the text where it isn't in that form."""
    read = rows.select(F.col(field).alias("field"), F.col(id).alias("id"), F.col(text).alias("text")).where("text <> ''")
    formed = spread(read).select("field", "id", "text", unified(F.col("text")).alias("form"))
    slim = formed.select("id", F.concat_ws("\x01", "field", "form").alias("key"), F.when(F.col("text") != F.col("form"), F.col("text")).alias("odd"))
    return written(slim, "forms")


def reading_classes(rows: DataFrame, *, field: str = "field", id: str = "id", text: str = "text") -> DataFrame:
    """(field, id, class_id, texts) of every row of a class of rows that read the same in more than one spelling.

    ``class_id`` is the smallest id of the class, ``texts`` how many different spellings it has: the pairs of
    ``same_reading_pairs`` as classes, of the size of the rows.  Rows with a NULL or empty text have no row.
    """
    kept = _formed(rows, field, id, text)
    classes = kept.groupBy("key").agg(F.min("id").alias("class_id"), F.count("*").alias("n"), (F.count_distinct("odd") + F.max(F.col("odd").isNull().cast("long"))).alias("texts")).where("texts > 1")
    return salted_lookup(kept.select("id", "key"), written(classes, "form-classes"), "key").select(F.substring_index("key", "\x01", 1).alias("field"), "id", "class_id", "texts")


def same_reading_pairs(rows: DataFrame, *, field: str = "field", id: str = "id", text: str = "text") -> DataFrame:
    """Pairs (field, a_id, b_id), a_id < b_id, of rows of one field that read the same in different characters.

    Rows with a NULL or empty text are no case.  Rows with the same characters are no pair, however often they
    repeat, and a repeated id makes no pair with itself.  Other columns are ignored.  Each pair holds at least one text that
    isn't in its own unified form, so only those rows are joined to the rest; a form that many rows share is
    split on both sides.  The pairs themselves are the result and can't be fewer; ``reading_classes`` gives them as classes.
    """
    kept = _formed(rows, field, id, text)
    odd = kept.where("odd is not null").select("key", F.col("id").alias("odd_id"), F.col("odd").alias("odd_text"))
    both = salted_pairs(odd, kept, "key").where("odd_id <> id and (odd is null or (odd <> odd_text and odd_id < id))")
    return both.select(F.substring_index("key", "\x01", 1).alias("field"), F.least("odd_id", "id").alias("a_id"), F.greatest("odd_id", "id").alias("b_id")).distinct()
