import unicodedata

import pytest
from pyspark.sql import functions as F

from quillspan.llm.forms import mapping, reading_classes, same_reading_pairs, transducer, unify

SAME = [
    ("Ｓｈａｒｅｓ　ｏｆ", "Shares of"), ("ﬁxed", "fixed"), ("é", "é"), ("e​́", "é"), ("се́", "cé"), ("Ѕhаrеѕ", "Shares"), ("a b", "a b"), ("x­y﻿z", "xyz"),
    ("non‑stop", "non-stop"), ("－１", "-1"), ("ça", "ça"), ("q̣̇", "q̣̇"), ("ガ", "ｶﾞ"), ("각", "각"), ("ΗΑLN", "HALN"), ("ё", "ë"), ("Ⅻ", "XII"), ("Å", "Å"),
]
DIFFERENT = [("a", "A"), ("a", "á"), ("a  b", "a b"), ("a\tb", "a b"), ("a-b", "a–b"), ("a.", "a"), ("α", "a"), ("к", "k"), ("", " ")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert unify(a) == unify(b) and unify(unify(a)) == unify(a)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(a, b):
    assert unify(a) != unify(b)


def test_mapping_is_final():
    table = mapping()
    assert not any(c.isascii() for c in table) and not any(x in table for form in table.values() for x in form)
    for char in "é ç ñ ü å š ï Ü ά ώ й".split():
        assert unify(char) == char
    assert transducer()("plain") == "plain" and unify(None) is None and len(unify("é" * 200_000)) == 200_000


def test_every_character_meets_its_decomposition():
    for code in (x for x in range(0x110000) if not 0xD800 <= x < 0xE000):
        char = chr(code)
        whole, parts = unicodedata.normalize("NFC", char), unicodedata.normalize("NFD", char)
        if (whole, parts) != (char, char):
            assert unify(char) == unify(whole) == unify(parts), hex(code)
            assert unify(f"x{char}y") == unify(f"x{parts}y"), hex(code)


def test_classes(spark):
    rows = [(1, "h", "Shares"), (2, "h", "Ѕhares"), (3, "h", "Shares"), (4, "q", "Ѕhares"), (5, "h", "Shar\u200bes"), (6, "h", None), (9, "h", "x"), (10, "h", "x")]
    got = {tuple(r) for r in reading_classes(spark.createDataFrame(rows, "id long, field string, text string")).collect()}
    assert got == {("h", i, 1, 3) for i in (1, 2, 3, 5)}


def test_pairs(spark):
    rows = [(1, "h", "Shares"), (2, "h", "Ѕhares"), (3, "h", "Shares"), (4, "q", "Shares"), (5, "h", "Shar​es"), (6, "h", None), (7, "h", ""), (8, "h", "​"), (9, "h", "​​"), (2, "h", "Ѕhares"), (10, "h", "shares")]
    df = spark.createDataFrame(rows, "id long, field string, text string").withColumn("key", F.lit(0)).withColumn("form", F.lit("x"))
    got = {tuple(r) for r in same_reading_pairs(df).select("field", "a_id", "b_id").collect()}
    assert got == {("h", 1, 2), ("h", 2, 3), ("h", 1, 5), ("h", 3, 5), ("h", 2, 5), ("h", 8, 9)}
    assert same_reading_pairs(df.limit(0)).count() == 0


def test_hot_form(spark):
    df = spark.range(400).select("id", F.lit("h").alias("field"), F.when(F.col("id") % 100 == 0, "Ѕame").otherwise("Same").alias("text"))
    assert same_reading_pairs(df).count() == 4 * 396
