import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspan.llm import layouts
from quillspan.llm.layouts import collapse_layouts, layout_hashes, letter_classes, same_layout, same_record

GROUPS = [
    ["Shares of A (AB) move 12.5% as unit, net", "SHARES OF A AB MOVE 12.5 % AS UNIT NET!", "[Shares  of A (AB) move １２.5% as u​nit; net]", "Ѕhares ofA (AB) move 12.5% as unit - net..."],
    ["Shares of A (AB) move -12.5% as unit, net"], ["Shares of A (AB) move 125% as unit, net"], ["Sháres of A (AB) move 12.5% as unit, net", "Sháres of A (AB) MOVE 12.5% as unit, net"],
    ["a=x y; b=2.5; c=q", "c=Q;a=x  y;b=2.5", "(b=2.5; c=q; a=x-y)", " * \n a=x y; b=2.5; c=q"], ["a=x; b=2.5; c=q y"], ["a=2.5; b=x y; c=q"],
    ["ΑΠΟΡΡΊΠΤΕΙ", "απορρίπτει"], ["Straße 5", "STRASSE 5"], ["ḍ̇x", "ḍ̇x"],
]


def test_hashes_follow_records():
    texts = [(g, x) for g, xs in enumerate(GROUPS) for x in xs]
    h1, h2, some = layout_hashes(pa.array([x for _, x in texts] + [None, "", "...", "​"]))
    assert some.tolist() == [True] * len(texts) + [False] * 4
    for i, (g, a) in enumerate(texts):
        for j, (h, b) in enumerate(texts):
            alike = g == h
            assert ((h1[i], h2[i]) == (h1[j], h2[j])) == alike, (a, b)
            assert same_record(a, b) == alike, (a, b)
    pairs = [(a, b) for _, a in texts for _, b in texts]
    alike = [g == h for g, _ in texts for h, _ in texts]
    assert same_layout(pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs])).tolist() == alike


def test_long_pairs_by_chunks(monkeypatch):
    monkeypatch.setattr(layouts, "LONG", 5)
    monkeypatch.setattr(layouts, "CHUNK", 7)
    texts = [(g, x) for g, xs in enumerate(GROUPS) for x in xs]
    pairs = [(a, b, g == h) for g, a in texts for h, b in texts]
    assert same_layout(pa.array([a for a, _, _ in pairs]), pa.array([b for _, b, _ in pairs])).tolist() == [x for _, _, x in pairs]


def test_long_and_sliced():
    long = "word " * 100_000
    a = layout_hashes(pa.array(["x", long, long.upper().replace(" ", "\t")]).slice(1))
    assert a[0][0] == a[0][1]
    assert np.array_equal(layout_hashes(pa.array([], pa.string()))[0], np.zeros(0))
    assert letter_classes()["А"] == "a"


def test_collapse(spark):
    rows, want = [], {}
    n = 0
    for xs in GROUPS:
        ids = []
        for x in [*xs, xs[0]]:
            n += 1
            ids.append(n)
            rows.append((n, x))
        want.update({i: (ids[0], len(ids)) for i in ids})
    rows += [(n + 1, None), (n + 2, ""), (n + 3, "  ...")]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "id long, text string").withColumn("keep_id", F.lit("x"))
    assert {r.id: (r.keep_id, r.copies) for r in collapse_layouts(df).collect()} == want
    assert collapse_layouts(df.limit(0)).count() == 0
    hot = spark.range(300).select("id", F.when(F.col("id") < 100, "Same").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    assert collapse_layouts(hot).where("id <> keep_id").count() == 99


def test_hashes_that_meet_by_accident(spark, monkeypatch):
    """All rows under one hash: the rounds tell the records apart."""
    plain = layouts.layout_hashes

    def one_hash(batches):
        for batch in batches:
            h1, _, some = plain(batch.column("text"))
            zero = pa.array(np.zeros(len(h1), np.int64))
            yield pa.record_batch([batch.column("id").cast(pa.int64()), batch.column("text").cast(pa.string()), zero, zero], names=["id", "text", "h1", "h2"]).filter(pa.array(some))

    monkeypatch.setattr(layouts, "_hash_batches", one_hash)
    rows = [(1, "A b"), (2, "a-B"), (3, "c"), (4, "C!"), (5, "d"), (6, "c"), (7, "a b")]
    got = {r.id: (r.keep_id, r.copies) for r in collapse_layouts(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == {1: (1, 3), 2: (1, 3), 7: (1, 3), 3: (3, 3), 4: (3, 3), 6: (3, 3), 5: (5, 1)}
