import random

import numpy as np
from pyspark.sql import functions as F

from quillspan.llm import leaks as k

RNG = random.Random(5)
VOCABULARY = [f"term{i}" for i in range(400)]
INSTRUCTION = "Read the clause below and state the obligation, the trigger and the risk flag in one JSON object of your own making for the held out exam."
CLAUSES = {i: RNG.choices(VOCABULARY, k=110) for i in range(1, 13)}
ITEMS = [(i, f"{INSTRUCTION}\n{' '.join(w)}.") for i, w in CLAUSES.items()]


def index_of(items):
    pieces = []
    for i, text in items:
        sentences = k.sentences_of(text)
        pieces += [(i, p) for p in k.own_pieces(sentences, [" ".join(x) == " ".join(k.words_of(INSTRUCTION)) for x in sentences])]
    return k.build_index(pieces)


def found_in(texts, index):
    number, item = k.leaks_of([k.words_of(x) for x in texts], index)
    return {(n, index.ids[i]) for n, i in zip(number.tolist(), item.tolist(), strict=True)}


def filler(n):
    return RNG.choices(VOCABULARY, k=n)


def doc(inner):
    return " ".join(filler(60)) + ". " + inner + " " + " ".join(filler(60))


def noisy(words):
    out = []
    for j, w in enumerate(words):
        out.append("such" if j % 11 == 5 else w)
        if j % 17 == 9:
            out.append("duly")
    return out


def test_cases(spark):
    c = CLAUSES
    rows = [
        (1, doc(" ".join(c[1]))), (2, doc(" ".join(c[2][30:58]).upper())), (3, doc("\n".join(noisy(c[3][10:60])))), (4, doc(" ".join(c[4][5:20]))), (5, doc(INSTRUCTION)),
        (6, doc("**" + "</b> ".join(c[5][:40]) + '"')), (7, doc(" ".join(x[:3] + "-\n" + x[3:] for x in c[6][40:80]))), (8, doc(" ".join(c[7][:20]) + "\n[page 3]\n" + " ".join(c[7][20:40]))),
        (9, doc(" ".join(x[:2] + "​" + x[2:] for x in c[8][:40]))), (10, " ".join(filler(200))), (11, None), (12, ""), (13, doc(" ".join(c[9][:30]) + " " + " ".join(c[10][50:90]))),
        (1, doc(" ".join(c[1]))), (14, " ".join(c[11][:25])), (15, " ".join(RNG.choices(VOCABULARY, k=20_000) + c[12][:40] + RNG.choices(VOCABULARY, k=20_000))),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    items = spark.createDataFrame([*ITEMS, (99, None), (98, "short one"), (1, ITEMS[0][1])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in k.find_leaks(docs, items).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (6, 5), (7, 6), (8, 7), (9, 8), (13, 9), (13, 10), (14, 11), (15, 12)}
    assert k.find_leaks(docs.limit(0), items).count() == 0 and k.find_leaks(docs, items.limit(0)).count() == 0


def test_recall_of_short_noisy_passages():
    index = index_of(ITEMS)
    texts, want = [], []
    for n in range(300):
        i = RNG.choice(list(CLAUSES))
        at = RNG.randrange(0, 75)
        texts.append(doc(" ".join(noisy(CLAUSES[i][at : at + RNG.randint(28, 35)]))))
        want.append((n, i))
    found = found_in(texts, index)
    assert len(found & set(want)) >= 0.97 * len(want) and found <= set(want)


def test_altered_words_near_the_edges():
    index = index_of(ITEMS)
    starts, texts = [], []
    for n, edge in enumerate([(2, 22), (2, 3), (1, 23), (2, 12), (0, 24)] * 20):
        i = 1 + n % 12
        at = RNG.randrange(0, 85)
        part = CLAUSES[i][at : at + 25]
        for e in edge:
            part[e] = "such"
        starts.append(at)
        texts.append(doc(" ".join(part)))
    found = found_in(texts, index)
    want = {(n, 1 + n % 12) for n in range(len(texts))}
    assert found <= want and len(found) >= 0.95 * len(want)
    # the verdict itself finds all of them, and no shorter fragment
    for n, text in enumerate(texts):
        w = np.array([index.vocabulary.get(x, -1) for x in k.words_of(text)])
        begin = int(np.flatnonzero(index.item == n % 12)[0]) + starts[n]
        assert k.holds_passage(w, np.array([60]), index.words, np.array([begin])).all(), n
        w[78:] = -1
        assert not k.holds_passage(w, np.array([60]), index.words, np.array([begin])).any(), n


def test_recall_by_length_and_edits():
    """Random substitutions, omissions and additions at up to a tenth of the words, anywhere in the passage."""
    index, rng = index_of(ITEMS), random.Random(11)
    for length in (25, 28, 32, 40):
        for edits in range(int(0.1 * length) + 1):
            texts, want = [], set()
            for n in range(120):
                i = 1 + n % 12
                at = rng.randrange(0, 110 - length)
                part = CLAUSES[i][at : at + length]
                for place in sorted(rng.sample(range(length), edits), reverse=True):
                    kind = rng.randrange(4)
                    part[place : place + 1] = ["such"] if kind < 2 else [part[place], "duly"] if kind == 2 or length - edits < 25 else []
                texts.append(doc(" ".join(part)))
                want.add((n, i))
            found = found_in(texts, index)
            assert found <= want and len(found) >= 0.95 * len(want), (length, edits, len(found))


def test_likely_keeps_all_that_an_alignment_accepts():
    index, rng = index_of(ITEMS), random.Random(12)
    texts = []
    for n in range(200):
        i = 1 + n % 12
        at, size = rng.randrange(0, 60), rng.choice((25, 31, 45))
        part = CLAUSES[i][at : at + (size if n % 2 else 12)]
        for place in rng.sample(range(len(part)), int(k.EDIT_SHARE * len(part))):
            part[place] = "such"
        texts.append(doc(" ".join(part)))
    words = []
    for text in texts:
        words += [index.vocabulary.get(x, -1) for x in k.words_of(text)] + [-1] * 50
    w = np.array(words, dtype=np.int32)
    starts = np.arange(len(w) - 50)
    doc_at, item_at = k.candidates(w, starts, index.mark())
    number = np.zeros(len(w), np.int64)
    kept = k.likely(w, number, k.gram_hashes(w), doc_at, item_at, index)
    assert not k.holds_passage(w, doc_at[~kept], index.words, item_at[~kept]).any() and kept.sum() < len(kept)


def test_long_blank_stretches_and_many_blocks(spark, monkeypatch):
    assert k.words_of("a" + "\n" * 200_000 + "b" + " " * 200_000 + "- " * 50_000) == ["a", "b"]
    monkeypatch.setattr(k, "BLOCK_WORDS", 300)
    monkeypatch.setattr(k, "PASS_BLOCKS", 2)
    docs = spark.createDataFrame([(i, doc(" ".join(c[10:60]))) for i, c in CLAUSES.items()], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {tuple(r) for r in k.find_leaks(docs, items).collect()} == {(i, i) for i in CLAUSES}
