import random

from pyspark.sql import functions as F

from quillspan.llm import truncation as c

RNG = random.Random(6)
NOUNS = "lender borrower agent reserve margin deposit covenant guarantee schedule licence receipt facility".split()
VERBS = "approved the renewed the settled the declined the published the reviewed the".split(" the ")


def sentence():
    return f"The {RNG.choice(NOUNS)} {RNG.choice(VERBS).replace(' the', '')} the {RNG.choice(NOUNS)} in {RNG.randint(2, 99)} days, and the {RNG.choice(NOUNS)} of the {RNG.choice(NOUNS)} was not changed."


def body(n):
    return " ".join(sentence() for _ in range(n))


def test_held_out(spark):
    rows, cut = [], set()
    for i in range(900):
        text = body(RNG.randint(2, 6))
        kind = i % 9
        if kind in (1, 2, 3):
            at = RNG.randrange(len(text) // 3, len(text) - 3)
            while text[:at].rstrip()[-1:] == ".":
                at += 2
            text = text[:at] + {1: "", 2: RNG.choice(["…", " [...]", '"}']), 3: RNG.choice(["\n-- end --", f"\nRef. K{i}"])}[kind]
            cut.add(i)
        elif kind == 4:
            text += "\n-- end --"
        elif kind == 5:
            text += f"\n- margin: {i / 10}\n- deposit: 2.5"
        elif kind == 6:
            text += " More details will follow shortly…"
        elif kind == 7:
            text += f'\n\nRef. K{i}'
        rows.append((i, text, f"s{i % 4}"))
    rows += [(2000, None, "s1"), (2001, "", "s1"), (2002, " \n", None), (2003, "n/a", "s1"), (2004, body(3000), "s2"), (0, rows[0][1], "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("truncated", F.lit("clash"))
    scored = c.score_truncation(df).cache()
    found = {r.doc_id for r in scored.where("truncated").collect()}
    assert scored.count() == len(rows) and len(found & cut) >= 0.98 * len(cut) and len(found - cut) <= 3
    # no text is left out for being short or looking like a title
    model = c.train(df.drop("truncated"))
    for text in ("The borr", "Lender sha", "Interest is pay", "The agent and the", "ACME - the board of directors appro"):
        assert model.score(text, "s1") >= 0.5, text
    for text in ("n/a", "Void", "See annex.", "Withdrawn.", "No text supplied.", "- margin: 1.2\n- deposit: 2.5", "\u200b \xa0"):
        assert model.score(text, "s1") < 0.5, text
    rates = {r.source: r.rate for r in c.truncation_rates(scored).collect()}
    assert None in rates and 0.2 < rates["s0"] < 0.5
    assert c.score_truncation(df.limit(0)).count() == 0


def test_placeholders_recur(spark):
    rows = [(i, body(3), "s") for i in range(60)] + [(100 + i, "Text follows ", "s") for i in range(4)] + [(200, "Text follo", "s")]
    forms = c.learn_forms(c.closings(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert "text follows" in forms.placeholders and "text follo" not in forms.placeholders and c.PLACEHOLDERS <= forms.placeholders


def test_closings():
    forms = c.Forms(frozenset({"ref. #", "more details will follow shortly…"}))
    assert c.close_of("It ended.\nRef. A12", forms).finished and not c.close_of("It was end\nRef. A12", forms).finished
    assert c.close_of("It ended. More details will follow shortly...", forms).finished and not c.close_of("It ended. The agent shall prom…", forms).finished
    assert c.close_of("Listed.\n- a: 1\n- b: 2", forms).lists == 2
    assert c.wording("Contact: desk@x.example Lund 5") == "contact: @ W #"
