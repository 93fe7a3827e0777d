import json
import os

import pytest
from pyspark.sql import functions as F

from quillspan.functions import text as t
from quillspan.operators import chat, clean, corpus, metrics, news, trace
from quillspan.operators import similarity as sim
from quillspan.sources import files


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("r")).first()["r"]


def test_text_functions(spark):
    assert one(spark, t.sentences(F.col("x")), x="RSI is 62.4 vs. 50. Fine! Is it? e.g. yes") == 4
    assert one(spark, t.words(F.col("x")), x=" a  b\tc ") == 3 and one(spark, t.words(F.col("x")), x="") == 0
    assert one(spark, t.numbers(F.col("x")), x="USD 10,000,000 at 3.50 and 3.5") == [10000000.0, 3.5]
    assert one(spark, t.numbers_found(F.col("a"), F.col("b")), a="3.5:1", b="ratio 3.50:1") is True
    assert one(spark, t.numbers_found(F.col("a"), F.col("b")), a="none", b="1") is False
    assert one(spark, t.grams(t.terms(F.col("x"))), x="Ab cd ef") == ["ab", "cd", "ef", "ab cd", "cd ef"]
    assert one(spark, t.grams(t.terms(F.col("x"))), x="ab") == ["ab"] and one(spark, t.grams(t.terms(F.col("x"))), x="") == []
    assert json.loads(one(spark, t.balanced_json(F.col("x")), x='bad {x} then ```{"a": "}{", "b": {"c": 1}}``` end')) == {"a": "}{", "b": {"c": 1}}
    assert one(spark, t.salvaged_json(F.col("x")), x='so: {"a": 1} ok') == '{"a": 1}' and one(spark, t.salvaged_json(F.col("x")), x="nothing") is None


def test_cleaning(spark):
    assert one(spark, clean.title_key(F.col("x")), x="AT&amp;T: up  5%!") == "att up  5"
    assert one(spark, clean.shown(F.col("x")), x=" a ​ b\tc ") == "a bc"
    assert one(spark, clean.redacted(F.create_map(F.lit("API_Key"), F.col("x"), F.lit("q"), F.col("x"))), x="v" * 600) == {"API_Key": "<redacted>", "q": "v" * 500}
    assert one(spark, clean.blank_to_null(F.col("x")), x=" N/A ") is None


def test_metrics(spark):
    df = spark.createDataFrame([(1, "a b c d", "a b c d"), (2, "a b", "x y"), (3, "a c e", "a b c d e"), (4, "", "a"), (5, None, "a")], "id int, p string, r string")
    f = {r.id: r.s for r in df.select("id", metrics.overlap_score(F.col("p"), F.col("r")).alias("s")).collect()}
    assert f[1]["f"] == 1.0 and f[2]["f"] == 0.0 and f[4]["f"] == 0.0 and f[5]["f"] == 0.0
    assert f[3]["precision"] == 1.0 and f[3]["recall"] == 0.6
    arr = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    row = df.limit(1).select(metrics.set_f1(arr("A ", "b"), arr("a")), metrics.set_f1(arr(), arr()), metrics.set_f1(arr(), arr("x"))).first()
    assert list(row) == [0.6667, 1.0, 0.0]
    got = df.limit(1).select(
        metrics.ungrounded_parties(arr("Helvern Holdings Limited", "Nowhere Group"), F.lit("helvern signs at 3.50:1")), metrics.ungrounded_terms(arr("3.5:1", "4.0:1", "quarterly signs", "SOFR"), F.lit("helvern signs at 3.50:1"))
    ).first()
    assert got[0] == ["Nowhere Group"] and got[1] == ["4.0:1", "SOFR"]
    base = spark.createDataFrame([(0.5, 0.2)], "a double, bad double")
    other = spark.createDataFrame([(0.5, 0.1)], "a double, bad double")
    assert {r.metric: r.mark for r in metrics.compare(base, other, ["a", "bad"], ("bad",)).collect()} == {"a": "same", "bad": "better"}


def cosine(a, b):
    import math
    import re
    from collections import Counter

    def vec(x):
        w = re.findall(r"\w\w+", x.lower())
        return Counter([*w, *[" ".join(p) for p in zip(w, w[1:], strict=False)]])

    x, y = vec(a), vec(b)
    norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y[k] for k, v in x.items()) / norm if norm else 0.0


def test_similarity_and_guard(spark):
    import random

    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = []
    for i in range(60):
        if texts and rng.random() < 0.5:
            w = rng.choice(texts).split()
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(rng.choices(vocabulary, k=12)))
    texts += [texts[0], "", "!", "!"]
    rows = [(i, i % 2, x) for i, x in enumerate(texts)] + [(900, 0, None)]
    df = spark.createDataFrame(rows, "doc_id long, source int, text string")
    expected, accepted = set(), {}
    for i, s, x in rows:
        if x is None:
            continue
        near = [j for j, u, y in rows[:i] if u == s and y and cosine(x, y) >= 0.72 - 1e-9]
        expected |= {(j, i) for j in near if rows[j][2] != x}
        accepted[i] = not any(accepted[j] for j in near)
    first = {(s, x): i for i, s, x in reversed(rows)}
    got = {(r.a, r.b) for r in sim.similar_pairs(df, ["source"]).collect()}
    keep = {(a, b) for a, b in expected if first[rows[a][1], rows[a][2]] == a and first[rows[b][1], rows[b][2]] == b}
    assert got == keep
    assert {r.doc_id: r.accepted for r in sim.duplicate_guard(df, ["source"]).collect()} == accepted
    assert sim.similarity_report(df.where("false"), ["source"]).count() == 0


def test_nearest(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8))
    v[7] = v[8]
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(500, None), (501, [0.0] * 8)], "vec_id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {}
    for q in range(0, 300, 50):
        d = 1 - unit @ unit[q]
        d[q] = 9
        want[q] = sorted(range(300), key=lambda i: (round(d[i], 9), i))[:3]
    got = {}
    for r in sim.nearest(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert {k: x for k, x in got.items() if k < 300} == want
    assert sim.nearest(df, df.where("false")).count() == 0


def test_corpus(spark):
    df = spark.createDataFrame([(1, "loan loans margin"), (2, "margin margin the shall"), (3, None), (4, "")], "doc_id long, text string").withColumn("source", F.lit("s"))
    assert [(r.term, r.n) for r in corpus.keyword_report(df, 2).collect()] == [("margin", 3), ("loan", 1)]
    h = corpus.histogram(spark.createDataFrame([(1.0,), (1.0,)], "v double"), F.col("v"))
    assert h.count() == 12 and h.where("n = 2").first().bin == 7
    assert corpus.histogram(df.where("false"), F.col("doc_id")).count() == 0
    e = corpus.axis_entropy(df, {"a": F.lit("x"), "b": F.col("doc_id")}).orderBy("axis").collect()
    assert e[0].entropy == 0.0 and e[1].entropy == 1.0
    bad = spark.createDataFrame([(5, 0.97, 1.0, 0.01, 0.0, 100.0, 0.01, 0)], "near_pairs long, mean_cosine double, p95_cosine double, cv double, type_entropy double, type_max_share double, uniqueness double, edge_cases long")
    assert not any(r.passed for r in corpus.verdict(bad).collect())


def test_news(spark):
    rows = [(i, "A", f"s{r}", r, p, f"title {r} {p}") for i, (r, p) in enumerate([(0, 1), (0, 2), (1, 1), (1, 2), (2, 1)])] + [(9, "A", "s1", 1, 3, "Title 0 1!")]
    df = spark.createDataFrame(rows, "item_id long, symbol string, source string, source_rank int, pos int, headline string")
    assert sorted(r.item_id for r in news.union_by_rank(df, minimum=3).collect()) == [0, 1, 2, 3]
    asked = spark.createDataFrame([(1, "Up!"), (2, "Down"), (3, None)], "id int, headline string")
    given = spark.createDataFrame([("up", "neutral", 0.1, 1), ("UP", "positive", 0.9, 2)], "headline string, sentiment string, confidence double, at int")
    got = {r.id: (r.sentiment, r.answered) for r in news.reconcile(asked, given, "id", "headline", {"sentiment": F.lit("neutral"), "confidence": F.lit(0.0)}, "at").collect()}
    assert got == {1: ("positive", True), 2: ("neutral", False), 3: ("neutral", False)}
    scored = spark.createDataFrame([("A", "positive", 0.9), ("A", "negative", 0.3), ("B", "neutral", 0.0)], "symbol string, sentiment string, confidence double")
    assert {r.symbol: (r.score, r.label) for r in news.weighted_sentiment(scored, ["symbol"]).collect()} == {"A": (0.5, "positive"), "B": (0.0, "neutral")}
    model = lambda texts: [("positive", 0.5)] * len(texts)
    assert news.classify(asked, "headline", model).count() == 3


def test_chat(spark):
    turns = spark.createDataFrame([(1, i, role, "x" * 40) for i, role in enumerate(["system", "user", "assistant", "user", "assistant"])], "conv_id int, turn int, role string, content string")
    assert [r.turn for r in chat.trim_to_budget(turns, 130).orderBy("turn").collect()] == [0, 3, 4]
    assert [r.turn for r in chat.trim_to_budget(turns, 10).orderBy("turn").collect()] == [0]
    df = spark.range(1000).select(F.col("id").alias("rec_id"), F.when(F.col("id") < 2, "tiny").when(F.col("id") < 12, None).otherwise("big").alias("t"))
    n = {(r.t, r.split): r["count"] for r in chat.stratified_split(df, "t").groupBy("t", "split").count().collect()}
    assert n == {("tiny", "train"): 2, (None, "test"): 1, (None, "validation"): 1, (None, "train"): 8, ("big", "test"): 99, ("big", "validation"): 99, ("big", "train"): 790}
    assert chat.seed_grid({"a": ["1", "2"], "b": ["x", "y", "z"]}, spark).count() == 6


def test_trace(spark):
    import datetime as dt

    now = dt.datetime(2026, 1, 2)
    cache = spark.createDataFrame([("A", now - dt.timedelta(hours=30), "r"), ("B", now - dt.timedelta(hours=1), "r"), ("C", now, None), ("D", None, "r")], "ticker string, cached_at timestamp, report string").withColumn("as_of", F.lit("x"))
    wanted = spark.createDataFrame([(k,) for k in (" a", "B", "C", "D", "E")], "ticker string").withColumn("as_of", F.lit("x"))
    got = {r.ticker: r.reason for r in trace.cache_lookup(wanted, cache, F.lit("2026-01-02").cast("timestamp")).collect()}
    assert got == {" a": "stale", "B": "hit", "C": "no report", "D": "bad stamp", "E": "missing"}
    log = spark.createDataFrame([(2, "r", 1, "x", {"a": "1", "b": "2"}), (1, "r", 1, "x", {"b": "2", "a": "1"}), (3, "r", 2, "y", None)], "call_id long, run_id string, seq int, tool string, inputs map<string,string>")
    assert sorted(r.call_id for r in trace.without_repeats(log).collect()) == [1, 3]


def test_sources(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A &amp;amp; B</title><pubDate>x</pubDate><link>l</link></item><item><title> </title></item></channel></rss>")
    assert [(r.headline, r.published) for r in files.read_rss(spark, f"{tmp_path}/f.xml", "s").collect()] == [("A & B", "x")]
    (tmp_path / "n.json").write_text('{"content": {"title": "T", "provider": {"displayName": "P"}, "canonicalUrl": {"url": "u"}}}\n{"title": "F", "publisher": "Q", "providerPublishTime": 0}\n')
    assert sorted((r.headline, r.source, r.published) for r in files.read_news_json(spark, f"{tmp_path}/n.json").collect()) == [("F", "Q", "1970-01-01T00:00:00Z"), ("T", "P", None)]
    (tmp_path / "l.jsonl").write_text('{"run_id": "a", "seq": 1, "timestamp": "bad"}\nnot json\n')
    log = files.read_log(spark, f"{tmp_path}/l.jsonl").cache()
    assert log.count() == 2 and log.where("corrupt is not null").count() == 1 and log.where("timestamp is not null").count() == 0
    rows = spark.createDataFrame([("A", "1", 1), ("B", "1", 2)], "ticker string, day string, v int")
    files.upsert_partitions(rows, f"{tmp_path}/cache", ["ticker", "day"])
    files.upsert_partitions(rows.where("ticker = 'A'").withColumn("v", F.lit(9)), f"{tmp_path}/cache", ["ticker", "day"])
    assert {r.ticker: r.v for r in spark.read.parquet(f"{tmp_path}/cache").collect()} == {"A": 9, "B": 2}
    assert files.clear_key(spark, f"{tmp_path}/cache", "ticker", "A") == 1 and spark.read.parquet(f"{tmp_path}/cache").count() == 1
    assert files.write_splits(rows.withColumn("split", F.col("ticker")), f"{tmp_path}/splits").count() == 2
    text = rows.limit(1).select(files.brief_text(F.col("ticker"), {"v": F.col("v"), "w": F.lit(None)})).first()[0]
    assert text == "# A\n\n- v: 1\n- w: unavailable"


def test_null_is_a_group_of_similar_texts(spark):
    text = "the borrower shall deliver the annual accounts to the lender"
    rows = [(1, None, text), (2, None, text), (3, None, text + " now"), (4, None, "other words"), (5, "s", text), (6, None, "..."), (7, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert {(r.source, r.a, r.b) for r in sim.similar_pairs(docs, ["source"]).collect()} == {(None, 1, 3)}
    assert {(r.source, r.doc_id, r.class_id) for r in sim.classes_of(docs, ["source"]).collect()} == {(None, 1, 1), (None, 2, 1), (None, 3, 3), (None, 4, 4), ("s", 5, 5), (None, 6, 6)}
    assert {(r.doc_id, r.accepted) for r in sim.duplicate_guard(docs, ["source"]).collect()} == {(1, True), (2, False), (3, False), (4, True), (5, True), (6, True)}
    assert [(r.source, r.texts, r.pairs, r.near_pairs) for r in sim.similarity_report(docs, ["source"]).collect()] == [(None, 4, 6, 3)]


def test_guard_over_a_stream(spark, tmp_path):
    from quillspan.streaming import live

    base = "the borrower shall deliver the annual accounts to the lender within ninety days"
    batches = [
        [(1, "s", base), (2, None, base), (3, "s", base + " of each year"), (4, "s", "other words of another kind altogether"), (5, "s", None)],
        [(6, "s", base), (7, None, "new words"), (8, "s", "something else was said here"), (9, "s", "something else was said there here"), (10, "s", "...")],
        [(11, "s", "something else was said here"), (12, "t", base)],
    ]
    schema = "doc_id long, source string, text string"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(f"{tmp_path}/in")
    outcome, query = live.guard_stream(stream, ["source"])
    got = {r.doc_id: r.accepted for r in outcome.collect()}
    everything = spark.createDataFrame([r for rows in batches for r in rows], schema)
    # files may arrive in another order; each text is decided once and the accepted ones hold no near pair
    assert set(got) == {r[0] for rows in batches for r in rows if r[2] is not None} and got[10] and got[12] and got[2] and got[7] and got[4]
    taken = everything.where(F.col("doc_id").isin([i for i, ok in got.items() if ok]))
    assert sim.similar_pairs(taken, ["source"]).count() == 0
    assert sum(got[i] for i in (1, 3, 6)) == 1 and sum(got[i] for i in (8, 9, 11)) == 1


def test_guard_log_and_report(spark):
    rows = [(1, "s", "alpha beta gamma delta"), (2, "s", "alpha beta gamma delta"), (3, "s", "alpha beta gamma other"), (4, "s", "nothing alike here"), (5, "s", "..."), (6, "t", "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    log = {r.doc_id: (r.accepted, r.closest_to) for r in sim.guard_log(docs, ["source"]).collect()}
    assert log == {1: (True, None), 2: (False, 1), 3: (log[3][0], 1), 4: (True, None), 5: (True, None), 6: (True, None)}
    report = sim.similarity_report(docs, ["source"]).collect()
    assert [(r.source, r.texts, r.pairs, r.max_cosine) for r in report] == [("s", 4, 6, 1.0)]
    assert sum(r.n for r in sim.cosine_histogram(docs, ["source"]).collect()) == 6
    assert [(r.a, r.b) for r in sim.first_offenders(docs, ["source"], threshold=0.3).collect()] == [(1, 3)]


def test_blocks_of_a_group(spark, monkeypatch):
    """A group in several blocks gives what one block gives."""
    import random

    rng = random.Random(9)
    rows = [(i, i % 2, " ".join(rng.choices([f"w{k}" for k in range(12)], k=8))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, source int, text string")
    want = {(r.a, r.b, round(r.cosine, 9)) for r in sim.similar_pairs(docs, ["source"], 0.6).collect()}
    counts = {(r.source, r.cosine): r.n for r in sim.cosine_counts(docs, ["source"]).collect()}
    log = {tuple(r) for r in sim.guard_log(docs, ["source"]).collect()}
    monkeypatch.setattr(sim, "BLOCK", 17)
    monkeypatch.setattr(sim, "FEW_PRODUCTS", 3)
    monkeypatch.setattr(sim, "COLUMNS", 5)
    assert {(r.a, r.b, round(r.cosine, 9)) for r in sim.similar_pairs(docs, ["source"], 0.6).collect()} == want and len(want) > 30
    assert {(r.source, r.cosine): r.n for r in sim.cosine_counts(docs, ["source"]).collect()} == counts
    assert {tuple(r) for r in sim.guard_log(docs, ["source"]).collect()} == log



def alike(n):
    """(id, source, text) of two groups with many near pairs and, each seventh, a copy."""
    import random

    rng = random.Random(5)
    rows = [(i * 7 % 1009, i % 2, " ".join(rng.choices([f"w{k}" for k in range(9)], k=7))) for i in range(n)]
    return rows + [(2000 + i, rows[i][1], rows[i][2]) for i in range(0, n, 7)] + [(2000, 0, rows[2][2] + " w1"), (1999, 1, "...")]


def one_by_one(rows, threshold=0.72):
    """{id: (accepted, similarity, closest)} of texts taken one after the other."""
    out = {}
    for i, s, x in sorted(rows):
        before = [(-round(cosine(y, x), 6), j) for j, u, y in sorted(rows) if j < i and u == s and out[j][0] and y != "..."]
        near = min([b for b in before if b[0]], default=(0, None)) if x != "..." else (0, None)
        out[i] = (x == "..." or -near[0] < threshold, -near[0] + 0.0, near[1])
    return out


def test_guard_and_log_in_rounds(spark, monkeypatch):
    """rounds of a few texts each decide what taking all one by one does; no table of near pairs is written."""
    rows = [r for r in alike(150) if r[0] != 2000]
    docs = spark.createDataFrame(rows, "doc_id long, source int, text string")
    want = one_by_one(rows)
    assert 10 < sum(x[0] for x in want.values()) < len(rows) - 30
    paths = []
    monkeypatch.setattr(sim, "written", lambda df, name, f=sim.written: paths.append(name) or f(df, name))
    for block, front in ((1024, 2048), (16, 5), (40, 20)):
        monkeypatch.setattr(sim, "BLOCK", block)
        monkeypatch.setattr(sim, "FRONT", front, raising=False)
        assert {r.doc_id: (r.accepted, r.similarity, r.closest_to) for r in sim.guard_log(docs, ["source"]).collect()} == want
        assert {r.doc_id: r.accepted for r in sim.duplicate_guard(docs, ["source"]).collect()} == {i: x[0] for i, x in want.items()}
    assert "guard-links" not in paths


def test_guard_takes_copies_from_its_blocks(spark, monkeypatch):
    """the outcome of copies comes from the packed blocks; no table of hashes is written. Batches of blocks are small while it runs."""
    rows = [r for r in alike(60) if r[0] != 2000] + [(3000, 0, "..."), (3001, None, "?"), (3002, None, "words here"), (3003, None, "words here")]
    docs = spark.createDataFrame(rows, "doc_id long, source int, text string")
    names, setting = [], "spark.sql.execution.arrow.maxBytesPerBatch"
    monkeypatch.setattr(sim, "written", lambda df, name, f=sim.written: names.append((name, spark.conf.get(setting))) or f(df, name))
    before = spark.conf.get(setting)
    got = {r.doc_id: r.accepted for r in sim.duplicate_guard(docs, ["source"]).collect()}
    alone = {i: x[0] for i, x in one_by_one([r for r in rows if r[0] < 3000]).items()}
    assert got == {**alone, 3000: True, 3001: True, 3002: True, 3003: False} and spark.conf.get(setting) == before
    assert "guard-classes" not in {n for n, _ in names}
    assert {int(b) for n, b in names if n in ("guard-ids", "guard-left", "guard-taken")} == {sim.BATCH_BYTES}


def test_blocks_are_neither_shuffled_nor_written_as_vectors(spark, monkeypatch):
    """F2 to F9: what is written is a few bytes a gram, and blocks meet without an exchange."""
    import glob
    import random

    rng = random.Random(2)
    rows = [(i, 0, " ".join(rng.choices([f"word{k}" for k in range(500)], k=60))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source int, text string")
    frames = []
    monkeypatch.setattr(sim, "written", lambda df, name, f=sim.written: frames.append(f(df, name)) or frames[-1])
    monkeypatch.setattr(sim, "BLOCK", 100)
    pairs = sim.similar_pairs(docs, ["source"], 0.5)
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    written = sum(os.path.getsize(p) for f in frames for folder in {os.path.dirname(x) for x in f.inputFiles()} for p in glob.glob(folder.removeprefix("file://") + "/*.parquet"))
    assert 0 < written < 2 * sum(len(x) for _, _, x in rows)


def test_first_and_worst_pairs_of_blocks(spark, monkeypatch):
    """the first k of all near pairs, whatever the blocks; of each block only those leave a task."""
    rows = [r for r in alike(150) if r[0] < 1010]
    docs = spark.createDataFrame(rows, "doc_id long, source int, text string")
    first = {}
    for i, s, x in sorted(rows):
        first.setdefault((s, x), i)
    ids = {s: [(i, x) for (u, x), i in first.items() if u == s] for s in (0, 1)}
    near = {s: [(a, b, round(cosine(x, y), 6)) for a, x in ids[s] for b, y in ids[s] if a < b and cosine(x, y) >= 0.72 - 1e-9] for s in (0, 1)}
    for block in (1024, 20):
        monkeypatch.setattr(sim, "BLOCK", block)
        for worst in (False, True):
            got = {s: [] for s in (0, 1)}
            for r in sim.first_offenders(docs, ["source"], 10, worst).orderBy("rank").collect():
                got[r.source].append((r.a, r.b, round(r.cosine, 6)))
            assert got == {s: sorted(near[s], key=lambda p: (-p[2] if worst else 0, p[0], p[1]))[:10] for s in (0, 1)}


def test_first_pairs_come_from_the_first_texts(spark, monkeypatch):
    """all pairs of a group are multiplied only where its first texts have fewer than k near pairs."""
    rows = [r for r in alike(150) if r[0] < 1010]
    # a group of texts that are alike only at its end, and one without near pairs
    rows += [(5000 + i, 2, f"only {i} said {i * i} here {i + 7}x") for i in range(60)] + [(5060 + i, 2, f"the same words again but {i:02d}") for i in range(4)]
    rows += [(6000 + i, 3, f"w{i} v{i}") for i in range(50)] + [(7000, None, "two alike here now"), (7001, None, "two alike here today now")]
    docs = spark.createDataFrame(rows, "doc_id long, source int, text string")
    first = {}
    for i, s, x in sorted(rows, key=lambda r: r[0]):
        first.setdefault((s, x), i)
    want = {}
    for s in (0, 1, 2, 3, None):
        own = [(i, x) for (u, x), i in first.items() if u == s]
        want[s] = sorted((a, b) for a, x in own for b, y in own if a < b and cosine(x, y) >= 0.72 - 1e-9)[:3]
    assert [len(x) for x in want.values()] == [3, 3, 3, 0, 1]
    every = []
    monkeypatch.setattr(sim, "BLOCK", 20)
    monkeypatch.setattr(sim, "FIRST", 8, raising=False)
    monkeypatch.setattr(sim, "_over_cells", lambda blocks, others, *a, f=sim._over_cells, **k: (every.append({r.source for r in blocks.select("source").collect()}) if others is None else None, f(blocks, others, *a, **k))[1])
    got = {s: [] for s in want}
    for r in sim.first_offenders(docs, ["source"], 3).orderBy("rank").collect():
        got[r.source].append((r.a, r.b))
    assert got == want
    assert every == [{2, 3}]


def test_report_and_histogram_of_blocks(spark, monkeypatch):
    """F2, F5, F8: counts of all pairs, copies included, whatever the blocks; the histogram leaves a task as its bins."""
    rows = [r for r in alike(100) if r[0] < 1010 or r[0] > 2000]
    docs = spark.createDataFrame(rows, "doc_id long, source int, text string")
    texts = {s: [x for _, u, x in rows if u == s and x != "..."] for s in (0, 1)}
    values = {s: [round(cosine(x, y), 6) for k, x in enumerate(t) for y in t[:k]] for s, t in texts.items()}
    bins = {}
    for s, v in values.items():
        for x in v:
            bins[s, min(int(x * 20), 19)] = bins.get((s, min(int(x * 20), 19)), 0) + 1
    for block in (1024, 20):
        monkeypatch.setattr(sim, "BLOCK", block)
        assert {(r.source, r.bin): r.n for r in sim.cosine_histogram(docs, ["source"]).collect()} == bins
        assert {(r.source, r.texts, r.pairs, r.near_pairs) for r in sim.similarity_report(docs, ["source"]).collect()} == {(s, len(texts[s]), len(v), sum(x >= 0.72 for x in v)) for s, v in values.items()}
    assert "Exchange" not in sim._counted(docs, ["source"], "doc_id", "text", lambda total: None, "n long")._jdf.queryExecution().executedPlan().toString()


def test_bins_of_cosines_at_their_edges():
    """F8: bins from single precision are those of cosines to six places, at edges too, copies counted."""
    import numpy as np

    rng = np.random.default_rng(8)
    n, grams = 300, 40
    counts = rng.integers(0, 3, (n, grams)) * (rng.random((n, grams)) < 0.3)
    counts[:30] = np.repeat(np.eye(grams, dtype=int)[:10], 3, 0) * rng.integers(1, 9, 30)[:, None]  # cosines of 0, 1 and, with the next ones, of 1/2
    counts[30:40, :4] = 1
    counts[30:40, 4:] = 0
    counts[counts.sum(1) == 0, 0] = 1
    row, gram = np.nonzero(counts)
    block = sim.Block.of(np.arange(n), np.ones(n, int), gram.astype(np.int64), row, counts[row, gram])
    want = np.minimum(sim._micro(block.cosines(block)) * 20 // 1_000_000, 19)
    assert (block.bins(block, 20) == want).all()
    assert {*(sim._micro(block.cosines(block)).ravel() % 50_000 == 0)} == {True, False} and len(set(want.ravel())) >= 15
    assert (block.products(block) == counts @ counts.T).all()
    none = sim.Block.of(np.arange(2), np.ones(2, int), np.array([100, 101]), np.arange(2), np.ones(2, int))
    assert (block.cosines(none) == 0).all() and (block.bins(none, 20) == 0).all()


def test_exact_quantiles(spark):
    import numpy as np

    from quillspan.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=5000).round(2), "b": np.array([3.0]), None: np.repeat([1.0, 2.0, 1e9], [3, 4, 5]), "d": np.arange(2.0)}
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("e", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    qs = {"q0": 0.0, "q1": 0.25, "q2": 0.5, "q3": 0.95, "q4": 1.0}
    got = {r.k: [r[q] for q in qs] for r in exact_quantiles(df, ["k"], "v", qs).collect()}
    assert set(got) == set(groups)
    for k, xs in groups.items():
        assert np.allclose(got[k], np.quantile(xs, list(qs.values())), rtol=1e-12), k
    one = exact_quantiles(df.where("k = 'a'"), [], "v", qs).first()
    assert np.allclose(list(one), np.quantile(groups["a"], list(qs.values())))


def test_text_functions(spark):
    from quillspan.functions import text as tx
    from quillspan.operators import trace as tr

    raw = ['x {"a": "}{", "b": {"c": 1}} y', "{{{{", '{"a": 1', 'say "{" then {"ok": true}', None, "```json\n{\"a\": [1]}\n```", '{bad {"a": 2} }', "{" * 50_000]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "x string").select(tx.balanced_json(F.col("x"))).collect()]
    assert got == ['{"a": "}{", "b": {"c": 1}}', None, None, '{"ok": true}', None, '{"a": [1]}', '{"a": 2}', None]
    contents = ["plain", None, '[{"type": "text", "text": "a"}, {"type": "thinking", "text": "b"}, "c", {"text": "d"}]', "[not json"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in contents], "x string").select(tx.content_text(F.col("x"))).collect()] == ["plain", "", "acd", "[not json"]
    row = spark.createDataFrame([(1234.5, None, "USD", ["x"])], "a double, b double, c string, l array<string>")
    assert tuple(row.select(tx.money(F.col("a"), F.col("c")), tx.money(F.col("b"), F.col("c")), tx.sign_class(F.col("a")), tx.sign_class(F.col("b")), tx.as_text(row, "l"), tx.as_text(row, "a")).first()) == ("$1,234.50", "n/a", "pos", "na", '["x"]', "1234.5")
    assert row.select(tx.outline(F.lit("T"), {"one": tx.bullets(F.col("l")), "none": F.lit(None).cast("string")})).first()[0] == "T\n\nONE\n- x"
    assert tuple(row.select(tx.retryable(F.lit(429), F.lit(None).cast("string")), tx.retryable(F.lit(400), F.lit("APITimeoutError")), tx.malformed_call(F.lit("Error: Failed to parse tool call")), tx.malformed_call(F.lit(None).cast("string"))).first()) == (True, True, True, False)
    calls = spark.createDataFrame([(1, "r", "x", True), (2, "r", "y", False), (3, "q", "x", False)], "call_id long, run_id string, agent string, ok boolean")
    ids = lambda df: [r.call_id for r in df.orderBy("call_id").collect()]
    assert ids(tr.filter_calls(calls)) == [1, 2, 3] and ids(tr.filter_calls(calls, run="r")) == [1, 2] and ids(tr.filter_calls(calls, agents=["x"], failures_only=True)) == [3] and ids(tr.filter_calls(calls, agents=[])) == []


def test_evaluation(spark, tmp_path):
    from quillspan.operators import evaluation as ev
    from quillspan.sources import files

    good = '{"clause_type": "indemnity", "parties": ["Acme Ltd"], "obligation": "Acme Ltd shall pay all costs.", "trigger_condition": null, "financial_terms": ["5%"], "risk_flag": "low", "risk_rationale": "Small sums only."}'
    clause = "Acme Ltd shall pay all costs of 5% within a month."
    rows = [(1, clause, good, good), (2, clause, good, f"```json\n{good}\n```"), (3, clause, good, "Sure: " + good.replace("Acme Ltd", "Zeta Corp")), (4, clause, good, "no idea"), (5, clause, "{}", good), (6, clause, good, None)]
    scored = ev.score_outputs(spark.createDataFrame(rows, "id long, clause string, reference string, raw string")).orderBy("id")
    got = {r.id: r for r in scored.collect()}
    assert got[1].overall == 1 and got[1].grounded and got[1].f == 1 and not got[1].fence and not got[1].preamble
    assert got[2].fence and not got[2].preamble and got[2].overall == 1
    assert got[3].preamble and got[3].parties_f1 == 0 and not got[3].grounded and got[3].parsed
    assert not got[4].parsed and got[4].overall == 0 and not got[4].grounded and not got[6].parsed and not got[6].preamble
    assert got[5].parsed and got[5].overall is None and got[5].grounded
    files.write_pages(scored, ev.review_sheet(scored, "id"), f"{tmp_path}/pages")
    assert "Suggestion: ungrounded values" in "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/pages").collect())
    second = spark.createDataFrame([(1, "bad", good, 9.0), (2, good, good, 9.0), (3, good, "bad", 9.0), (4, "bad", good, 1.0), (5, "bad", None, 9.0), (6, "bad", good, None)], "id long, first string, second string, s double")
    chosen = ev.choose_second(second, "s", F.lit(3.0))
    assert {r.id: (r.fired, r.final, r.improved) for r in chosen.collect()} == {1: (True, good, True), 2: (True, good, None), 3: (True, good, False), 4: (False, "bad", None), 5: (True, "bad", None), 6: (False, "bad", None)}
    assert tuple(ev.second_pass_summary(chosen, "id").first()) == (6, 3, 1, 1, 1)
    assert [r[0] for r in spark.createDataFrame([([],), ([-1.0, -1.0],)], "p array<double>").select(ev.perplexity(F.col("p"))).collect()] == [float("inf"), pytest.approx(2.718281828)]
