import pytest

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspan.llm import encoding
from quillspan.llm.encoding import Encoder, encode_texts, load_vocabulary, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
OURS = Encoder(load_vocabulary(PATH))
THEIRS = tokenizers.Tokenizer.from_file(PATH)
THEIRS.encode_special_tokens = True


def ids(texts):
    offsets, values = OURS(texts)
    return [values[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)]


def want(texts):
    return [e.ids for e in THEIRS.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_cases():
    texts = [None, "", " ", "\n\n  x", "<|endoftext|>", "aaaa" * 5000, "naïve 12,345 ﬁ 😀 семь 第9724号", "it's we'LL", "\u0000​", "z" * 100_000]
    assert ids(texts) == want(texts) and ids([None, ""]) == [[], []]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_text(texts):
    assert ids(texts) == want(texts)


def test_rows(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (3, "")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = sorted((r.doc_id, r.ids) for r in encode_texts(df).collect())
    assert got == [(1, want(["a b"])[0])] * 2 + [(2, []), (3, [])]
    assert encode_texts(df.limit(0)).count() == 0
    # parts of a partition, whatever their size
    texts = [f"word{i % 37} {'long' * (i % 5)} x" for i in range(500)]
    monkeypatch.setattr(encoding, "PART_CHARS", 300)
    many = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert [r.ids for r in encode_texts(many).orderBy("doc_id").collect()] == want(texts)
