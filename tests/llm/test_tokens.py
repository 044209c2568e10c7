import random

import pytest
from pyspark.sql import functions as F

from tesserae.llm import tokens

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def public():
    with open(tokens.VOCABULARY, "rb") as f:
        ranks = tokens.parse_ranks(f.read())
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


def test_ids_equal_those_of_the_public_library(spark, public):
    rng = random.Random(2)
    texts = [None, "", " ", "hello world", "don't we'll", "<|endoftext|>", "é漢字😀​", "a" * 5000, "\n\n  x", "123 4567", "\t\r\n"]
    texts += ["".join(rng.choice("abcde fgh 12'\n\té漢😀stdnlve") for _ in range(rng.randrange(200))) for _ in range(200)]
    rows = list(enumerate(texts)) + [(0, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "ids": F.lit(2)})
    got = tokens.encode_texts(df, F.col("doc_id"), F.col("text")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r["key"]]
        assert r["ids"] == (public[0].encode_ordinary(text) if text else []), text
    counts = {r["key"]: r["n_tokens"] for r in tokens.count_tokens(df, F.col("doc_id"), F.col("text"), F.col("ids").alias("x")).collect()}
    assert counts == {r["key"]: len(r["ids"]) for r in got}


def test_scan_and_heap_agree(public):
    rng = random.Random(1)
    for n in (1, 2, 5, 60, 500):
        for _ in range(30):
            word = "".join(rng.choice("aaabcdefé漢 ") for _ in range(n)).encode()
            assert tokens.merge_scan(word, public[1]) == tokens.merge_heap(word, public[1])


def test_long_text_is_streamed(public, monkeypatch):
    monkeypatch.setattr(tokens, "STREAM_CHARS", 10)
    with open(tokens.VOCABULARY, "rb") as f:
        encoder = tokens.Encoder(f.read())
    text = "The quick brown fox  jumps \n over 12 dogs"
    assert encoder.encode(text) == public[0].encode_ordinary(text)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.encode_texts(df, F.col("doc_id"), F.col("text")).collect() == []
