import random
import re

import pytest
from pyspark.sql import functions as F

from tesserae.llm.splitting import split_items

LIMIT, OVERLAP = 40, 8
RUNS = (("paragraph", r"(?:\r?\n){2,}"), ("line", r"\r?\n"), ("word", r"[ \t\r\n]+"))


def cut_at(text, limit):
    if len(text) <= limit:
        return None
    return next((name for name, run in RUNS if max(map(len, re.split(run, text))) <= limit), "char")


def texts():
    rng = random.Random(5)
    out = ["", "short", None, "x" * 200, " " * 100, "\n" * 130, "\r\n" * 90, "é😀" * 60, "a" * 40, "a" * 41, ("a" * 40 + "\n\n") * 3, "w " * 100, "a" * 39 + "\r\n" + "b" * 50, "\r" * 90]
    atoms = ["ab", "word", " ", " ", "\n", "\n\n", "\r\n", "\r\n\r\n", "漢字", "😀", "longerword" * 3, "\t", "x" * 45]
    return out + ["".join(rng.choice(atoms) for _ in range(rng.randrange(1, 90))) for _ in range(300)]


def test_round_trip_limit_overlap_and_cuts(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "id int, content string").withColumns({"key": F.lit(0), "pieces": F.lit(0), "text": F.lit("no")})
    got = {r["key"]: r for r in split_items(df, F.col("id"), F.col("content"), LIMIT, OVERLAP).collect()}
    for i, text in rows:
        r = got[i]
        if text is None:
            assert r["pieces"] is None and r["cut_at"] is None
            continue
        assert r["n_chars"] == len(text)
        assert "".join(p["text"][p["overlap"]:] for p in r["pieces"]) == text
        at = 0
        for k, p in enumerate(r["pieces"]):
            assert len(p["text"]) <= LIMIT and p["overlap"] <= OVERLAP and p["start"] == at
            assert text[at - p["overlap"] : at - p["overlap"] + len(p["text"])] == p["text"]
            at += len(p["text"]) - p["overlap"]
            if p["cut"] in ("paragraph", "line", "word"):
                assert not (text[at - 1] == "\r" and text[at] == "\n")
            assert (p["cut"] == "end") == (k == len(r["pieces"]) - 1)
        assert r["cut_at"] == cut_at(text, LIMIT), (text, r)


def test_overlap_is_full_where_room_is_left(spark):
    text = "\n\n".join("p" * 20 for _ in range(10))
    r = split_items(spark.createDataFrame([(1, text)], "id int, content string"), F.col("id"), F.col("content"), LIMIT, OVERLAP).first()
    assert all(p["overlap"] == OVERLAP for p in r["pieces"][1:])


def test_empty_table_repeats_and_bad_arguments(spark):
    df = spark.createDataFrame([], "id int, content string")
    assert split_items(df, F.col("id"), F.col("content"), 5, 1).count() == 0
    twice = spark.createDataFrame([(1, "a b c d")] * 2, "id int, content string")
    assert split_items(twice, F.col("id"), F.col("content"), 5, 1).count() == 2
    with pytest.raises(ValueError):
        split_items(df, F.col("id"), F.col("content"), 5, 5)


def test_very_long_text(spark):
    text = ("word " * 9 + "\n") * 40_000
    df = spark.range(1).select("id", F.lit(text).alias("content"))
    r = split_items(df, F.col("id"), F.col("content"), 1200, 120).select(F.size("pieces").alias("n"), "cut_at").first()
    assert r["cut_at"] == "line" and r["n"] > len(text) // 1200
