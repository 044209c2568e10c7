import random
import re

import pytest
from pyspark.sql import functions as F

from tesserae.llm import near


def grams(text, width=3):
    w = [x.lower() for x in re.findall(r"\w+", text or "")]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(rows, t):
    out = set()
    sets = [(k, i, grams(x)) for k, i, x in rows if k is not None and i is not None]
    for k, i, a in sets:
        for q, j, b in sets:
            if k == q and i < j and a and b and len(a & b) >= t * len(a | b) - 1e-9:
                out.add((k, i, j))
    return out


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "漢字", "x_1", "½"]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            base = rng.choice(texts).split()
            for _ in range(rng.randrange(4)):
                if base:
                    i = rng.randrange(len(base))
                    base[i : i + 1] = rng.choice([[], [rng.choice(vocabulary)], [base[i], rng.choice(vocabulary)]])
            texts.append(" ".join(base))
        else:
            texts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))))
    rows = [(rng.choice(["a", "b"]), f"{i:03d}", x) for i, x in enumerate(texts)]
    rows += [("a", f"z{i}", texts[0].upper() + " !") for i in range(12)]
    return rows + [("a", "n1", None), ("a", "n2", ""), ("a", "n3", "two words"), ("a", "n4", "two words"), (None, "n5", texts[0]), ("a", None, texts[0])]


@pytest.mark.parametrize("batch", [near.BATCH_GRAMS, 100])
def test_pairs_equal_brute_force(spark, monkeypatch, batch):
    rows = corpus(7)
    df = spark.createDataFrame(rows, "k string, i string, x string").withColumns({"doc": F.lit(1), "kind": F.lit(2), "n": F.lit(3)})
    monkeypatch.setattr(near, "BATCH_GRAMS", batch)
    found = near.near_duplicates(df.repartition(3), F.col("k"), F.col("i"), F.col("x"), 0.7, 3)
    got = [tuple(r)[:3] for r in found.pairs().collect()]
    want = brute(rows, 0.7)
    assert len(want) > 100 and len(got) == len(set(got)) and set(got) == want
    sets = {(k, i): frozenset(grams(x)) for k, i, x in rows if k is not None and i is not None}
    for r in found.classes().collect():
        own = sets[(r["kind"], r["id"])]
        assert r["class_id"] == min(i for (k, i), s in sets.items() if k == r["kind"] and s == own)


def test_empty(spark):
    df = spark.createDataFrame([], "k string, i string, x string")
    found = near.near_duplicates(df, F.col("k"), F.col("i"), F.col("x"), 0.7, 3)
    assert found.pairs().collect() == [] and found.classes().collect() == []


def test_classes_have_every_text_of_enough_words(spark):
    rows = corpus(8) + [("a", "lone", "nothing like this is anywhere else here")]
    found = near.near_duplicates(spark.createDataFrame(rows, "k string, i string, x string"), F.col("k"), F.col("i"), F.col("x"), 0.7, 3)
    sets = {(k, i): frozenset(grams(x)) for k, i, x in rows if k is not None and i is not None}
    got = {(r["kind"], r["id"]): (r["class_id"], r["n_links"]) for r in found.classes().collect()}
    assert set(got) == {key for key, s in sets.items() if s} and got["a", "lone"] == ("lone", 0)
    classes = {}
    for (k, i), s in sets.items():
        if s:
            classes.setdefault((k, s), []).append(i)
    for (k, s), ids in classes.items():
        others = [t for (q, t) in classes if q == k and t != s and len(s & t) >= 0.7 * len(s | t) - 1e-9]
        assert all(got[k, i] == (min(ids), len(others)) for i in ids)


@pytest.mark.parametrize("n", [1, 3, 50])
def test_any_number_of_fragments_counts_the_same(spark, monkeypatch, n):
    monkeypatch.setattr(near, "FRAGMENTS", n)
    monkeypatch.setattr(near, "FRAGMENT_CHARS", 500)
    rows = corpus(9, 60)
    found = near.near_duplicates(spark.createDataFrame(rows, "k string, i string, x string"), F.col("k"), F.col("i"), F.col("x"), 0.7, 3)
    assert {tuple(r)[:3] for r in found.pairs().collect()} == brute(rows, 0.7)
