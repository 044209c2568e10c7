import random

import pytest
from pyspark.sql import functions as F

from tesserae.llm import spans

SPAN = 20


def brute(rows, span):
    texts = {k: t for k, t in rows if k is not None and t is not None}
    where = {}
    for k, t in texts.items():
        for i in range(len(t) - span + 1):
            where.setdefault(t[i : i + span], []).append((k, i))
    pairs, covered = set(), {}
    for at in where.values():
        keys = sorted({k for k, _ in at})
        if len(keys) > 1:
            pairs |= {(a, b) for a in keys for b in keys if a < b}
            for k, i in at:
                covered.setdefault(k, set()).update(range(i, i + span))
    return pairs, covered


def corpus(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdefgh é漢😀") for _ in range(n))
    shared = [word(rng.randrange(15, 60)) for _ in range(8)]
    rows = []
    for k in range(90):
        rows.append((k, "".join(rng.choice(shared) if rng.random() < 0.4 else word(rng.randrange(30)) for _ in range(rng.randrange(6)))))
    rows += [(200 + i, shared[0] + word(5)) for i in range(30)] + [(300 + i, rows[3][1]) for i in range(6)]
    rows += [(400, "-" * 300), (401, "-" * 150 + "x"), (402, "ab" * 80), (403, "ab" * 60), (404, None), (405, ""), (None, shared[0]), (406, "z" * 19), (407, "z" * 19), (1, rows[1][1])]
    return rows


@pytest.mark.parametrize("size", [spans.SLICE, 50, 64])
def test_pairs_and_coverage_equal_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(spans, "SLICE", size)
    rows = corpus(4)
    df = spark.createDataFrame(rows, "k long, t string").withColumns({"doc": F.lit(1), "text": F.lit("x"), "place": F.lit(0)})
    found = spans.shared_spans(df, F.col("k"), F.col("t"), SPAN)
    pairs, covered = brute(rows, SPAN)
    got = [tuple(r) for r in found.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == pairs and len(pairs) > 100
    cover = {}
    for r in found.spans().collect():
        part = set(range(r["start"], r["start"] + r["length"]))
        assert not part & cover.get(r["doc"], set())
        cover.setdefault(r["doc"], set()).update(part)
    assert cover == covered


def test_production_length(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    just, short = word(200), word(199)
    rows = [(1, word(300) + just + word(50)), (2, "!" + just + "?"), (3, "1" + short + "2"), (4, "3" + short + "4"), (5, word(5000))]
    found = spans.shared_spans(spark.createDataFrame(rows, "k long, t string"), F.col("k"), F.col("t"))
    assert [tuple(r) for r in found.pairs().collect()] == [(1, 2)]
    assert {tuple(r) for r in found.spans().collect()} == {(1, 300, 200), (2, 1, 200)}


def test_empty(spark):
    found = spans.shared_spans(spark.createDataFrame([], "k long, t string"), F.col("k"), F.col("t"))
    assert found.pairs().collect() == [] and found.spans().collect() == []


def test_factors_copy_their_reference(spark):
    rows = corpus(5)
    texts = {k: t for k, t in rows if k is not None and t}
    found = spans.shared_spans(spark.createDataFrame(rows, "k long, t string"), F.col("k"), F.col("t"), SPAN)
    factors = [tuple(r) for r in found.factors.collect()]
    assert len(factors) > 20
    for doc, start, length, ref_doc, ref_start in factors:
        assert length >= SPAN and texts[doc][start : start + length] == texts[ref_doc][ref_start : ref_start + length]


@pytest.mark.parametrize("seed", range(6))
def test_short_alphabets_and_edges_of_runs(spark, seed):
    """Runs that just reach the length, periodic texts, copies that part and meet again."""
    rng = random.Random(100 + seed)
    word = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    base = [word(60, "ab"), word(45, "abc"), "ab" * 30, "aab" * 20]
    rows = []
    for k in range(70):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            b = rng.choice(base)
            cut = rng.randrange(max(1, len(b) - SPAN))
            piece = list(b[cut : cut + SPAN + rng.randrange(-2, 12)])
            if piece and rng.random() < 0.5:
                piece[rng.randrange(len(piece))] = rng.choice("abcx")
            parts += ["".join(piece), word(rng.randrange(6), "abcxyz")]
        rows.append((k, "".join(parts)))
    found = spans.shared_spans(spark.createDataFrame(rows, "k long, t string"), F.col("k"), F.col("t"), SPAN)
    pairs, covered = brute(rows, SPAN)
    assert {tuple(r) for r in found.pairs().collect()} == pairs
    cover = {}
    for r in found.spans().collect():
        cover.setdefault(r["doc"], set()).update(range(r["start"], r["start"] + r["length"]))
    assert cover == covered


def test_of_two_texts_under_one_key_one_counts(spark):
    rng = random.Random(11)
    a, b = ("".join(rng.choice("abcdef") for _ in range(60)) for _ in range(2))
    rows = [(1, a), (1, b), (1, b), (2, a + "x"), (3, "y" + b)]
    found = spans.shared_spans(spark.createDataFrame(rows, "k long, t string"), F.col("k"), F.col("t"), SPAN)
    assert [tuple(r) for r in found.pairs().collect()] in ([(1, 2)], [(1, 3)])
    assert found.spans().count() == 2
