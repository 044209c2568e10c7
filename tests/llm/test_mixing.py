import random

import pytest
from pyspark.sql import functions as F

from tesserae.llm import mixing

TARGETS = "mix string, source string, weight double, max_repeats int, size_ratio double"


def test_flight_keeps_totals_and_leaves_at_most_two():
    rng = random.Random(1)
    for n in (1, 2, 3, 10, 500):
        for top in (1, 5, 1000):
            tokens, chance = [rng.randrange(1, top + 1) for _ in range(n)], [rng.random() for _ in range(n)]
            before = sum(chance), sum(t * p for t, p in zip(tokens, chance))
            mixing.flight(tokens, chance, rng)
            assert all(0 <= p <= 1 for p in chance) and sum(0 < p < 1 for p in chance) <= 2
            assert before == pytest.approx((sum(chance), sum(t * p for t, p in zip(tokens, chance))), rel=1e-6, abs=1e-4)
            mixing.land(tokens, chance)
            assert set(chance) <= {0.0, 1.0}


def test_inclusion_is_fair():
    counts = [0] * 6
    for seed in range(3000):
        chance = [0.3] * 6
        mixing.flight([10, 20, 30, 10, 20, 30], chance, random.Random(seed))
        counts = [c + p for c, p in zip(counts, chance)]
    assert all(abs(c / 3000 - 0.3) < 0.03 for c in counts)


@pytest.mark.parametrize("block", [mixing.BLOCK_ROWS, 50])
def test_shares_caps_and_repeats(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", block)
    rng = random.Random(2)
    rows = [(i, rng.choice(["wiki"] * 6 + ["code"] * 3 + ["legal"]), rng.randrange(1, 400)) for i in range(3000)]
    rows += [(5000, None, 100), (5001, "wiki", 0), (5002, "wiki", None), (None, "wiki", 9), (0, rows[0][1], rows[0][2])]
    targets = [("m", "wiki", 0.3, 3, 1.0), ("m", "code", 0.4, 3, 1.0), ("m", "legal", 0.3, 2, 1.0), ("m", "mail", 0.0, 2, 1.0), ("few", "wiki", 2.0, None, 0.1), ("few", "none", 2.0, 3, 0.1), (None, "wiki", 1.0, 1, 1.0), ("m", "wiki", 0.1, 3, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, src string, n int").withColumns({"mix": F.lit(1), "copies": F.lit(2)})
    selection, shares = mixing.mix_sources(docs, F.col("doc_id"), F.col("src"), F.col("n"), spark.createDataFrame(targets, TARGETS))
    picked = selection.collect()
    assert len({(r["mix"], r["doc"]) for r in picked}) == len(picked)
    size = {i: (s, n) for i, s, n in rows if i is not None}
    total = sum(n or 0 for _, n in size.values())
    have = {}
    for s, n in size.values():
        have[s] = have.get(s, 0) + (n or 0)
    tokens, near = {}, 20 if block > 50 else 400  # a last block of few texts has fewer to make up with
    for r in picked:
        assert size[r["doc"]] == (r["source"], r["n_tokens"])
        assert 1 <= r["copies"] <= {"m": 3 if r["source"] != "legal" else 2, "few": 1}[r["mix"]]
        tokens[r["mix"], r["source"]] = tokens.get((r["mix"], r["source"]), 0) + r["copies"] * r["n_tokens"]
    assert abs(tokens["m", "wiki"] - 0.3 * total) <= near and abs(tokens["m", "code"] - 0.4 * total) <= 400
    assert tokens["m", "legal"] == 2 * have["legal"] < 0.3 * total
    assert abs(tokens["few", "wiki"] - 0.05 * total) <= near
    report = {(r["mix"], r["source"]): r for r in shares.collect()}
    assert len(report) == 6 and report["m", "legal"]["capped"] and not report["m", "wiki"]["capped"]
    for key, r in report.items():
        assert r["tokens"] == tokens.get(key, 0)
        assert r["share"] == pytest.approx(r["tokens"] / sum(v for (m, _), v in tokens.items() if m == key[0]))
    again, _ = mixing.mix_sources(docs.repartition(7), F.col("doc_id"), F.col("src"), F.col("n"), spark.createDataFrame(targets, TARGETS))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, picked))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, src string, n int")
    targets = spark.createDataFrame([("m", "wiki", 1.0, 3, 1.0)], TARGETS)
    selection, shares = mixing.mix_sources(docs, F.col("doc_id"), F.col("src"), F.col("n"), targets)
    assert selection.collect() == [] and [r["tokens"] for r in shares.collect()] == [0]
    selection, shares = mixing.mix_sources(docs, F.col("doc_id"), F.col("src"), F.col("n"), targets.limit(0))
    assert selection.collect() == [] and shares.collect() == []
