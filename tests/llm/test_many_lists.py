import numpy as np
from pyspark.sql import functions as F

from tesserae.llm import vectors

DIMS = 64


def test_groups_stay_together_over_many_lists(spark, monkeypatch):
    """Small groups far from each other, in all directions alike, over so many lists that hardly one is in a list alone."""
    monkeypatch.setattr(vectors, "LIST_ROWS", 12)
    monkeypatch.setattr(vectors, "FIT_ROWS", 6000)
    rng = np.random.default_rng(9)
    base = vectors.unit(rng.normal(size=(3000, DIMS)))
    x = np.repeat(base, 4, axis=0) + 0.04 * rng.normal(size=(12_000, DIMS))
    x = vectors.unit(x.astype(np.float32))
    want = set()
    for g in range(len(base)):
        for a in range(4 * g, 4 * g + 4):
            want |= {(f"{a:05d}", f"{b:05d}") for b in range(4 * g, 4 * g + 4) if a != b and x[a] @ x[b] >= 0.85}
    rows = [(f"{i:05d}", v) for i, v in enumerate(x.astype(np.float32).tolist())]
    df = spark.createDataFrame(rows, "id string, v array<float>")
    found = vectors.similar_vectors(df, F.lit("a"), F.col("id"), F.col("v"), 10, 0.85, DIMS).collect()
    got = {(r["id"], r["neighbor_id"]) for r in found}
    assert got <= want and len(want) > 20_000 and len(got & want) >= 0.99 * len(want)


def test_lists_cut_and_merged_early_give_the_same(spark, monkeypatch):
    """One list, tight, as a whole or in blocks, its pairs merged often or at the end."""
    rng = np.random.default_rng(10)
    x = (rng.normal(size=DIMS) + 0.5 * rng.normal(size=(400, DIMS)) * rng.uniform(0, 1, size=(400, 1))).astype(np.float32)
    u = vectors.unit(x)
    want = set()
    for a, row in enumerate(np.round(u @ u.T, 12)):
        want |= {(f"{a:03d}", f"{b:03d}") for _, b in sorted((-row[b], b) for b in range(400) if b != a and row[b] >= 0.85)[:10]}
    df = spark.createDataFrame([(f"{i:03d}", v) for i, v in enumerate(x.tolist())], "id string, v array<float>").cache()
    for tile, block, pending in ((64, 1000, 1), (64, 1000, 10**9), (37, 130, 1)):
        for name, value in (("TILE_QUERIES", tile), ("TILE_MEMBERS", 2 * tile), ("QUERY_BLOCK", block), ("MEMBER_BLOCK", block), ("PENDING", pending)):
            monkeypatch.setattr(vectors, name, value)
        found = vectors.similar_vectors(df, F.lit("a"), F.col("id"), F.col("v"), 10, 0.85, DIMS).collect()
        assert {(r["id"], r["neighbor_id"]) for r in found} == want
