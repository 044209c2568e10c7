import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import vectors

DIMS = 16


def corpus(seed, n, noise=0.06):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 8, DIMS))
    v = np.concatenate([base[rng.integers(len(base), size=n // 2)] + noise * rng.normal(size=(n // 2, DIMS)), rng.normal(size=(n - n // 2, DIMS))])
    return (v * rng.uniform(0.3, 3, size=(n, 1))).astype(np.float32)


def brute(rows, k, floor):
    out = {}
    kinds = {kind for kind, _, _ in rows if kind}
    for kind in kinds:
        own = [(i, np.array(v, np.float32).astype(float)) for q, i, v in rows if q == kind and i is not None and v is not None and len(v) == DIMS and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
        if not own:
            continue
        ids, x = [i for i, _ in own], np.stack([v / np.linalg.norm(v) for _, v in own])
        s = x @ x.T
        for a, i in enumerate(ids):
            best = sorted((-round(s[a, b], 9), j) for b, j in enumerate(ids) if a != b and s[a, b] >= floor)[:k]
            out[kind, i] = best
    return out


def run(spark, rows, k=5, floor=0.85):
    df = spark.createDataFrame(rows, "q string, i string, v array<float>").withColumns({"kind": F.lit(1), "id": F.lit(2), "list": F.lit(3)})
    got = {}
    for r in vectors.similar_vectors(df, F.col("q"), F.col("i"), F.col("v"), k, floor, DIMS).collect():
        got.setdefault((r["kind"], r["id"]), []).append((-round(r["cosine"], 9), r["neighbor_id"]))
    return {key: sorted(v) for key, v in got.items()}


def test_one_list_is_exact_with_unusable_rows_copies_and_ties(spark):
    v = corpus(1, 120).tolist()
    rows = [(("a", "b")[i % 2], f"{i:03d}", x) for i, x in enumerate(v)]
    rows += [("a", f"copy{i:02d}", v[0]) for i in range(14)]
    bad = [None, [], v[0][:-1], [0.0] * DIMS, [float("nan")] + v[0][1:], [float("inf")] + v[0][1:], [None] + v[0][1:]]
    rows += [("a", f"bad{i}", x) for i, x in enumerate(bad)] + [(None, "x", v[0]), ("a", None, v[0])]
    want = brute(rows, 5, 0.85)
    assert run(spark, rows) == {key: x for key, x in want.items() if x}


def test_recall_and_precision_over_many_lists(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LIST_ROWS", 50)
    v = corpus(2, 3000)
    rows = [("a", f"{i:05d}", x) for i, x in enumerate(v.tolist())]
    want = {(key, j) for key, best in brute(rows, 10, 0.85).items() for _, j in best}
    got = {(key, j) for key, best in run(spark, rows, 10).items() for _, j in best}
    assert len(want) > 2000 and len(got & want) >= 0.95 * len(want)


def test_codes_lose_less_along_the_vector(spark):
    x = vectors.unit(corpus(3, 800))
    loss = {}
    for eta in (1.0, 4.0):
        words = vectors.codewords(x, eta)
        codes = vectors.encode(x, words, eta)
        error = x - vectors.decode(codes, words)
        along = (error * x).sum(axis=1)
        loss[eta] = (along**2).mean()
        assert codes.max() < 16
        exact = x[:50] @ vectors.decode(codes, words).T
        assert np.allclose(vectors.scan(x[:50], codes, words), exact.T, atol=1e-4)
    assert loss[4.0] < loss[1.0]


def test_empty(spark):
    assert run(spark, []) == {}
    assert run(spark, [("a", "1", None)]) == {}


@pytest.mark.parametrize("n", [1, 2])
def test_tiny(spark, n):
    v = corpus(4, 16).tolist()
    rows = [("a", str(i), v[0]) for i in range(n)]
    assert run(spark, rows) == ({("a", "0"): [(-1.0, "1")], ("a", "1"): [(-1.0, "0")]} if n == 2 else {})


def test_two_levels_of_lists(spark, monkeypatch):
    """More lists than the sample has room for centroids on one level."""
    monkeypatch.setattr(vectors, "LIST_ROWS", 20)
    monkeypatch.setattr(vectors, "FIT_ROWS", 300)
    v = corpus(5, 4000)
    rows = [("a", f"{i:05d}", x) for i, x in enumerate(v.tolist())]
    want = {(key, j) for key, best in brute(rows, 10, 0.85).items() for _, j in best}
    got = {(key, j) for key, best in run(spark, rows, 10).items() for _, j in best}
    assert len(want) > 2000 and len(got & want) >= 0.9 * len(want)


def test_nearest_lists_are_the_nearest_sums(monkeypatch):
    rng = np.random.default_rng(6)
    x = vectors.unit(rng.normal(size=(50, DIMS))).astype(np.float32)
    first, second = vectors.unit(rng.normal(size=(4, DIMS))).astype(np.float32), rng.normal(size=(5, DIMS)).astype(np.float32) / 4
    to, home = vectors.nearest_lists(x, first, second, 4)
    sums = (first[:, None] + second[None]).reshape(-1, DIMS)
    distance = ((x[:, None] - sums[None]) ** 2).sum(axis=2)
    assert [set(r) for r in to] == [set(r) for r in np.argsort(distance, axis=1)[:, :4]]
    assert (to[home] == distance.argmin(axis=1)).all()


@pytest.mark.parametrize("query_block, member_block, tile", [(16, 24, 7), (1000, 1000, 64)])
def test_blocks_of_a_large_list_give_the_same(spark, monkeypatch, query_block, member_block, tile):
    """A list cut into blocks, in dense and sparse tiles, with ties and copies."""
    for name, value in (("QUERY_BLOCK", query_block), ("MEMBER_BLOCK", member_block), ("TILE_QUERIES", tile), ("TILE_MEMBERS", tile)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(7)
    tight = (rng.normal(size=DIMS) + 0.05 * rng.normal(size=(90, DIMS))).astype(np.float32)
    v = np.concatenate([corpus(8, 80), tight, tight[:20] * 2, tight[:5]]).tolist()
    rows = [("a", f"{i:03d}", x) for i, x in enumerate(v)]
    assert run(spark, rows) == {key: x for key, x in brute(rows, 5, 0.85).items() if x}
