from pyspark.sql import functions as F

from tesserae.operators.heavy_keys import distinct_counts, distinct_sets, spread_pairs
from tesserae.tables import squeeze

ROWS = [("Acme  Corp", "c1", 1), (" acme corp ", "c1", 2), ("ACME\tcorp", "c2", 3), ("b", None, 4), (None, "c3", 5), ("  ", "c4", 6), ("b", "c9", 7), ("b", "c9", 7)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "entity_name string, chunk_id string, n int")


def brute(rows):
    sets = {}
    for name, chunk, _ in rows:
        key = " ".join((name or "").split()).lower()
        if key and chunk is not None:
            sets.setdefault(key, set()).add(chunk)
    return sets


def test_counts_nulls_blanks_and_repeats(spark):
    got = {r["key"]: r["n"] for r in distinct_counts(frame(spark, ROWS), squeeze("entity_name"), F.col("chunk_id")).collect()}
    assert got == {k: len(v) for k, v in brute(ROWS).items()}


def test_sets_of_a_heavy_key_are_cut_into_pieces_and_whole(spark):
    rows = [("hot", f"c{i % 700:04d}", i) for i in range(3000)] + [(f"k{i}", f"c{i}", i) for i in range(50)]
    df = frame(spark, rows)
    out = distinct_sets(df, squeeze("entity_name"), F.col("chunk_id"), partitions=6, piece_rows=100).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["key"], r["first_value"])):
        assert r["n"] == len(r["values"]) <= 100 and r["values"][0] == r["first_value"]
        got.setdefault(r["key"], []).extend(r["values"])
    assert got == {k: sorted(v) for k, v in brute(rows).items()}
    assert len({(r["key"], r["piece"]) for r in out}) == len(out)
    parts = spread_pairs(df, squeeze("entity_name"), F.col("chunk_id"), 6).where("key = 'hot'").select(F.spark_partition_id()).distinct().count()
    assert parts >= 4


def test_no_exchange_between_range_partitioning_and_distinct(spark):
    plan = spread_pairs(frame(spark, ROWS), squeeze("entity_name"), F.col("chunk_id"), 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan


def test_empty(spark):
    df = frame(spark, [])
    assert distinct_counts(df, squeeze("entity_name"), F.col("chunk_id")).count() == 0
    assert distinct_sets(df, squeeze("entity_name"), F.col("chunk_id")).count() == 0
