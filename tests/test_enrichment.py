from pyspark.sql import functions as F

from tesserae.operators import enrichment as e


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_enrich_in_batches(spark):
    class Echo:
        """The words of each text as keywords; nothing usable for a batch with the word bad."""

        def answer(self, messages):
            import json

            texts = [line.split("] ", 1)[1] for line in messages[0]["content"].split("\n")[1:]]
            return "x" if any("bad" in t for t in texts) else "ok " + json.dumps([{"keywords": t.split(), "entities": [{"name": t[:1]}, {"type": "x"}, 5]} for t in texts])

    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "c"), (4, "bad"), (5, "d")], "k int, t string").coalesce(1)
    got = {r["key"]: (r["keywords"], r["entities"] and [tuple(x) for x in r["entities"]]) for r in e.enrich(df, F.col("k"), F.col("t"), Echo(), 2).collect()}
    assert got == {1: (["a", "b"], [("a", "unknown")]), 2: (None, None), 3: (["c"], [("c", "unknown")]), 4: ([], []), 5: ([], [])}


def test_parse_entities(spark):
    df = spark.createDataFrame([('[{"name": "A", "type": "t"}, {"type": "x"}, {"name": ""}, {"name": "B"}]',), ("{}",), ("no",), (None,)], "j string")
    assert [[tuple(x) for x in r[0]] for r in df.select(e.parse_entities(F.col("j"))).collect()] == [[("A", "t"), ("B", "unknown")], [], [], []]


def test_keywords_and_rollup(spark):
    k = spark.createDataFrame([("Foo", 2), ("foo", 1), ("bar ", 3), (None, 1), (" ", 1)], "keyword string, place int")
    assert rows(e.first_spellings(k).select("id", "occurrences")) == [("bar", 1), ("foo", 1)]
    items = spark.createDataFrame([("f", 1, "A", "x"), ("f", 2, "B", None), ("f", 3, None, "y" * 300), ("g", 1, "C", "z")], "f string, p int, t string, s string")
    got = {r[0]: (r[1], r[2]) for r in e.rollup_items(items, "f", ["p"], "t", "s", 2).collect()}
    assert got == {"f": (3, "A: x\nB: "), "g": (1, "C: z")}


def brute(entries, limit):
    """Entry by entry, the way it is told."""
    held = {p: t for p, t, _ in entries}
    show = lambda: "\n\n".join(f"## {p}\n{t}" if t.strip() else f"## {p}" for p, t in held.items())
    order = [p for p, _, _ in sorted(entries, key=lambda x: (x[2], x[0]))]
    for cut in (lambda t: "\n".join(x for x in t.split("\n") if not x.startswith("imports:")), lambda t: "\n".join(x for x in t.split("\n") if not x.startswith("functions:")), lambda t: ""):
        for p in order:
            if len(show()) <= limit:
                return held
            held[p] = cut(held[p])
    return held


def test_bounded_index_equals_cutting_one_by_one(spark):
    entries = [(f"dir/f{i}.py", f"classes: K{i}\nfunctions: {'g' * (i * 3 % 11)}\nimports: {'m' * (i * 7 % 13)}", i % 4) for i in range(12)] + [("e.py", "", 0)]
    df = spark.createDataFrame(entries, "path string, text string, degree int")
    for limit in (10_000, 560, 500, 430, 380, 330, 250, 150, 0):
        assert {r["path"]: r["text"] for r in e.bounded_index(df, limit).collect()} == brute(entries, limit), limit
    assert e.bounded_index(df.limit(0), 10).count() == 0
