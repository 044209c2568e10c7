from pyspark.sql import functions as F

from tesserae import pipeline
from tesserae.providers import HashEmbedder
from tesserae.sources.files import scan_files
from tesserae.store import Store


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_incremental_runs(spark, tmp_path):
    root = tmp_path / "files"
    (root / "a").mkdir(parents=True)
    (root / "a/x.md").write_text("# One\ntext\n\n# Two\nmore\n")
    (root / "a/y.py").write_text("def f():\n    return 1\n\n\ndef g():\n    return 2\n")
    (root / "z.txt").write_text("plain words")
    (root / "e.txt").write_text(" ")
    store = Store(spark, str(tmp_path / "tables"))
    parsed = []

    def parse(df):
        parsed.append(df.count())
        return df.select("hash", F.decode("content", "utf-8").alias("text"))

    job = pipeline.Ingest(store, HashEmbedder(8), parse=parse)
    scan = lambda: scan_files(spark, str(root)).withColumn("path", F.regexp_replace("path", ".*/files/", ""))
    assert job.run(scan()) == {"new": 4} and parsed == [4]
    assert rows(store.read("chunks").groupBy("path").count()) == [("a/x.md", 2), ("a/y.py", 2), ("z.txt", 1)]
    assert all(len(r["vector"]) == 8 for r in store.read("chunks").collect())
    before = {r["id"] for r in store.read("chunks").collect()}
    assert job.run(scan()) == {"unchanged": 4} and {r["id"] for r in store.read("chunks").collect()} == before

    (root / "z.txt").write_text("other words")
    (root / "a/y.py").unlink()
    (root / "copy.md").write_text("# One\ntext\n\n# Two\nmore\n")
    assert job.run(scan()) == {"unchanged": 2, "changed": 1, "new": 1, "deleted": 1} and parsed == [4, 1]
    assert rows(store.read("chunks").groupBy("path").count()) == [("a/x.md", 2), ("copy.md", 2), ("z.txt", 1)]
    assert rows(store.read("state").where("not active").select("path")) == [("a/y.py",)]
    assert store.read("chunks").select("id").distinct().count() == 5

    newer = pipeline.Ingest(store, HashEmbedder(4), embedder_id="hash.v2", parse=parse)
    assert newer.run(scan())["changed"] == 4 and parsed == [4, 1, 0] and all(len(r["vector"]) == 4 for r in store.read("chunks").collect())
    assert newer.run(scan(), force=True)["changed"] == 4
    for p in ("z.txt", "a/x.md", "copy.md", "e.txt"):
        (root / p).unlink()
    (root / "last.txt").write_text("x")
    assert newer.run(scan()) == {"new": 1, "deleted": 4} and rows(store.read("chunks").select("path")) == [("last.txt",)]


def test_boost(spark):
    state = spark.createDataFrame([("a/x", 4, "s"), ("a/y", 4, "s"), ("a/z", 1, "s"), ("b", 4, "s"), ("c/d", 4, "s")], "path string, priority int, state string")
    assert rows(pipeline.boost(state, spark.createDataFrame([("a/x",), ("a/x",), ("q/none",)], "path string"))) == [("a/x", 1, "s"), ("a/y", 2, "s"), ("a/z", 1, "s"), ("b", 4, "s"), ("c/d", 4, "s")]
    assert pipeline.boost(state, spark.createDataFrame([], "path string")).where("priority < 4").count() == 1
