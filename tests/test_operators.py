import pytest
from pyspark.sql import functions as F

from tesserae import minisql
from tesserae.functions.casting import coerce, infer_type, profile
from tesserae.functions.text import normalize, tokens
from tesserae.operators import chunking, decision_log, graph, ingest, search
from tesserae.plans.sqlfront import run_sql, translate
from tesserae.sources import files


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_related_chunks_of_the_literal_case(spark):
    edges = spark.createDataFrame([("a", "c1"), ("b", "c1"), ("c", "c1"), ("a", "c2"), ("b", "c2"), ("a", "c3"), ("z", "c4")], "entity string, chunk string")
    seeds = spark.createDataFrame([("c1",)], "chunk string")
    assert rows(graph.related(edges, seeds, 1, 10)) == [("c2", 2, 1), ("c3", 1, 2)]
    assert rows(graph.related(edges, seeds.limit(0), 1, 10)) == []


def test_knn_skips_unusable_vectors_and_is_exact(spark):
    data = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0]), (7, [float("nan"), 1.0]), (8, [2.0, 0.0])], "id int, vector array<double>")
    queries = spark.createDataFrame([(9, [3.0, 0.0]), (10, [0.0, 0.0]), (11, None)], "qid int, vector array<double>")
    got = search.knn(data, queries, 3).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["id"], r["rank"]) for r in got] == [(9, 1, 1), (9, 8, 2), (9, 3, 3)]
    assert search.knn(data.limit(0), queries, 3).collect() == [] and search.knn(data, queries.limit(0), 3).collect() == []


def test_knn_in_blocks(spark, monkeypatch):
    data = spark.range(50).select(F.col("id"), F.array(F.col("id") + 1.0, F.lit(5.0)).alias("vector"))
    queries = data.withColumnRenamed("id", "qid")
    whole = rows(search.knn(data, queries, 2))
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    assert rows(search.knn(data, queries, 2)) == whole and len(whole) == 100


def test_fusion_boost_and_diversity(spark):
    a = spark.createDataFrame([(1, "x", 0.9, 1), (1, "y", 0.8, 2)], "qid int, id string, score double, rank int")
    b = spark.createDataFrame([(1, "y", 5.0, 1), (1, "z", 4.0, 2)], "qid int, id string, score double, rank int")
    fused = search.rrf([(a, 0.5), (b, 0.5)], 10).orderBy("rank").collect()
    assert [r["id"] for r in fused] == ["y", "x", "z"]
    assert [r["id"] for r in search.rrf_outer(a, b, 0.5, 10).orderBy("rank").collect()] == ["y", "x", "z"]
    boosted = search.boost(a, F.when(F.col("id") == "y", 0.2).otherwise(0.0)).orderBy("rank").collect()
    assert [r["id"] for r in boosted] == ["y", "x"]
    many = spark.createDataFrame([(1, f"d{i}", 1.0 - i / 10, i + 1, "f" if i < 4 else "g") for i in range(6)], "qid int, id string, score double, rank int, source string")
    assert [r["id"] for r in search.diversify(many, "source", 2).orderBy("rank").collect()] == ["d0", "d1", "d4", "d5", "d2", "d3"]
    assert [r["id"] for r in search.first_wins(many, "source").orderBy("rank").collect()] == ["d0", "d4"]
    assert search.budget(many, F.lit(10), 35).count() == 3


def test_ir_metrics_of_a_perfect_and_an_empty_run(spark):
    run = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1)], "qid int, id string, rank int")
    relevant = spark.createDataFrame([(1, "a"), (1, "b"), (2, "y"), (3, "q")], "qid int, id string")
    got = {r["qid"]: r for r in search.ir_metrics(run, relevant, 2).collect()}
    assert got[1]["ndcg"] == got[1]["recall"] == got[1]["average_precision"] == got[1]["reciprocal_rank"] == got[1]["precision"] == 1.0
    assert got[2]["ndcg"] == got[3]["recall"] == 0.0


def test_minisql(spark):
    people = spark.createDataFrame([("Alice", 100000, "eng"), ("Bob", 80000, "eng"), ("Charlie", 120000, "sales"), ("Diana", None, None)], "name string, salary int, dept string")
    tables = {"people": people}
    assert rows(minisql.query("SELECT dept, COUNT(*) AS n, SUM(salary) AS s FROM people GROUP BY dept", tables)) == [("eng", 2, 180000.0), ("sales", 1, 120000.0), (None, 1, None)]
    assert [r[0] for r in minisql.query("SELECT name FROM people WHERE salary BETWEEN 80000 AND 100000 AND dept IN ('eng', 'x, y') ORDER BY salary", tables).collect()] == ["Bob", "Alice"]
    assert [r[0] for r in minisql.query("select name from people order by salary limit 1", tables, compat=True).collect()] == ["Charlie"]
    assert rows(minisql.query("SELECT COUNT(*) AS n FROM people WHERE dept != 'eng'", tables)) == [(1,)]
    assert rows(minisql.query("SELECT COUNT(*) AS n FROM people WHERE dept != 'eng'", tables, compat=True)) == [(4,)]
    assert rows(minisql.query("SELECT GROUP_CONCAT(name) AS names, COUNT(*) AS n FROM people WHERE name LIKE '%i%'", tables)) == [("Alice, Charlie, Diana", 3)]
    many = {"people": spark.range(60).select(F.format_string("n%02d", "id").alias("name"))}
    assert minisql.query("SELECT GROUP_CONCAT(name) AS names FROM people", many).first()[0].endswith("n49 (and 10 more)")
    for bad in ("DELETE FROM people", "SELECT a FROM people WHERE a ~ 1", "SELECT a || b FROM people"):
        with pytest.raises(ValueError):
            minisql.parse(bad)


def test_filter_documents(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": 3}, "t": true, "s": "x"}'), (2, '{"a": {"b": 9}}'), (3, None), (4, "{}")], "id int, payload string")
    ids = lambda d: [r["id"] for r in df.where(minisql.filter_document(d)).orderBy("id").collect()]
    assert ids({}) == [1, 2, 3, 4]
    assert ids({"must": [{"key": "a.b", "range": {"gte": 3, "lt": 9}}]}) == [1]
    assert ids({"must": [{"key": "t", "match": {"value": True}}]}) == [1]
    assert ids({"should": [{"key": "s", "match": {"value": "x"}}, {"key": "a.b", "match": {"value": 9}}]}) == [1, 2]
    assert ids({"must_not": [{"key": "a.b", "match": {"value": 3}}]}) == [2, 3, 4]


def test_types(spark):
    df = spark.createDataFrame([("1",), ("2,500.5",), ("2024-01-02",), ("yes",), (" ",), (None,), ("abc",)], "v string")
    assert [r[0] for r in df.select(infer_type(F.col("v"))).collect()] == ["boolean", "number", "date", "boolean", None, None, "string"]
    assert [r[0] for r in df.select(coerce(F.col("v"), "number")).collect()] == [1.0, 2500.5, None, None, None, None, None]
    assert rows(profile(df)) == [("v", 5, 6, "string")]
    assert df.select(normalize(F.lit("  A_b--C d "))).first()[0] == "a b c d"
    assert df.select(tokens(F.lit("Path/to_File: x 'What?!' {ab}"))).first()[0] == ["path", "to", "file", "'what", "ab"]


def test_diff_upsert_and_added_columns(spark):
    a = spark.createDataFrame([("1", "h", None), ("2", "h", "p"), ("3", "x", "p")], "k string, h string, p string")
    b = spark.createDataFrame([("2", "h", "p"), ("3", "y", "p"), ("4", "h", None)], "k string, h string, p string")
    assert rows(ingest.diff(a, b, "k", "h", "p")) == [("1", "new"), ("2", "unchanged"), ("3", "changed"), ("4", "deleted")]
    assert rows(ingest.upsert(b, a, "k")) == [("1", "h", None), ("2", "h", "p"), ("3", "x", "p"), ("4", "h", None)]
    stored = spark.createDataFrame([(1, "x"), (2, "y")], "_row_num int, status string")
    extra = spark.createDataFrame([(1, "", 5)], "_row_num int, Status string, n int")
    out = ingest.add_columns(stored, extra)
    assert out.columns == ["_row_num", "status", "Status_1", "n"] and rows(out) == [(1, "x", None, "5"), (2, "y", None, None)]


def test_row_numbers_without_a_global_window(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), F.col("id").alias("b"))
    got = ingest.number_rows(df, F.col("a"), F.col("b")).orderBy("_row_num").collect()
    assert [r["_row_num"] for r in got] == list(range(1, 1001)) and [(r["a"], r["b"]) for r in got] == sorted((i % 7, i) for i in range(1000))
    assert ingest.number_rows(df.limit(0), F.col("a")).collect() == []


def test_chunkers(spark):
    text = "First paragraph here.\n\nSecond one, longer, with more words. And a sentence.\n\n" + "x" * 50
    pieces = chunking.split_recursively(text, 30)
    assert "".join(pieces).split() == text.split() and max(map(len, pieces)) <= 30
    assert chunking.split_recursively("", 5) == [] and chunking.split_recursively(" \n ", 5) == []
    assert chunking.markdown_sections("---\nt: 1\n---\nintro\n# A\ntext\n```\n# no\n```\n## B\n") == [("", "intro"), ("A", "text\n```\n# no\n```"), ("B", "")]
    assert chunking.python_units("import a\n@d\ndef f():\n  pass\nclass C: pass\n") == ["import a\n", "@d\ndef f():\n  pass\n", "class C: pass\n"]
    assert chunking.python_units("def (") == ["def ("]
    df = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None), (4, "ab")], "id int, t string")
    assert rows(chunking.fixed(df, F.col("id"), F.col("t"), 6, 2)) == [(1, 0, "abcdef"), (1, 1, "efghij"), (4, 0, "ab")]


def test_files_and_text_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2\n3,z,extra\n")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "b.md").write_text("# no")
    (tmp_path / "c.MD").write_text("# yes")
    (tmp_path / "d.bin").write_bytes(b"\0")
    assert rows(files.read_text_table(spark, str(tmp_path / "a.csv"))) == [("1", "x"), ("2", ""), ("3", "z")]
    assert files.read_text_table(spark, str(tmp_path / "a.csv"), ["name", "none"]).columns == ["name"]
    kept, left = files.ingestible(files.scan_files(spark, str(tmp_path)))
    assert sorted(r["suffix"] for r in kept.collect()) == [".csv", ".md"] and rows(left) == [(".bin", 1)]
    assert spark.range(1).select(files.authority(F.lit("x/specs/a.md")), files.authority(F.lit("design/a.md")), files.authority(F.lit("a.md"))).first()[0:3] == ("spec", "design", "document")
    found = spark.range(1).select(files.headings(F.lit("# A\n```\n# no\n```\n### B  \r\ntext"))).first()[0]
    assert [tuple(h) for h in found] == [(1, "A"), (3, "B")]


def test_nearest_parents(spark):
    df = spark.createDataFrame([("f", 0, 1, "a"), ("f", 1, 2, "b"), ("f", 2, 3, "c"), ("f", 3, 2, "d"), ("f", 4, 1, "e"), ("g", 0, 2, "h")], "file string, pos int, level int, id string")
    assert rows(files.nearest_parents(df, "file", "pos", "level", "id")) == [("a", None), ("b", "a"), ("c", "b"), ("d", "a"), ("e", None), ("h", None)]


def test_sql_front_end(spark):
    assert translate("""SELECT CAST("a b" AS NUMERIC), 'x "NUMERIC"' FROM t;""") == "SELECT CAST(`a b` AS DECIMAL(38,10)), 'x \"NUMERIC\"' FROM t"
    t = spark.createDataFrame([("12.5", 1), ("x", 2)], "`a b` string, k int")
    assert float(run_sql(spark, """SELECT max(CAST("a b" AS NUMERIC)) AS m FROM t WHERE k = 1""", {"t": t}).first()[0]) == 12.5


def test_sessions_and_trend(spark):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00", "e"), (1, "2024-01-01 00:10:00", "v"), (1, "2024-01-01 02:00:00", "v")], "k int, t string, m string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    assert [r["n"] for r in decision_log.sessions(df, "ts", "k", "30 minutes").orderBy("start").collect()] == [2, 1]
    assert [(r["n"], r["n_of"]) for r in decision_log.trend(df, "ts", "m", "e", "day").collect()] == [(3, 1)]
