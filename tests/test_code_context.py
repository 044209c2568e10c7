import pytest
from pyspark.sql import functions as F

from tesserae.functions.text import matches_globs
from tesserae.operators import code_context as code


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


@pytest.fixture
def files(spark):
    return spark.createDataFrame([("a", "p/x/one.py"), ("b", "p/x/__init__.py"), ("c", "q/two.ts"), ("d", "q/one.py"), ("e", "top.py"), ("f", None)], "file string, path string")


def test_modules_and_resolution(spark, files):
    names = {r["module"]: r["file"] for r in code.module_names(files).collect()}
    assert names["p.x.one"] == names["p/x/one"] == names["x.one"] == "a" and names["x"] == names["p.x"] == "b" and names["one"] == "d" and names["two"] == "c"
    edges = spark.createDataFrame([("c", "x.one", None), ("c", "none", None), ("d", "x.one", "z"), (None, "x", None)], "source string, module string, target string")
    assert rows(code.resolve(edges, code.module_names(files)), "source", "module") == [(None, "x", "b"), ("c", "none", None), ("c", "x.one", "a"), ("d", "x.one", "z")]
    assert code.resolve(edges.limit(0), code.module_names(files.limit(0))).count() == 0


def test_import_summaries_and_packages(spark, files):
    symbols = spark.createDataFrame([("s1", "c", 1), ("s2", "a", 9), ("s3", "a", 2), ("s4", "a", None), ("s5", "b", 1)], "id string, file string, start_line int")
    edges = spark.createDataFrame([("c", "x.one", "a"), ("c", "x", "b"), ("c", "x", "b"), ("c", "no", None), ("a", "top", "e")], "source string, module string, target string")
    assert rows(code.import_summaries(symbols, edges, 3)) == [("s1", 1, "s5"), ("s1", 2, "s3"), ("s1", 3, "s2")]
    assert rows(code.package_edges(edges, files)) == [("q", "p")]


@pytest.mark.parametrize(
    "content, block",
    [
        ("# c\nimport a\n\n# d\nfrom b import c\nx = 1\nimport d\n", "import a\nfrom b import c"),
        ("x = 1\r\nimport a\r\n  import b\r\n", "import a\n  import b"),
        ("x = 1", None),
        ("", None),
        (None, None),
        ("import a", "import a"),
    ],
)
def test_import_block(spark, content, block):
    assert spark.createDataFrame([(content,)], "c string").select(code.import_block(F.col("c"))).first()[0] == block


def test_line_slice(spark):
    df = spark.createDataFrame([("a\nb\r\nc", 2, 9), ("a", 0, 1), ("a", 3, 2), (None, 1, 1)], "c string, a int, b int")
    assert [r[0] for r in df.select(code.line_slice(F.col("c"), F.col("a"), F.col("b"))).collect()] == ["b\nc", "a", "", None]


def test_siblings_and_stages(spark, files):
    chosen = spark.createDataFrame([("a",), ("a",)], "file string")
    assert rows(code.siblings(chosen, files)) == [("b",)] and rows(code.siblings(chosen, files, 0)) == []
    edges = spark.createDataFrame([("a", "c"), ("d", "e"), ("d", "c"), ("e", "c"), ("a", "a"), (None, "a")], "source string, target string")
    got = {r["file"]: (r["origin"], r["score"]) for r in code.staged_retrieval(chosen, edges, files, 1, 2).collect()}
    assert got == {"a": ("selected", 1.0), "c": ("import", 0.95), "b": ("facade", 0.93), "d": ("hub", 0.92)}
    assert code.staged_retrieval(chosen.limit(0), edges.limit(0), files).count() == 0


def test_globs(spark):
    df = spark.createDataFrame([("a/b.py",), ("b.pyc",), ("x/a/c.md",), (None,)], "p string")
    assert [r[0] for r in df.select(matches_globs(F.col("p"), ["*.py", "x/[ab]/?.md"])).collect()] == [True, False, True, False]
