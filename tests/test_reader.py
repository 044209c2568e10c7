from tesserae.operators import reader


def test_read(spark):
    files = spark.createDataFrame([("f", "a/f.py", "one\ntwo\nthree"), ("g", "g.md", None)], "id string, path string, content string")
    symbols = spark.createDataFrame([("s", "f", "fun", 2, 9), ("t", "none", "x", 1, 1)], "id string, file string, name string, start_line int, end_line int")
    sections = spark.createDataFrame([("r", "g", None, "Root", "top", 0), ("c", "g", "r", "Child", None, 2), ("d", "g", "r", None, "d", 1), ("e", "g", "c", "Leaf", "leaf", 3)], "id string, file string, parent string, title string, content string, pos int")
    asked = spark.createDataFrame([(1, 1, "symbol", "s"), (1, 2, "section", "r"), (1, 3, "section", "e"), (1, 4, "file", "f"), (1, 5, "file", "g"), (1, 6, "symbol", "t"), (1, 7, "other", "s"), (2, 1, "section", "c"), (2, 2, "section", "gone")], "qid int, rank int, kind string, id string")
    got = {(r["qid"], r["rank"]): (r["path"], r["location"], r["content"]) for r in reader.read(asked, files, symbols, sections).collect()}
    assert got == {
        (1, 1): ("a/f.py", "fun", "two\nthree"),
        (1, 2): ("g.md", "Root", "top\n\n- \n- Child"),
        (1, 3): ("g.md", "Root > Child > Leaf", "leaf"),
        (1, 4): ("a/f.py", "a/f.py", "one\ntwo\nthree"),
        (1, 5): ("g.md", "g.md", None),
        (2, 1): ("g.md", "Root > Child", "\n\n- Leaf"),
    }
    assert reader.read(asked, files, symbols, sections, 1).count() == 2 and reader.read(asked.limit(0), files, symbols, sections).count() == 0
