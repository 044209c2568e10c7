import pytest
from pyspark.sql import functions as F

from tesserae import providers
from tesserae.operators import evidence


def test_registry_and_fakes():
    assert "hash" in providers.EMBEDDERS.names()
    e = providers.EMBEDDERS.get("hash", dimensions=8)
    a, b, c = e.embed(["same words", "words same", ""])
    assert a == b and c == [0.0] * 8
    with pytest.raises(KeyError):
        providers.CHATS.get("none")
    with pytest.raises(ValueError):
        providers.CHATS.register("scripted", providers.ScriptedChat)
    chat = providers.CHATS.get("scripted", answers=["a", "b"])
    assert [chat.answer([]), chat.answer([])] == ["a", "b"]


def test_embed_and_rerank(spark):
    df = spark.createDataFrame([(1, "red fox"), (2, None), (3, "")], "id int, t string")
    got = {r["key"]: r["vector"] for r in providers.embed_texts(df, F.col("id"), F.col("t"), providers.HashEmbedder(4)).collect()}
    assert got[2] is None and got[3] == [0.0] * 4 and len(got[1]) == 4
    hits = [(1, "red fox", f"d{i}", "red fox" if i == 24 else "red" if i == 20 else "x", i + 1) for i in range(25)] + [(2, "red", "e0", "x", 1), (2, "red", "e1", "red", 2)]
    out = providers.rerank(spark.createDataFrame(hits, "qid int, query string, id string, text string, rank int"), providers.OverlapReranker()).orderBy("qid", "rank").collect()
    assert [r["id"] for r in out if r["qid"] == 1][:3] == ["d24", "d20", "d0"]
    assert [r["id"] for r in out if r["qid"] == 2] == ["e0", "e1"]


def test_evidence_rules(spark):
    queries = spark.createDataFrame([(1, "lantern harvest"), (2, "rotor"), (3, "the and")], "qid int, text string")
    texts = spark.createDataFrame([("a", "a lantern"), ("b", None), ("c", "nothing")], "id string, text string")
    hits = spark.createDataFrame([(1, "a", 0.9, "f"), (1, "b", 0.5, "g"), (2, "c", 0.6, "f")], "qid int, id string, score double, source string")
    rows = {r["qid"]: r for r in evidence.features(hits, texts, queries).collect()}
    assert (rows[1]["n"], rows[1]["n_sources"], rows[1]["overlap"], rows[1]["spread"]) == (2, 2, 0.5, 0.4)
    assert rows[3]["n"] == 0 and rows[3]["high"] is None
    verdicts = {r["qid"]: r["verdict"] for r in evidence.sufficiency(evidence.features(hits, texts, queries)).collect()}
    assert verdicts == {1: "sufficient", 2: "qualified", 3: "abstain"}
    signals = spark.createDataFrame([(1, "disputed", 0.9), (1, "qualified", 0.5), (2, "disputed", 0.6), (2, "qualified", 0.6), (3, "abstain", None), (4, "x", None)], "k int, s string, sim double")
    assert {r["key"]: r["mode"] for r in evidence.govern(signals, "k", F.col("s"), F.col("sim")).collect()} == {1: "disputed", 2: "trustworthy", 3: "abstain", 4: "trustworthy"}
    assert evidence.citation_score("abc", "xabcx") == 1.0 and evidence.citation_score("", "x") == 0.0 and 0 < evidence.citation_score("abcd", "abxcd") < 1


def test_sources_parsers_and_chunkers(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A\nx\n\n# B\ny\n")
    (tmp_path / "b.txt").write_text("z")
    files = providers.SOURCES.get("folder", root=str(tmp_path), glob="*.md").files(spark)
    texts = providers.PARSERS.get("text").parse(files)
    cutter = providers.CHUNKERS.get("function", function="markdown", size=100)
    assert cutter.version == "markdown|size=100"
    assert [r["chunk"] for r in cutter.cut(texts.withColumnRenamed("hash", "key")).orderBy("chunk_index").collect()] == ["A\nx", "B\ny"]


def test_timed_counts_calls_and_failures():
    chat = providers.Timed(providers.ScriptedChat(["a"]))
    assert chat.answer([]) == "a" and chat.answers == []
    with pytest.raises(IndexError):
        chat.answer([])
    assert chat.calls["answer"][0] == 2 and chat.calls["answer"][2] == 1 and chat.calls["answer"][1] >= 0
