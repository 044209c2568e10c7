"""Interfaces of external models, a registry, and deterministic stand-ins that keep the data path testable."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class Chat(Protocol):
    def answer(self, messages: list[dict[str, str]]) -> str: ...


class HashEmbedder:
    """Unit vectors from hashed words: equal texts are equal, texts that share words are near."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for i, text in enumerate(texts):
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[i, h % self.dimensions] += 1 if h >> 63 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms > 0, norms, 1)).tolist()


class OverlapReranker:
    """The share of the query's words that a text has."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        wanted = set(re.findall(r"\w+", query.lower()))
        return [len(wanted & set(re.findall(r"\w+", t.lower()))) / len(wanted) if wanted else 0.0 for t in texts]


class ScriptedChat:
    """Gives its answers in turn."""

    def __init__(self, answers: list[str]) -> None:
        self.answers = list(answers)

    def answer(self, messages: list[dict[str, str]]) -> str:
        return self.answers.pop(0)


class Registry:
    """Named providers of one kind."""

    def __init__(self) -> None:
        self._made: dict[str, type] = {}

    def register(self, name: str, maker: type) -> None:
        if name in self._made:
            raise ValueError(f"{name} is taken")
        self._made[name] = maker

    def get(self, name: str, **settings):
        if name not in self._made:
            raise KeyError(f"no provider {name}; there are {sorted(self._made)}")
        return self._made[name](**settings)

    def names(self) -> list[str]:
        return sorted(self._made)


EMBEDDERS, RERANKERS, CHATS = Registry(), Registry(), Registry()
EMBEDDERS.register("hash", HashEmbedder)
RERANKERS.register("overlap", OverlapReranker)
CHATS.register("scripted", ScriptedChat)


def embed_texts(df: DataFrame, key: Column, text: Column, embedder: Embedder) -> DataFrame:
    """(key, vector) in Arrow batches; a null text has a null vector."""
    rows = df.select(key.alias("key"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            made = iter(embedder.embed([t for t in texts if t is not None]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if t is None else next(made) for t in texts], pa.list_(pa.float32()))], ["key", "vector"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, vector array<float>")


def rerank(hits: DataFrame, reranker: Reranker, least: int = 20) -> DataFrame:
    """``hits`` (qid, query, id, text, rank) in the reranker's order for queries with at least ``least`` hits; others
    keep theirs. ``score`` is the reranker's, null where it was not asked."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    sized = hits.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("qid")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.to_pydict()
            scores: list[float | None] = [None] * len(batch)
            for query in dict.fromkeys(q for q, n in zip(data["query"], data["n"]) if n >= least):
                at = [i for i, (q, n) in enumerate(zip(data["query"], data["n"])) if q == query and n >= least]
                for i, s in zip(at, reranker.score(query, [data["text"][i] or "" for i in at])):
                    scores[i] = float(s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.schema.fields)
    scored = sized.mapInArrow(run, f"{fields}, score double")
    w = Window.partitionBy("qid").orderBy(F.col("score").desc_nulls_last(), F.col("rank"))
    return scored.withColumn("rank", F.row_number().over(w)).drop("n")


class Source(Protocol):
    """Finds files: rows of (path, suffix, size, hash, content)."""

    def files(self, spark) -> DataFrame: ...


class Parser(Protocol):
    """Texts of contents: (hash, text) of rows (hash, suffix, content)."""

    version: str

    def parse(self, rows: DataFrame) -> DataFrame: ...


class Chunker(Protocol):
    """Pieces of texts: (key, chunk_index, chunk) of rows (key, text)."""

    version: str

    def cut(self, rows: DataFrame) -> DataFrame: ...


class Constraint(Protocol):
    """What a rule says about evidence: (qid, signal, reason) of queries (qid, text) and their texts (qid, id, text)."""

    def apply(self, queries: DataFrame, texts: DataFrame) -> DataFrame: ...


class Enricher(Protocol):
    """Further columns of rows (key, text), by key."""

    def enrich(self, rows: DataFrame) -> DataFrame: ...


class Detector(Protocol):
    """What a question asks for: (qid, kind, detected) of queries (qid, text)."""

    def detect(self, queries: DataFrame) -> DataFrame: ...


SOURCES, PARSERS, CHUNKERS, CONSTRAINTS, ENRICHERS, DETECTORS = (Registry() for _ in range(6))


class FolderSource:
    """The files below a folder."""

    def __init__(self, root: str, glob: str | None = None) -> None:
        self.root, self.glob = root, glob

    def files(self, spark) -> DataFrame:
        from tesserae.sources.files import scan_files

        return scan_files(spark, self.root, self.glob)


class TextParser:
    """Contents as UTF-8 text."""

    version = "text.v1"

    def parse(self, rows: DataFrame) -> DataFrame:
        from pyspark.sql import functions as F

        return rows.select("hash", F.decode("content", "utf-8").alias("text"))


class FunctionChunker:
    """One of the functions of ``tesserae.operators.chunking``."""

    def __init__(self, function: str, **settings) -> None:
        self.function, self.settings = function, settings
        self.version = "|".join([function, *(f"{k}={v}" for k, v in sorted(settings.items()))])

    def cut(self, rows: DataFrame) -> DataFrame:
        from pyspark.sql import functions as F

        from tesserae.operators import chunking

        return getattr(chunking, self.function)(rows, F.col("key"), F.col("text"), **self.settings)


SOURCES.register("folder", FolderSource)
PARSERS.register("text", TextParser)
CHUNKERS.register("function", FunctionChunker)


class Timed:
    """Any provider with its public calls counted and timed: ``calls`` maps a name to (number, seconds, failures)."""

    def __init__(self, inner: object) -> None:
        self.inner, self.calls = inner, {}

    def __getattr__(self, name: str):
        value = getattr(self.inner, name)
        if name.startswith("_") or not callable(value):
            return value

        def call(*args, **kwargs):
            import time

            start, failed = time.perf_counter(), 1
            try:
                out = value(*args, **kwargs)
                failed = 0
                return out
            finally:
                n, seconds, failures = self.calls.get(name, (0, 0.0, 0))
                self.calls[name] = (n + 1, seconds + time.perf_counter() - start, failures + failed)

        return call
