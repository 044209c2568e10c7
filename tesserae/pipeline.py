"""Incremental ingestion of files into written tables: scan, difference, parse, cut, embed, replace, and mark what is gone.

Each step is one batch job over the files that need it. Parsed texts are kept by the hash of the content, so a file that
moved or came back is not parsed again. The state of every file is a row, with the versions of what made its chunks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators import chunking
from tesserae.operators.code_context import directory
from tesserae.operators.ingest import chunk_id
from tesserae.providers import Embedder, embed_texts
from tesserae.store import Store

#: A cutter gives (key, chunk_index, chunk) of (key, text) rows.
Cutter = Callable[[DataFrame], DataFrame]
#: The states of a file, in order, and the priorities of the work queue.
STATES = ("registered", "parsed", "embedded")
ASKED, NEAR, LATER = 1, 2, 4


def default_cutters(size: int = 1500) -> dict[str, Cutter]:
    """Cutters by suffix; any other suffix has the one under the empty name."""
    of = lambda cut, *more: lambda df: cut(df, F.col("key"), F.col("text"), *more)
    return {".md": of(chunking.markdown, size), ".py": of(chunking.python_code), "": of(chunking.recursive, size)}


@dataclass
class Ingest:
    """The job and its tables: state, parsed, chunks. ``parser`` gives the text of (hash, suffix, content) rows as
    (hash, text); versions of parser, cutter and embedder decide, with the content, what is done again."""

    store: Store
    embedder: Embedder
    cutters: dict[str, Cutter] = field(default_factory=default_cutters)
    parser_id: str = "text.v1"
    cutter_id: str = "default.v1"
    embedder_id: str = "hash.v1"
    parse: Callable[[DataFrame], DataFrame] = lambda rows: rows.select("hash", F.decode("content", "utf-8").alias("text"))

    def plan(self, files: DataFrame, force: bool = False) -> DataFrame:
        """(path, suffix, size, hash, status): new, changed (content or versions), unchanged or deleted."""
        versions = F.concat_ws("|", F.lit(self.parser_id), F.lit(self.cutter_id), F.lit(self.embedder_id))
        seen = files.select("path", "suffix", "size", "hash", versions.alias("versions"))
        if not self.store.has("state"):
            return seen.select("path", "suffix", "size", "hash", F.lit("new").alias("status"))
        known = self.store.read("state").where("active").select("path", F.col("hash").alias("old_hash"), F.col("versions").alias("old_versions"), F.lit(True).alias("known"))
        both = seen.withColumn("here", F.lit(True)).join(known, "path", "full")
        same = F.col("hash").eqNullSafe(F.col("old_hash")) & F.col("versions").eqNullSafe(F.col("old_versions")) & F.lit(not force)
        status = F.when(F.col("here").isNull(), "deleted").when(F.col("known").isNull(), "new").when(same, "unchanged").otherwise("changed")
        return both.select("path", "suffix", "size", "hash", status.alias("status"))

    def run(self, files: DataFrame, force: bool = False) -> dict[str, int]:
        """Bring the tables up to ``files`` (path, suffix, size, hash, content); how many files had each status."""
        plan = self.store.write("plan", self.plan(files, force))
        counts = {r["status"]: r["n"] for r in plan.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
        work = plan.where("status in ('new', 'changed')").select("path", "suffix", "size", "hash")
        gone = plan.where("status = 'deleted'").select("path")
        if counts.get("new") or counts.get("changed"):
            self._parse(files, work)
            self._cut(work, gone)
        elif counts.get("deleted"):
            self.store.write("chunks", self.store.read("chunks").join(gone, "path", "left_anti"))
        self._mark(work, gone)
        return counts

    def _parse(self, files: DataFrame, work: DataFrame) -> None:
        """Texts of contents not parsed before, by hash and parser."""
        todo = work.select("hash").distinct()
        if self.store.has("parsed"):
            todo = todo.join(self.store.read("parsed").where(F.col("parser_id") == self.parser_id).select("hash"), "hash", "left_anti")
        rows = files.select("hash", "suffix", "content").join(todo, "hash", "left_semi").dropDuplicates(["hash"])
        self.store.append("parsed", self.parse(rows).select("hash", F.lit(self.parser_id).alias("parser_id"), "text"))

    def _cut(self, work: DataFrame, gone: DataFrame) -> None:
        """Chunks of the files to do, in place of those they had, with vectors."""
        texts = self.store.read("parsed").where(F.col("parser_id") == self.parser_id).select("hash", "text")
        rows = work.join(texts, "hash").select(F.col("path").alias("key"), "suffix", "hash", "text")
        named = [s for s in self.cutters if s]
        parts = [cut(rows.where(F.col("suffix") == s) if s else rows.where(~F.coalesce(F.col("suffix").isin(*named), F.lit(False)))) for s, cut in self.cutters.items()]
        made = parts[0]
        for p in parts[1:]:
            made = made.unionByName(p)
        hashed = made.join(work.select(F.col("path").alias("key"), "hash"), "key")
        ids = chunk_id(F.col("hash"), F.col("chunk_index"), F.lit(self.parser_id), F.lit(self.cutter_id), F.lit(self.embedder_id))
        fresh = hashed.select(F.sha2(F.concat_ws("|", "key", ids), 256).alias("id"), F.col("key").alias("path"), F.col("chunk_index").cast("int").alias("chunk_index"), F.col("chunk").alias("content"))
        vectors = embed_texts(fresh, F.col("id"), F.col("content"), self.embedder).withColumnRenamed("key", "id")
        fresh = fresh.join(vectors, "id")
        if self.store.has("chunks"):
            kept = self.store.read("chunks").join(work.select("path").unionByName(gone), "path", "left_anti")
            fresh = kept.select(*fresh.columns).unionByName(fresh)
        self.store.write("chunks", fresh)

    def _mark(self, work: DataFrame, gone: DataFrame) -> None:
        versions = F.concat_ws("|", F.lit(self.parser_id), F.lit(self.cutter_id), F.lit(self.embedder_id))
        done = work.select("path", "suffix", "size", "hash", versions.alias("versions"), F.lit(STATES[-1]).alias("state"), F.lit(LATER).alias("priority"), F.lit(True).alias("active"))
        if self.store.has("state"):
            state = self.store.read("state")
            lost = state.join(gone, "path", "left_semi").withColumn("active", F.lit(False))
            done = done.unionByName(lost.select(*done.columns))
        self.store.upsert("state", done, "path")


def boost(state: DataFrame, asked: DataFrame) -> DataFrame:
    """State rows with a new priority: files asked for (path) come first, files in their folders next."""
    wanted = asked.select(F.col("path").alias("__path")).distinct()
    folders = wanted.select(directory(F.col("__path")).alias("__dir")).distinct()
    marked = state.join(wanted, F.col("path") == F.col("__path"), "left").join(folders, directory(F.col("path")) == F.col("__dir"), "left")
    new = F.when(F.col("__path").isNotNull(), ASKED).when(F.col("__dir").isNotNull(), F.least(F.col("priority"), F.lit(NEAR))).otherwise(F.col("priority"))
    return marked.select(*(new.alias(c) if c == "priority" else c for c in state.columns))
