"""The content behind search results: lines of symbols, sections with the titles around them, whole files, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.code_context import line_slice
from tesserae.operators.graph import ancestors_path


def read(addresses: DataFrame, files: DataFrame, symbols: DataFrame, sections: DataFrame, per_query: int = 10, children: int = 10) -> DataFrame:
    """(qid, rank, kind, id, path, location, content) of ``addresses`` (qid, rank, kind, id), the first ``per_query`` of
    each query by rank.

    kind is symbol (the lines of its file), section (titles from the root as location, the titles of up to ``children``
    children below the content) or file; other kinds and ids that are not there have no row. ``files``: (id, path,
    content); ``symbols``: (id, file, name, start_line, end_line); ``sections``: (id, file, parent, title, content, pos).
    Only what is asked for is joined, each kind by its id.
    """
    w = Window.partitionBy("qid").orderBy("rank", "kind", "id")
    wanted = addresses.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= per_query).select("qid", "rank", "kind", "id")
    of = lambda kind: wanted.where(F.col("kind") == kind)
    names = files.select(F.col("id").alias("file"), "path")
    texts = files.select(F.col("id").alias("file"), "path", F.col("content").alias("text"))

    lines = line_slice(F.col("text"), F.col("start_line"), F.col("end_line"))
    code = of("symbol").join(symbols, "id").join(texts, "file").select("qid", "rank", "kind", "id", "path", F.col("name").alias("location"), lines.alias("content"))

    place = F.row_number().over(Window.partitionBy("parent").orderBy(F.col("pos").asc_nulls_last(), "id"))
    below = sections.where("parent is not null").select("parent", F.coalesce("title", F.lit("")).alias("t"), place.alias("n")).where(F.col("n") <= children)
    titles = below.groupBy("parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: F.concat(F.lit("- "), x["t"])).alias("below"))
    path = ancestors_path(sections.select("id", "parent", "title"), "title", 5).select("id", F.col("path").alias("location"))
    asked = of("section").join(sections.select("id", "file", F.col("content").alias("text")), "id").join(path, "id").join(titles, F.col("id") == F.col("parent"), "left").join(names, "file", "left")
    listed = F.when(F.col("below").isNotNull(), F.concat(F.lit("\n\n"), F.array_join("below", "\n"))).otherwise("")
    parts = asked.select("qid", "rank", "kind", "id", "path", "location", F.concat(F.coalesce("text", F.lit("")), listed).alias("content"))

    whole = of("file").join(texts, F.col("id") == F.col("file")).select("qid", "rank", "kind", "id", "path", F.col("path").alias("location"), F.col("text").alias("content"))
    return code.unionByName(parts).unionByName(whole)
