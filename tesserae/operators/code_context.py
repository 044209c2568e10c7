"""Context of code: imports resolved to files, what they bring in, neighbours in a directory, and the staged retrieval
that puts them together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def directory(path: Column) -> Column:
    """The folder of a path, with its slash; empty for none."""
    return F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)


def module_names(files: DataFrame) -> DataFrame:
    """(module, file, path): the dotted and slashed names by which each file can be imported: its path without extension
    and every tail of it; a package file also by the package. Of files with one name the last path wins."""
    bare = F.regexp_replace("path", r"\.[^./]*$", "")
    parts = F.split(F.regexp_replace(bare, r"/__init__$", ""), "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.slice(parts, i, F.size(parts)))
    named = files.where("path is not null").select("file", "path", F.explode(tails).alias("t"))
    both = named.select("file", "path", F.explode(F.array_distinct(F.array(F.array_join("t", "."), F.array_join("t", "/")))).alias("module"))
    return both.groupBy("module").agg(F.max_by("file", F.struct("path", "file")).alias("file"), F.max("path").alias("path"))


def resolve(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges (source, module, target) whose null targets are looked up by module; known targets stay."""
    found = modules.select(F.col("module").alias("__module"), F.col("file").alias("__file"))
    return edges.join(found, F.col("module") == F.col("__module"), "left").select("source", "module", F.coalesce("target", "__file").alias("target"))


def import_summaries(symbols: DataFrame, edges: DataFrame, cap: int = 5) -> DataFrame:
    """(id, place, target_id): for each symbol the first ``cap`` symbols of the files that its file imports, in the order
    of module and line. The order is that of a file, so it is made once for the file and not for each symbol."""
    targets = symbols.select(F.col("file").alias("target"), F.col("id").alias("target_id"), "start_line")
    resolved = edges.where("target is not null").select("source", "module", "target").distinct()
    w = Window.partitionBy("source").orderBy("module", F.col("start_line").asc_nulls_last(), "target_id")
    per_file = resolved.join(targets, "target").withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)
    return symbols.select("id", F.col("file").alias("source")).join(per_file, "source").select("id", "place", "target_id")


def import_block(content: Column) -> Column:
    """The leading import lines of a file as text: the first run of them, over blank lines and comments; null if none."""
    lines = F.split(F.regexp_replace(content, "\r\n?", "\n"), "\n")
    is_import = lambda x: F.trim(x).rlike("^(import|from) ")
    closes = lambda x: ~is_import(x) & (F.trim(x) != "") & ~F.trim(x).startswith("#")
    from_first = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: is_import(s["x"]))
    first = F.get(from_first, 0)["i"]
    rest = F.slice(lines, first + 1, F.size(lines))
    stops = F.filter(F.transform(rest, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: closes(s["x"]))
    until = F.coalesce(F.get(stops, 0)["i"], F.size(rest))
    block = F.filter(F.slice(rest, F.lit(1), until), is_import)
    return F.when(first.isNotNull(), F.array_join(block, "\n"))


def siblings(selected: DataFrame, files: DataFrame, most: int | None = None) -> DataFrame:
    """(file): files in a folder of a selected one that are not selected; a folder with more than ``most`` of them is
    left out whole."""
    chosen = selected.select("file").distinct()
    placed = files.select("file", directory(F.col("path")).alias("dir"))
    dirs = placed.join(chosen, "file", "left_semi").select("dir").distinct()
    new = placed.join(dirs, "dir", "left_semi").join(chosen, "file", "left_anti")
    if most is not None:
        full = new.groupBy("dir").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("dir")
        new = new.join(full, "dir", "left_anti")
    return new.select("file")


#: The score of a file by how it came in.
ORIGIN_SCORES = {"selected": 1.0, "import": 0.95, "facade": 0.93, "hub": 0.92, "foundation": 0.9, "neighbor": 0.8}


def staged_retrieval(selected: DataFrame, edges: DataFrame, files: DataFrame, hub_degree: int = 3, foundation_degree: int = 3, hubs: int = 10) -> DataFrame:
    """(file, origin, score): the selected files, what they import, package files of their folders, the files that import
    most, those imported most, and neighbours; a file counts by the first way it came in. ``edges``: (source, target)
    files."""
    links = edges.where("source is not null and target is not null and source <> target").select("source", "target").distinct()
    chosen = selected.select("file").distinct()
    imported = links.join(chosen, F.col("source") == F.col("file"), "left_semi").select(F.col("target").alias("file")).distinct()
    inner = chosen.unionByName(imported).distinct()
    placed = files.select("file", directory(F.col("path")).alias("dir"), F.regexp_extract("path", r"([^/]*)$", 1).alias("base"))
    dirs = placed.join(inner, "file", "left_semi").select("dir").distinct()
    facades = placed.where("base in ('__init__.py', 'index.ts')").join(dirs, "dir", "left_semi").select("file")
    out = links.groupBy(F.col("source").alias("file")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hub_degree)
    top = out.orderBy(F.col("n").desc(), "file").limit(hubs).select("file")
    base = links.groupBy(F.col("target").alias("file")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > foundation_degree).select("file")
    near = siblings(chosen, files)
    ways = zip(ORIGIN_SCORES, (chosen, imported, facades, top, base, near))
    every = reduce(DataFrame.unionByName, [df.select("file", F.lit(rank).alias("rank"), F.lit(origin).alias("origin"), F.lit(ORIGIN_SCORES[origin]).alias("score")) for rank, (origin, df) in enumerate(ways)])
    return every.groupBy("file").agg(F.min(F.struct("rank", "origin", "score")).alias("s")).select("file", "s.origin", "s.score")


def package_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(package, uses): distinct edges between the top folders of files; files in no folder and a package's own imports
    do not count."""
    package = files.where(F.col("path").contains("/")).select("file", F.split("path", "/")[0].alias("package"))
    a, b = package.select(F.col("file").alias("source"), "package"), package.select(F.col("file").alias("target"), F.col("package").alias("uses"))
    return edges.select("source", "target").join(a, "source").join(b, "target").where("package <> uses").select("package", "uses").distinct()


def line_slice(content: Column, start: Column, end: Column) -> Column:
    """Lines ``start`` to ``end``, from 1, both included; lines beyond the text are left out."""
    lines = F.split(F.regexp_replace(content, "\r\n?", "\n"), "\n")
    first = F.greatest(start, F.lit(1))
    return F.array_join(F.slice(lines, first, F.greatest(end - first + 1, F.lit(0))), "\n")
