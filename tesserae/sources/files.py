"""Files and loosely typed tables as sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The suffixes that are ingested, and those of directories that mark how binding a text is.
SUFFIXES = (".md", ".txt", ".py", ".pdf", ".docx", ".csv", ".tsv")
AUTHORITY = (("spec", r"/(?:spec|specs|requirements|rfc)/|/(?:spec\.|requirement|rfc-)[^/]*$"), ("design", r"/(?:design|designs|architecture|adr)/|/(?:design|architecture)[^/]*$"), ("notes", r"/(?:notes|meeting|meetings|scratch)/|/notes?[^/]*$"))


def scan_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, suffix, size, modified, hash, content) of all files below a folder, hidden parts skipped. Files of no bytes
    are not read by the format and do not appear."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    return files.select("path", F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).alias("suffix"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("hash"), "content").where(~F.col("path").rlike(r"/\.[^/]"))


def ingestible(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files of known suffixes, and (suffix, n) of those left out."""
    known = F.col("suffix").isin(*SUFFIXES)
    return files.where(known), files.where(~known).groupBy("suffix").agg(F.count(F.lit(1)).alias("n"))


def authority(path: Column) -> Column:
    """How binding a document is, by its path; the first match holds."""
    kind = F.lit("document")
    for name, form in reversed(AUTHORITY):
        kind = F.when(F.lower(F.concat(F.lit("/"), path)).rlike(form), name).otherwise(kind)
    return kind


def read_text_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV or TSV file with every column as text; short rows are filled with empty cells. Only ``columns``, if given,
    are parsed; unknown ones are left out."""
    sep = "\t" if path.lower().endswith(".tsv") else ","
    head = spark.read.option("header", True).option("sep", sep).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in head])
    rows = spark.read.schema(schema).option("header", True).option("sep", sep).option("mode", "PERMISSIVE").csv(path)
    keep = [c for c in columns if c in head] if columns is not None else head
    return rows.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in keep))


def sample_values(df: DataFrame, rows: int = 20, values: int = 3) -> DataFrame:
    """(column, values): a few distinct filled values of each column among the first rows, sorted."""
    first = df.limit(rows)
    lists = first.agg(*(F.slice(F.array_sort(F.collect_set(F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")))), 1, values).alias(c) for c in df.columns))
    return lists.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("values")) for c in df.columns))).alias("s")).select("s.column", "s.values")


def headings(text: Column) -> Column:
    """array of (level, title): the # headings of a Markdown text outside fenced code."""
    plain = F.regexp_replace(text, r"(?ms)^[ \t]*```.*?^[ \t]*```[ \t]*$", "")
    lines = F.regexp_extract_all(plain, F.lit(r"(?m)^#{1,6}[ \t]+\S[^\r\n]*"), F.lit(0))
    return F.transform(lines, lambda h: F.struct(F.length(F.regexp_extract(h, r"^(#+)", 1)).alias("level"), F.regexp_replace(F.regexp_replace(h, r"^#+[ \t]+", ""), r"\s+$", "").alias("title")))


def nearest_parents(df: DataFrame, file: str, pos: str, level: str, key: str) -> DataFrame:
    """(key, parent): of each section the nearest earlier one of its file with a smaller level.

    A fold over the positions of one file, whose narrow rows are all that a task holds."""
    import pandas as pd

    rows = df.select(F.col(file).alias("file"), F.col(pos).cast("int").alias("pos"), F.col(level).cast("int").alias("level"), F.col(key).alias("key"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        stack, out = [], []
        for lv, k in pdf.sort_values(["pos", "key"])[["level", "key"]].itertuples(index=False):
            while stack and stack[-1][0] >= lv:
                stack.pop()
            out.append((k, stack[-1][1] if stack else None))
            stack.append((lv, k))
        return pd.DataFrame(out, columns=["key", "parent"])

    return rows.where("pos is not null and level is not null").groupBy("file").applyInPandas(fold, f"key {rows.schema['key'].dataType.simpleString()}, parent {rows.schema['key'].dataType.simpleString()}")


def table_to_markdown(df: DataFrame, order: list[str], rows: int, cell: int = 50) -> DataFrame:
    """(line, text): the first rows of a table as a Markdown table; cells over ``cell`` characters are cut to that, the
    last three being dots."""
    from pyspark.sql import Window

    def show(c: str) -> Column:
        v = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(F.length(v) > cell, F.concat(F.substring(v, 1, cell - 3), F.lit("..."))).otherwise(v)

    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(show, df.columns)), F.lit(" |"))
    body = df.orderBy(*order).limit(rows)
    body = body.select((F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)) + 2).alias("line"), line.alias("text"))
    top = [(1, "| " + " | ".join(df.columns) + " |"), (2, "| " + " | ".join("---" for _ in df.columns) + " |")]
    return df.sparkSession.createDataFrame(top, "line int, text string").unionByName(body)
