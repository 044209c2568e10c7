"""Written tables under one folder: replace, upsert, append, delete, and a registry of what is there.

A write makes a new version of a table beside the old one and counts once Spark has committed it; readers take the
newest committed version, so a job that fails half way changes nothing. The folder is any that all executors share.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.ingest import safe_column_names, upsert


class Store:
    """Tables by name under ``root``. Names are given as they are; ``tesserae.operators.ingest.table_name`` makes safe
    ones."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._path, self._files = spark._jvm.org.apache.hadoop.fs.Path, path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        """Committed versions, oldest first."""
        folder = self._path(f"{self.root}/{name}")
        if not self._files.exists(folder):
            return []
        found = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(v[2:]) for v in found if v.startswith("v=") and self._files.exists(self._path(f"{self.root}/{name}/{v}/_SUCCESS")))

    def names(self) -> list[str]:
        """The tables there are, sorted."""
        if not self._files.exists(self._path(self.root)):
            return []
        return sorted(n for s in self._files.listStatus(self._path(self.root)) if self._versions(n := s.getPath().getName()))

    def has(self, name: str) -> bool:
        return bool(self._versions(name))

    def read(self, name: str) -> DataFrame:
        versions = self._versions(name)
        if not versions:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.root}/{name}/v={versions[-1]}")

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Replace the table; the version before the last is removed."""
        versions = self._versions(name)
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v={(versions[-1] if versions else 0) + 1}")
        for old in versions[:-1]:
            self._files.delete(self._path(f"{self.root}/{name}/v={old}"), True)
        return self.read(name)

    def upsert(self, name: str, arrived: DataFrame, *keys: str) -> DataFrame:
        """Insert or replace by key: of equal keys the arrived row wins."""
        fresh = arrived.dropDuplicates([*keys])
        if not self.has(name):
            return self.write(name, fresh)
        return self.write(name, upsert(self.read(name), fresh, *keys))

    def append(self, name: str, df: DataFrame) -> DataFrame:
        return self.write(name, self.read(name).unionByName(df) if self.has(name) else df)

    def delete(self, name: str, gone: Column) -> int:
        """Delete the rows that meet ``gone`` (null: they stay); how many there were."""
        rows = self.read(name)
        n = rows.where(gone).count()
        if n:
            self.write(name, rows.where(~F.coalesce(gone, F.lit(False))))
        return n

    def drop(self, name: str) -> int:
        """Drop a table; how many rows it had, 0 if there is none."""
        if not self.has(name):
            return 0
        n = self.read(name).count()
        self._files.delete(self._path(f"{self.root}/{name}"), True)
        return n

    # loosely typed tables, with the names their columns had

    def store_table(self, table_id: str, rows: DataFrame, row: str = "_row_num", source_file: str | None = None) -> DataFrame:
        """Replace a table of texts: safe column names, blank cells as null, rows numbered by ``row``, and one registry
        entry with the original names, the number of rows and a hash of the content."""
        columns = [c for c in rows.columns if c != row]
        safe = safe_column_names(columns)
        texts = rows.select(row, *(F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")).alias(s) for c, s in zip(columns, safe)))
        written = self.write(table_id, texts)
        digest = content_hash(rows, columns, row)
        entry = written.agg(F.count(F.lit(1)).alias("row_count")).crossJoin(digest).select(F.lit(table_id).alias("table_id"), F.array(*map(F.lit, safe)).cast("array<string>").alias("columns"), F.array(*map(F.lit, columns)).cast("array<string>").alias("original_columns"), "row_count", F.lit(source_file).cast("string").alias("source_file"), "hash")
        self.upsert("_registry", entry, "table_id")
        return written

    def registry(self) -> DataFrame:
        return self.read("_registry").orderBy("table_id")

    def retrieve(self, table_id: str, row: str = "_row_num") -> DataFrame:
        """The rows of ``store_table`` in order, with the original column names."""
        entry = self.registry().where(F.col("table_id") == table_id).first()
        if entry is None:
            raise KeyError(table_id)
        return self.read(table_id).orderBy(row).select(*(F.col(s).alias(o) for s, o in zip(entry["columns"], entry["original_columns"])))

    def has_columns(self, table_id: str, wanted: list[str]) -> tuple[list[str], list[str]]:
        """The wanted names that the table has, and those it lacks, in the order given."""
        entry = self.registry().where(F.col("table_id") == table_id).first()
        have = set(entry["original_columns"]) if entry else set()
        return [c for c in wanted if c in have], [c for c in wanted if c not in have]

    def delete_table(self, table_id: str) -> bool:
        known = self.has(table_id)
        self.drop(table_id)
        self.delete("_registry", F.col("table_id") == table_id)
        return known


def content_hash(rows: DataFrame, columns: list[str], row: str) -> DataFrame:
    """(hash): the first 16 hex digits of the SHA-256 of header and rows, cells joined by commas and lines ended by line
    feeds, nulls as blanks. Rows are put in order in one task, for the digest is of one text; meant for tables that a
    user uploads."""
    line = F.concat_ws(",", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns))
    lines = rows.agg(F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), line.alias("l")))).alias("s"))
    text = F.concat(F.lit(",".join(columns) + "\n"), F.array_join(F.transform("s", lambda x: F.concat(x["l"], F.lit("\n"))), ""))
    return lines.select(F.substring(F.sha2(text, 256), 1, 16).alias("hash"))


def update_by_position(rows: DataFrame, part: str, order: list[str], values: DataFrame, column: str) -> DataFrame:
    """The i-th row of each part, in order, takes the i-th of the part's ``values`` (part, values array) as ``column``;
    rows beyond them keep what they have."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    given = values.select(F.col(part).alias("__part"), F.posexplode("values").alias("__i", "__value"))
    placed = rows.withColumn("__place", place)
    met = placed.join(given, (F.col(part) == F.col("__part")) & (F.col("__place") == F.col("__i") + 1), "left")
    return met.select(*(F.when(F.col("__part").isNotNull(), F.col("__value")).otherwise(F.col(c)).alias(c) if c == column else c for c in rows.columns))


def cascade(parents: DataFrame, key: str, gone: DataFrame, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Delete parents whose key is in ``gone`` with their rows in every child table (name: rows, foreign key)."""
    names = gone.select(F.col(key).alias("__gone")).distinct()
    left = lambda df, column: df.join(names, F.col(column) == F.col("__gone"), "left_anti")
    return {"parents": left(parents, key), **{n: left(df, fk) for n, (df, fk) in children.items()}}


def merge_keywords(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(id, category, match, occurrences, user_defined): keywords merged by lower-case id. What was found keeps the larger
    number of occurrences and all spellings; stored ones not found again stay only if a user made them."""
    unit = lambda df, user: df.select(F.lower("id").alias("k"), "id", "category", "match", "occurrences", user.alias("user_defined"))
    one = lambda df: df.groupBy("k").agg(F.min(F.struct("id", "category")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("match")))).alias("match"), F.max("occurrences").alias("occurrences"), F.max("user_defined").alias("user_defined"))
    a = one(unit(stored, F.coalesce(F.col("user_defined"), F.lit(False)))).alias("a")
    b = one(unit(found, F.lit(False))).alias("b")
    both = a.join(b, F.col("a.k") == F.col("b.k"), "full").where(F.col("b.k").isNotNull() | F.col("a.user_defined"))
    empty = F.array().cast("array<string>")
    match = F.array_sort(F.array_union(F.coalesce("a.match", empty), F.coalesce("b.match", empty)))
    named = F.coalesce("a.s", "b.s")
    return both.select(named["id"].alias("id"), named["category"].alias("category"), match.alias("match"), F.greatest("a.occurrences", "b.occurrences").alias("occurrences"), F.coalesce("a.user_defined", F.lit(False)).alias("user_defined"))


def add_keywords(stored: DataFrame, added: DataFrame) -> DataFrame:
    """Keywords of a user beside the stored ones; an id already there, case aside, is not added."""
    new = added.withColumn("user_defined", F.lit(True)).select(*stored.columns)
    known = stored.select(F.lower("id").alias("__k")).distinct()
    return stored.unionByName(new.join(known, F.lower("id") == F.col("__k"), "left_anti"))


def add_spelling(stored: DataFrame, keyword: str, spelling: str) -> DataFrame:
    match = F.when(F.lower("id") == keyword.lower(), F.array_union("match", F.array(F.lit(spelling)))).otherwise(F.col("match"))
    return stored.withColumn("match", match)


def remove_keyword(stored: DataFrame, keyword: str) -> DataFrame:
    return stored.where(F.lower("id") != keyword.lower())


def derived_rows(sentences: DataFrame, source: Column, sentence: Column, version: Column) -> DataFrame:
    """(id, source, sentence, version): derived sentences named by the first 16 hex digits of the SHA-256 of
    ``source:sentence``."""
    rows = sentences.select(source.alias("source"), sentence.alias("sentence"), version.alias("version"))
    return rows.select(F.substring(F.sha2(F.concat_ws(":", "source", "sentence"), 256), 1, 16).alias("id"), "source", "sentence", "version")


def without_stale(derived: DataFrame, current: DataFrame) -> DataFrame:
    """Derived rows whose version is the current one of their source (null is a value); other sources' rows stay.
    ``current``: (source, version)."""
    now = current.select(F.col("source").alias("__source"), F.col("version").alias("__version"))
    met = derived.join(now, F.col("source") == F.col("__source"), "left")
    return met.where(F.col("__source").isNull() | F.col("version").eqNullSafe(F.col("__version"))).select(*derived.columns)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
