"""Incremental ingestion: differences, upserts, row numbers, names and fingerprints."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(scanned: DataFrame, known: DataFrame, key: str, *compared: str) -> DataFrame:
    """(key, status): new, changed (any compared column differs, nulls being values), unchanged, or deleted."""
    a = scanned.select(F.col(key).alias("k"), F.struct(*compared).alias("a"), F.lit(True).alias("here"))
    b = known.select(F.col(key).alias("k"), F.struct(*compared).alias("b"), F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull(), "new").when(F.col("here").isNull(), "deleted").when(~F.col("a").eqNullSafe(F.col("b")), "changed").otherwise("unchanged")
    return a.join(b, "k", "full").select(F.col("k").alias(key), status.alias("status"))


def upsert(stored: DataFrame, arrived: DataFrame, *keys: str) -> DataFrame:
    """Stored rows, replaced or joined by those that arrived; an arrived key counts once and wins."""
    fresh = arrived.dropDuplicates([*keys])
    return stored.join(fresh.select(*keys), [*keys], "left_anti").unionByName(fresh.select(*stored.columns))


def safe_column_names(names: list[str]) -> list[str]:
    """Safe names of columns: other characters than ASCII letters and digits as _, c_ before a digit, lower case, col for
    a blank one; repeated ones get _1, _2 and so on."""
    out: list[str] = []
    for name in names:
        base = re.sub(r"[^a-zA-Z0-9]", "_", name).lower() or "col"
        base = f"c_{base}" if base[0].isdigit() else base
        unique, i = base, 0
        while unique in out:
            i += 1
            unique = f"{base}_{i}"
        out.append(unique)
    return out


def add_columns(stored: DataFrame, extra: DataFrame, row: str = "_row_num") -> DataFrame:
    """New columns beside the stored ones, matched by row number; blank cells become null; names already there get a
    suffix."""
    names = {}
    taken = {c.lower() for c in stored.columns}
    for c in extra.columns:
        if c != row:
            name, i = c, 1
            while name.lower() in taken:
                name, i = f"{c}_{i}", i + 1
            taken.add(name.lower())
            names[c] = name
    cells = extra.select(row, *(F.nullif(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in names.items()))
    return stored.join(cells, row, "left")


def number_rows(df: DataFrame, *order: Column, name: str = "_row_num") -> DataFrame:
    """Numbers all rows from 1 in a total order without one task seeing them all: range partitions are numbered each by
    itself and shifted by the sizes of those before, of which there is one number a partition."""
    spark = df.sparkSession
    from tesserae.session import Scratch

    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    local = ranged.withColumn("__n", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    local = Scratch(spark, "rows").put(local, "local")
    sizes = {r["__part"]: r["n"] for r in local.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    shift, done = {}, 0
    for part in sorted(sizes):
        shift[part], done = done, done + sizes[part]
    if not shift:
        return local.withColumn(name, F.lit(0).cast("bigint")).drop("__part", "__n")
    shifts = spark.createDataFrame(list(shift.items()), "__part int, __shift bigint")
    return local.join(F.broadcast(shifts), "__part").withColumn(name, F.col("__n") + F.col("__shift")).drop("__part", "__n", "__shift")


def table_name(c: Column) -> Column:
    """A safe name for a table: other characters than ASCII letters and digits as _, t_ before a digit, at most 55
    characters, lower case, with the prefix tbl_."""
    safe = F.regexp_replace(c, "[^a-zA-Z0-9]", "_")
    safe = F.when(safe.rlike("^[0-9]"), F.concat(F.lit("t_"), safe)).otherwise(safe)
    return F.lower(F.concat(F.lit("tbl_"), F.substring(safe, 1, 55)))


def column_name(c: Column) -> Column:
    safe = F.regexp_replace(c, "[^a-zA-Z0-9]", "_")
    return F.lower(F.when(c == "", "col").when(safe.rlike("^[0-9]"), F.concat(F.lit("c_"), safe)).otherwise(safe))


def chunk_id(*parts: Column) -> Column:
    """sha256 of the parts joined by a bar; a null part is empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def set_fingerprint(ids: Column) -> Column:
    """sha256 of the sorted ids joined by a colon; repeated ids stay."""
    return F.sha2(F.array_join(F.array_sort(ids), ":"), 256)
