"""Reading tables and picking the current row of each id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The column that orders the versions of a row, by table.
VERSION_COLUMN = {
    "raw_files": "updated_at",
    "section_index": "created_at",
    "symbol_index": "created_at",
    "chunks": "created_at",
}

#: The characters that count as whitespace, for a regular expression class.
WHITESPACE = r"\s\u001c-\u001f\u0085   -     　"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def current(df: DataFrame, version: str, key: str = "id") -> DataFrame:
    """The latest row of each ``key``; tied rows are identical, so any of them serves. Rows without a key are dropped.

    The rank limit is applied in each input partition before the shuffle, so a key with many old versions costs one
    row per input partition.
    """
    w = Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last())
    rank = "__version_rank"
    return df.where(F.col(key).isNotNull()).withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)


def current_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """``columns`` of the current rows of a versioned table; only these and the version reach the scan."""
    version = VERSION_COLUMN[name]
    keep = list(dict.fromkeys(["id", *columns]))
    return current(table(spark, sf_dir, name).select(*dict.fromkeys([*keep, version])), version).select(*keep)


def squeeze(c: Column | str) -> Column:
    """Trimmed, lower case, each inner run of whitespace as one space."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.trim(F.regexp_replace(c, f"[{WHITESPACE}]+", " ")))


def bare(c: Column | str) -> Column:
    """Trimmed of any whitespace and in lower case."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_replace(c, f"^[{WHITESPACE}]+|[{WHITESPACE}]+$", ""))
