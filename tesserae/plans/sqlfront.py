"""Running user SQL written in a PostgreSQL flavour over DataFrames.

Loosely typed user tables hold text, and generated SQL casts it. The shim keeps what such text means there: a bare
NUMERIC is wide instead of an integer, double quotes delimit identifiers, and NULLs sort last ascending and first
descending unless the text says otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_STRING = re.compile(r"('(?:[^']|'')*')")
_NUMERIC = re.compile(r"\b(?:numeric|decimal)\b(?!\s*\()", re.I)
_QUOTED = re.compile(r'"((?:[^"]|"")+)"')


def translate(text: str) -> str:
    """The Spark text of a PostgreSQL-flavoured query; string literals are left alone."""
    parts = _STRING.split(text.strip().rstrip(";"))
    for i in range(0, len(parts), 2):
        part = _NUMERIC.sub("DECIMAL(38,10)", parts[i])
        part = re.sub(r"\btext\b(?=\s*\))", "STRING", part, flags=re.I)
        parts[i] = _QUOTED.sub(lambda m: "`" + m[1].replace('""', '"').replace("`", "``") + "`", part)
    return "".join(parts)


def referenced(text: str, names: list[str]) -> list[str]:
    """Those of ``names`` that the query text mentions."""
    bare = "".join(_STRING.split(text)[::2])
    return [n for n in names if re.search(rf"\b{re.escape(n)}\b", bare, re.I)]


def run_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The query over ``tables``; only the tables it mentions are registered, as views of this call alone."""
    import uuid

    used = referenced(text, list(tables))
    names = {n: f"v_{uuid.uuid4().hex[:12]}" for n in used}
    query = translate(text)
    pieces = _STRING.split(query)
    for n, view in names.items():
        tables[n].createOrReplaceTempView(view)
        for i in range(0, len(pieces), 2):
            pieces[i] = re.sub(rf"((?:\bfrom|\bjoin|,)\s+){re.escape(n)}\b(?:\s+(?:as\s+)?(?!(?:join|left|right|full|inner|cross|on|using|where|group|order|having|limit|union|intersect|except|window|qualify|semi|anti|lateral|tablesample|natural)\b)([a-z_]\w*))?", lambda m: f"{m[1]}{view} AS {m[2] or n}", pieces[i], flags=re.I)
    try:
        return spark.sql("".join(pieces))
    finally:
        for view in names.values():
            spark.catalog.dropTempView(view)
