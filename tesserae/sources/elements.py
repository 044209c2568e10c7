"""Documents as typed elements, tables in texts, and descriptions of tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.sources.files import read_text_table

ELEMENT = "type string, content string, level int, language string"
_HEADING, _FENCE = re.compile(r"^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$"), re.compile(r"^[ \t]*(`{3,}|~{3,})[ \t]*([\w+-]*)")
_ITEM, _QUOTE = re.compile(r"^([ \t]*)(?:[-*+]|\d+\.)[ \t]+(.*)$"), re.compile(r"^[ \t]*>[ \t]?(.*)$")


def markdown(text: str) -> list[tuple[str, str, int | None, str | None]]:
    """(type, content, level, language): heading (level 1 to 6), code_block, list_item (level by two columns of indent),
    quote, table (lines with bars) and text, in order; empty ones are left out. An open fence ends with the text."""
    out: list[tuple[str, str, int | None, str | None]] = []
    held: list[str] = []
    kind = "text"

    def close() -> None:
        content = "\n".join(held).strip()
        if content:
            out.append((kind, content, None, None))
        held.clear()

    lines = iter(text.splitlines())
    for line in lines:
        if fence := _FENCE.match(line):
            close()
            code = []
            for inner in lines:
                end = _FENCE.match(inner)
                if end and end[1].startswith(fence[1]) and not end[2]:
                    break
                code.append(inner)
            if "".join(code).strip():
                out.append(("code_block", "\n".join(code), None, fence[2] or None))
            kind = "text"
            continue
        heading, item, quote = _HEADING.match(line), _ITEM.match(line), _QUOTE.match(line)
        if heading or item:
            close()
            kind = "text"
            if heading and heading[2]:
                out.append(("heading", heading[2], len(heading[1]), None))
            elif item and item[2].strip():
                out.append(("list_item", item[2].strip(), len(item[1].expandtabs(4)) // 2 + 1, None))
            continue
        of = "quote" if quote else "table" if "|" in line and line.strip().startswith("|") else "text"
        if of != kind or not line.strip():
            close()
        kind = of
        if line.strip():
            held.append(quote[1] if quote else line)
    close()
    return out


def elements(df: DataFrame, key: Column, content: Column, is_markdown: Column) -> DataFrame:
    """(key, place, type, content, level, language) of each text: the elements of Markdown, a single trimmed text else.
    Null and blank texts have none; a null ``is_markdown`` is plain text."""
    rows = df.select(key.alias("key"), content.alias("content"), F.coalesce(is_markdown, F.lit(False)).alias("md")).where("content is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for i, (text, md) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                found = markdown(text) if md else [("text", text.strip(), None, None)] if text.strip() else []
                at += [(i, place) for place in range(len(found))]
                out += found
            columns = list(zip(*out)) if out else [[]] * 4
            keys = batch.column(0).take(pa.array([i for i, _ in at], pa.int64()))
            types = [pa.string(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([keys, pa.array([p for _, p in at], pa.int32()), *(pa.array(c, t) for c, t in zip(columns, types))], ["key", "place", "type", "content", "level", "language"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, place int, {ELEMENT}")


def pipe_table(content: Column) -> Column:
    """struct(table_id, headers, rows) of a table of lines with bars; null without headers or rows.

    Blank cells are left out before a row is cut or filled to the headers, so that a blank cell shifts its row; a second
    line of dashes is no row. The id is the first 12 hex digits of the MD5 of the text."""
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    cells = lambda line: F.filter(F.transform(F.split(line, r"\|"), trim), lambda x: x != "")
    lines = F.split(trim(content), r"\r?\n")
    second = F.get(lines, 1)
    rest = F.length(F.regexp_replace(second, r"[|\s:-]", "")) <= 2
    first = F.when(rest & second.contains("-"), 3).otherwise(2)
    headers = cells(F.get(lines, 0))
    n = F.size(headers)
    fit = lambda row: F.slice(F.concat(row, F.array_repeat(F.lit(""), n)), F.lit(1), n)
    body = F.filter(F.transform(F.slice(lines, first, F.greatest(F.size(lines) - first + 1, F.lit(0))), cells), lambda r: F.size(r) > 0)
    rows = F.transform(body, fit)
    made = F.struct(F.substring(F.md5(content.cast("binary")), 1, 12).alias("table_id"), headers.alias("headers"), rows.alias("rows"))
    return F.when((F.size(lines) >= 2) & (n > 0) & (F.size(rows) > 0), made)


def tables_and_rest(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables among elements, parsed, and the other elements; a table that can't be parsed stays an element."""
    parsed = found.withColumn("t", F.when(F.col("type") == "table", pipe_table(F.col("content"))))
    return parsed.where("t is not null").select("key", "place", "t.*"), parsed.where("t is null").drop("t")


def table_text(source: Column, headers: Column, rows: Column, sample: int = 3, most: int = 30) -> Column:
    """A description of a table for search: source, columns, number of rows and the first rows, long cells cut."""
    cut = lambda c: F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)
    shown = F.transform(F.slice(rows, 1, sample), lambda r: F.array_join(F.transform(r, cut), " | "))
    head = F.concat(F.lit("Table from "), source, F.lit("\nColumns: "), F.array_join(headers, ", "), F.lit("\nRow count: "), F.size(rows).cast("string"), F.lit(" rows\nSample data:\n  "))
    return F.concat(head, F.array_join(shown, "\n  "))


def csv_document(spark: SparkSession, path: str, most: int = 100_000) -> tuple[str, DataFrame]:
    """The description of a CSV file as text, and its first ``most`` rows as text columns."""
    rows = read_text_table(spark, path).limit(most)
    return f"Table {path.rsplit('/', 1)[-1]}\nColumns: {', '.join(rows.columns)}", rows


#: Suffixes that are indexed as code or text, folders that are skipped, and files that mark a codebase.
INDEXABLE = ".py .yaml .yml .json .toml .md .rst .js .jsx .ts .tsx .mjs .cjs .go .rs .java .kt .scala .c .h .cpp .hpp .cc .cxx .rb .cs .swift .php .lua .zig .sh .bash .zsh".split()
SKIPPED = "__pycache__ node_modules venv dist build *.egg-info".split()
MARKERS = (
    "pyproject.toml setup.py setup.cfg requirements.txt Pipfile package.json package-lock.json yarn.lock pnpm-lock.yaml Cargo.toml Cargo.lock go.mod go.sum *.sln *.csproj *.fsproj pom.xml build.gradle"
    " build.gradle.kts Gemfile Gemfile.lock composer.json composer.lock"
).split()


def indexable(files: DataFrame, path: str, most: int | None = 2000) -> DataFrame:
    """Files of known suffixes outside skipped and hidden folders, in path order, the first ``most`` if given."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    out = F.exists(folders, lambda p: p.isin(*SKIPPED) | p.startswith("."))
    kept = files.where(F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(*INDEXABLE) & ~out)
    return kept.orderBy(path).limit(most) if most is not None else kept


def content_kinds(files: DataFrame, path: str) -> DataFrame:
    """(root, kind): codebase where a marking file lies in the first folder of a path, else documents."""
    from tesserae.functions.text import matches_globs

    base = F.regexp_extract(path, r"^[^/]*/([^/]*)$", 1)
    marked = F.max(matches_globs(base, MARKERS).cast("int")) == 1
    return files.where(F.col(path).contains("/")).groupBy(F.split(path, "/")[0].alias("root")).agg(F.when(marked, "codebase").otherwise("documents").alias("kind"))


def worth_indexing(kind: Column, unique: Column, is_key: Column) -> Column:
    """Whether a column is worth an index: keys, booleans and dates; numbers neither constant nor nearly unique; texts
    of few values."""
    return F.when(is_key | kind.isin("boolean", "date"), True).when(kind == "number", (unique > 0.01) & (unique < 0.9)).when(kind == "string", unique < 0.3).otherwise(False)


def schema_version(name: str, columns: list[tuple[str, str]], key: str, n: int) -> str:
    """The first 12 hex digits of the SHA-256 of a schema's JSON with sorted names."""
    import hashlib
    import json

    data = {"table": name, "columns": columns, "pk": key, "rows": n}
    return hashlib.sha256(json.dumps(data, sort_keys=True).encode()).hexdigest()[:12]
