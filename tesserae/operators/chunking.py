"""Cutting texts into chunks: fixed windows as expressions, recursive and Markdown-aware ones in Arrow batches."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import strip


def fixed(df: DataFrame, key: Column, text: Column, size: int, overlap: int) -> DataFrame:
    """(key, chunk_index, chunk): windows of ``size`` characters, each ``size - overlap`` further on, trimmed; kept if
    not empty and the first or longer than the overlap; numbered without gaps."""
    step = size - overlap
    rows = df.select(key.alias("key"), text.alias("text")).where("text is not null and text <> ''")
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(step))
    pieces = F.transform(starts, lambda s: strip(F.substring(F.col("text"), s + 1, F.lit(size))))
    numbered = rows.select("key", F.posexplode(pieces).alias("pos", "chunk")).where((F.col("chunk") != "") & ((F.col("pos") == 0) | (F.length("chunk") > overlap)))
    listed = numbered.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk"))).alias("c"))
    return listed.select("key", F.posexplode(F.transform("c", lambda x: x["chunk"])).alias("chunk_index", "chunk"))


def _in_batches(df: DataFrame, key: Column, text: Column, cut: Callable[[str], list[str]]) -> DataFrame:
    rows = df.select(key.alias("key"), text.alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers, chunks = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                for i, c in enumerate(cut(t.as_py())):
                    keys.append(k)
                    numbers.append(i)
                    chunks.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(numbers, pa.int32()), pa.array(chunks, pa.string())], ["key", "chunk_index", "chunk"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, chunk_index int, chunk string")


SEPARATORS = ("\n\n", "\n", ". ", ", ", " ")


def split_recursively(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, joined greedily from parts split at the strongest separator that occurs;
    parts still too long are split at the next one, and at last by length."""
    if len(text) <= size:
        return [text] if text.strip() else []
    if not separators:
        return [text[i : i + size] for i in range(0, len(text), size)]
    mark, rest = separators[0], separators[1:]
    parts = text.split(mark)
    out: list[str] = []
    held = ""
    for i, part in enumerate(parts):
        part = part + mark if i < len(parts) - 1 else part
        if len(held) + len(part) <= size:
            held += part
            continue
        if held.strip():
            out.append(held)
        held = ""
        if len(part) > size:
            out += split_recursively(part, size, rest)
        else:
            held = part
    return [*out, held] if held.strip() else out


def recursive(df: DataFrame, key: Column, text: Column, size: int, overlap: int = 0) -> DataFrame:
    """(key, chunk_index, chunk): recursive splitting; each chunk but the first is led by the end of the one before,
    from the first space of its last ``overlap`` characters on."""

    def cut(t: str) -> list[str]:
        raw = split_recursively(t, size)
        if not overlap:
            return raw
        out = raw[:1]
        for before, piece in zip(raw, raw[1:]):
            tail = before[-overlap:]
            space = tail.find(" ")
            out.append((tail[space + 1 :] if space >= 0 else tail) + piece)
        return out

    return _in_batches(df, key, text, cut)


_FENCE, _HEADING = re.compile(r"^\s*(```|~~~)"), re.compile(r"^(#{1,6})\s+(\S.*)$")


def markdown_sections(text: str) -> list[tuple[str, str]]:
    """(heading, body) of each part of a Markdown text; headings in fenced code are text; front matter is left out."""
    lines = text.splitlines()
    if lines[:1] == ["---"] and "---" in lines[1:]:
        lines = lines[lines.index("---", 1) + 1 :]
    out: list[tuple[str, list[str]]] = [("", [])]
    fenced = False
    for line in lines:
        if _FENCE.match(line):
            fenced = not fenced
        found = None if fenced else _HEADING.match(line)
        if found:
            out.append((found[2].strip(), []))
        else:
            out[-1][1].append(line)
    return [(h, "\n".join(b).strip()) for h, b in out if h or "\n".join(b).strip()]


def markdown(df: DataFrame, key: Column, text: Column, size: int) -> DataFrame:
    """(key, chunk_index, chunk): one chunk a section, headed by its heading; long ones packed by paragraph."""

    def cut(t: str) -> list[str]:
        out = []
        for heading, body in markdown_sections(t):
            for piece in split_recursively(body, size, ("\n\n", "\n", " ")) or [""]:
                out.append(f"{heading}\n{piece}".strip())
        return [c for c in out if c]

    return _in_batches(df, key, text, cut)


def python_units(text: str) -> list[str]:
    """The source of each top-level class and function of a module, led by what precedes them; texts that do not parse
    are one unit."""
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError):
        return [text] if text.strip() else []
    lines = text.splitlines(keepends=True)
    units, head = [], []
    for node in body:
        first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
        source = "".join(lines[first - 1 : node.end_lineno])
        (units if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)) else head).append(source)
    return [*(["".join(head)] if head else []), *units]


def python_code(df: DataFrame, key: Column, text: Column) -> DataFrame:
    return _in_batches(df, key, text, python_units)
