"""Files that are not valid syntax of their language, by full parses with tables built from bundled grammars."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm import lexers
from tesserae.llm.lr import Tables, build, first_error

LEXERS = {"json": lexers.lex_json, "toml": lexers.lex_toml, "go": lexers.lex_go, "java": lexers.lex_java, "typescript": lexers.lex_typescript, "python": lexers.lex_python}
#: Languages of which every text is valid.
FREE = ("markdown", "text")


@cache
def tables(language: str) -> Tables:
    return build(files(__package__).joinpath("grammars", f"{language}.ebnf").read_text("utf-8"))


def check(text: str, language: str, table: Tables) -> int | None:
    """The place of the first error that no parse gets over; None if the text is valid."""
    try:
        kinds, places, *more = LEXERS[language](text)
    except lexers.LexError as e:
        return e.place
    known = table.terminals
    tokens = [known.get(k, -9) for k in kinds]
    tokens.append(0)
    places.append(len(text))
    bad = first_error(table, tokens, more[0], known[";"]) if more else first_error(table, tokens)
    return None if bad is None else places[bad]


def check_files(df: DataFrame, key: Column, language: Column, content: Column, *carry: Column) -> DataFrame:
    """(key, language, valid, line, column, carried columns...) for each row.

    line and column, from 1, are those of the first unrecoverable error. ``valid`` is null where there is nothing to
    judge: no content, or a language without a grammar; Markdown and plain text are valid. An empty text is judged by
    its grammar. Repeated rows are kept; other columns are pruned, whatever their names; an empty table gives an empty
    result. The tables, a few hundred kB whatever the data, are built on the driver and broadcast.
    """
    names = sorted(LEXERS)
    shared = df.sparkSession.sparkContext.broadcast({n: tables(n) for n in names})
    rows = df.select(key.alias("key"), language.alias("language"), F.when(language.isin(names), content).alias("__text"), content.isNotNull().alias("__some"), *carry)
    carried = rows.columns[4:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = shared.value
        for batch in batches:
            valid, lines, columns = [], [], []
            for lang, text, some in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                at = check(text, lang, built[lang]) if text is not None else None
                valid.append(at is None if text is not None else True if some and lang in FREE else None)
                lines.append(None if at is None else text.count("\n", 0, at) + 1)
                columns.append(None if at is None else at - text.rfind("\n", 0, at))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(valid, pa.bool_()), pa.array(lines, pa.int32()), pa.array(columns, pa.int32()), *batch.columns[4:]], ["key", "language", "valid", "line", "column", *carried]
            )

    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[4:])
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, language string, valid boolean, line int, column int{kept}")
