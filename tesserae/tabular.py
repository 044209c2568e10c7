"""Questions about tables: a model picks columns and writes SQL, Spark runs it. The model is any ``Chat``."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from tesserae.plans.sqlfront import referenced, run_sql
from tesserae.providers import Chat
from tesserae.sources.files import read_text_table

_FENCED = re.compile(r"```(?:\w+)?\s*(.*?)```", re.DOTALL)
_SELECT = re.compile(r"\b(?:select|with)\b.*", re.DOTALL | re.IGNORECASE)


def extract_sql(reply: str) -> str:
    """The query in a model's reply: what is fenced, from the first SELECT or WITH on; the reply itself if there is none."""
    fenced = _FENCED.search(reply)
    text = (fenced[1] if fenced else reply.replace("```sql", "").replace("```", "")).strip()
    found = _SELECT.search(text)
    return (found[0] if found else text).strip().rstrip(";").strip()


def extract_list(reply: str, allowed: list[str]) -> list[str]:
    """The names of a JSON list in a model's reply that are allowed, case aside, in their order; else those that the
    reply mentions."""
    names = {a.lower(): a for a in allowed}
    found = re.search(r"\[.*?\]", reply, re.DOTALL)
    try:
        items = json.loads(found[0]) if found else []
    except ValueError:
        items = []
    picked = [names[str(i).lower()] for i in items if str(i).lower() in names]
    return list(dict.fromkeys(picked)) or referenced(reply, allowed)


def missing_columns(sql: str, have: list[str], headers: list[str]) -> list[str]:
    """Headers that a query mentions, quoted or not, and that the table lacks."""
    held = {h.lower() for h in have}
    return [h for h in headers if h.lower() not in held and re.search(rf"(?<![\w]){re.escape(h)}(?![\w])", sql, re.IGNORECASE)]


@dataclass
class Answer:
    """The query that ran and its rows; ``error`` says why there are none."""

    sql: str
    rows: DataFrame | None
    error: str | None = None


def _prompt(question: str, tables: dict[str, DataFrame], error: str | None = None) -> list[dict[str, str]]:
    lines = [f"{name}({', '.join(df.columns)})" for name, df in tables.items()]
    last = f"\nThe last query failed: {error}" if error else ""
    return [{"role": "user", "content": f"Write one SQL query.\nTables:\n" + "\n".join(lines) + f"\nQuestion: {question}{last}"}]


def generate(spark: SparkSession, chat: Chat, question: str, tables: dict[str, DataFrame], tries: int = 3) -> Answer:
    """A query that Spark accepts, in at most ``tries`` replies; a query is analysed, not run, to see whether it holds."""
    error, sql = None, ""
    for _ in range(tries):
        sql = extract_sql(chat.answer(_prompt(question, tables, error)))
        try:
            return Answer(sql, run_sql(spark, sql, tables))
        except (AnalysisException, ParseException) as e:
            error = str(e).split("\n")[0]
    return Answer(sql, None, error)


def ask(spark: SparkSession, chat: Chat, question: str, tables: dict[str, DataFrame]) -> Answer:
    """A question over one or several tables; if no query over all of them holds, the first table alone is tried."""
    found = generate(spark, chat, question, tables)
    if found.rows is None and len(tables) > 1:
        first = next(iter(tables))
        return generate(spark, chat, question, {first: tables[first]}, 1)
    return found


def ask_file(spark: SparkSession, chat: Chat, path: str, question: str, name: str = "data") -> Answer:
    """A question about a CSV or TSV file. The model first picks the columns, and only those are read; columns that its
    query mentions beside them are added once."""
    headers = read_text_table(spark, path).columns
    picked = extract_list(chat.answer([{"role": "user", "content": f"Columns: {json.dumps(headers)}\nQuestion: {question}\nGive a JSON list of the columns needed."}]), headers) or headers
    tables = {name: read_text_table(spark, path, picked)}
    sql = extract_sql(chat.answer(_prompt(question, tables)))
    for _ in range(2):
        try:
            return Answer(sql, run_sql(spark, sql, tables))
        except (AnalysisException, ParseException) as e:
            error = str(e).split("\n")[0]
            more = missing_columns(sql, picked, headers)
            if not more:
                break
            picked = [h for h in headers if h in {*picked, *more}]
            tables = {name: read_text_table(spark, path, picked)}
    return Answer(sql, None, error)


def sentence(question: str, rows: DataFrame, most: int = 5) -> str:
    """A plain answer without a model: the value of a single cell, else the first rows."""
    held = rows.limit(most + 1).collect()
    if not held:
        return f"No results for: {question}"
    if len(held) == 1 and len(rows.columns) == 1:
        return f"{rows.columns[0]}: {held[0][0]}"
    lines = ["; ".join(f"{c}: {v}" for c, v in zip(rows.columns, r)) for r in held[:most]]
    return "\n".join(lines + (["..."] if len(held) > most else []))
