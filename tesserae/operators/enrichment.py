"""What a model says about texts, in batches, and what is done with it: entities, keywords, roll-ups, bounded indexes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.providers import Chat
from tesserae.session import Scratch

ENTITIES = "array<struct<name:string,type:string>>"


def enrich(df: DataFrame, key: Column, text: Column, chat: Chat, batch: int = 8, most: int = 500) -> DataFrame:
    """(key, keywords, entities): what ``chat`` gives for each text, asked for ``batch`` texts at a time by their first
    ``most`` characters. A reply that is no JSON list of as many objects leaves its batch empty; null texts have nulls."""
    rows = df.select(key.alias("key"), text.alias("text"))

    def ask(texts: list[str]) -> list[dict]:
        listed = "\n".join(f"[{i}] {t[:most]}" for i, t in enumerate(texts))
        found = re.search(r"\[.*\]", chat.answer([{"role": "user", "content": f"Give a JSON list of objects with keywords and entities for each text.\n{listed}"}]), re.DOTALL)
        try:
            items = json.loads(found[0]) if found else []
        except ValueError:
            items = []
        return items if len(items) == len(texts) and all(isinstance(i, dict) for i in items) else [{}] * len(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            some = [i for i, t in enumerate(texts) if t is not None]
            got: dict[int, dict] = {}
            for a in range(0, len(some), batch):
                part = some[a : a + batch]
                got.update(zip(part, ask([texts[i] for i in part])))
            words = [[str(w) for w in got[i].get("keywords") or [] if isinstance(w, str)] if i in got else None for i in range(len(texts))]
            names = [clean_entities(got[i].get("entities")) if i in got else None for i in range(len(texts))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string())), pa.array(names, pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())])))], ["key", "keywords", "entities"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, keywords array<string>, entities {ENTITIES}")


def clean_entities(value: object) -> list[dict]:
    """The items of a list that have a name; a missing type is unknown. Anything but a list has none."""
    items = value if isinstance(value, list) else []
    return [{"name": str(i["name"]), "type": str(i.get("type") or "unknown")} for i in items if isinstance(i, dict) and i.get("name")]


def parse_entities(reply: Column) -> Column:
    """As ``clean_entities``, of JSON text."""
    items = F.from_json(reply, ENTITIES)
    kept = F.filter(items, lambda e: e["name"].isNotNull() & (e["name"] != ""))
    return F.coalesce(F.transform(kept, lambda e: F.struct(e["name"].alias("name"), F.coalesce(e["type"], F.lit("unknown")).alias("type"))), F.array().cast(ENTITIES))


def first_spellings(keywords: DataFrame, category: str = "auto") -> DataFrame:
    """(id, category, match, occurrences, user_defined) for the vocabulary from (keyword, place) rows: of spellings that
    differ in case only the first by place."""
    rows = keywords.where("keyword is not null and trim(keyword) <> ''").groupBy(F.lower(F.trim("keyword")).alias("k")).agg(F.min_by(F.trim("keyword"), F.struct("place", "keyword")).alias("id"))
    return rows.select("id", F.lit(category).alias("category"), F.array("id").alias("match"), F.lit(1).alias("occurrences"), F.lit(False).alias("user_defined"))


def rollup_items(items: DataFrame, group: str, order: list[str], title: str, text: str, most: int = 10) -> DataFrame:
    """(group, n, outline): the first ``most`` items of each group as lines ``title: text``, which a model then sums up;
    texts are cut at 200 characters, and each line keeps its own title where a text is missing."""
    w = Window.partitionBy(group).orderBy(*order)
    rows = items.withColumn("__r", F.row_number().over(w))
    line = F.concat(F.coalesce(title, F.lit("")), F.lit(": "), F.substring(F.coalesce(text, F.lit("")), 1, 200))
    first = F.array_sort(F.collect_list(F.when(F.col("__r") <= most, F.struct("__r", line.alias("line")))))
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(first, lambda x: x["line"]), "\n").alias("outline"))


def bounded_index(entries: DataFrame, limit: int) -> DataFrame:
    """(path, text, size): an index of (path, text, degree) that fits into ``limit`` characters with two between entries.

    Entries of the least degree lose their ``imports:`` lines first, one by one until the index fits; then their
    ``functions:`` lines; then all text but the path. Each pass is a running sum over degree and path: range partitions
    are summed each by itself, and of each a handful of totals shifts those after it."""
    def without(c: Column, start: str) -> Column:
        return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~x.startswith(start)), "\n")

    head = F.length("path") + F.lit(3)
    size = lambda c: head + F.when(F.trim(c) != "", F.length(c) + 1).otherwise(0) + F.lit(2)
    t = F.coalesce("text", F.lit(""))
    a = without(t, "imports:")
    b = without(a, "functions:")
    rows = entries.select("path", F.coalesce("degree", F.lit(0)).alias("degree"), t.alias("t0"), a.alias("t1"), b.alias("t2"), F.lit("").alias("t3"))
    rows = rows.withColumns({f"s{i}": size(F.col(f"t{i}")).cast("bigint") for i in range(4)})
    placed = _running(rows)
    room = F.lit(limit + 2)
    level = F.when(F.col("z2") - F.col("d3") > room, 3).when(F.col("z1") - F.col("d2") > room, 2).when(F.col("z0") - F.col("d1") > room, 1).otherwise(0)
    text = F.when(level == 3, F.col("t3")).when(level == 2, F.col("t2")).when(level == 1, F.col("t1")).otherwise(F.col("t0"))
    return placed.select("path", text.alias("text"), F.when(level == 3, F.col("s3")).when(level == 2, F.col("s2")).when(level == 1, F.col("s1")).otherwise(F.col("s0")).alias("size"))


def _running(rows: DataFrame) -> DataFrame:
    """``rows`` with the totals z0 to z3 of s0 to s3, and what the passes save on all rows before each (d1 to d3)."""
    work = Scratch(rows.sparkSession, "index")
    ranged = work.put(rows.repartitionByRange("degree", "path").withColumn("__part", F.spark_partition_id()), "entries")
    of_part = {r["__part"]: r for r in ranged.groupBy("__part").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(4))).collect()}
    before, done = [], [0, 0, 0, 0]
    for part in sorted(of_part):
        before.append((part, *(done[i - 1] - done[i] for i in (1, 2, 3))))
        done = [done[i] + of_part[part][f"s{i}"] for i in range(4)]
    shifts = rows.sparkSession.createDataFrame(before, "__part int, b1 bigint, b2 bigint, b3 bigint")
    w = Window.partitionBy("__part").orderBy("degree", "path").rowsBetween(Window.unboundedPreceding, -1)
    saved = {f"d{i}": F.coalesce(F.sum(F.col(f"s{i - 1}") - F.col(f"s{i}")).over(w), F.lit(0)) for i in (1, 2, 3)}
    local = ranged.withColumns(saved).join(shifts, "__part")
    return local.withColumns({f"d{i}": F.col(f"d{i}") + F.col(f"b{i}") for i in (1, 2, 3)} | {f"z{i}": F.lit(done[i]) for i in range(4)})
