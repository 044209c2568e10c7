"""A small SQL dialect over loosely typed tables: text to a plan object, and the plan to DataFrame operations.

The dialect: SELECT list with COUNT, SUM, AVG, MIN, MAX and GROUP_CONCAT, one table, WHERE with AND of comparisons,
BETWEEN, IN and LIKE, GROUP BY, ORDER BY one column, LIMIT. It follows SQL. With ``compat=True`` it keeps the habits of
lenient row stores instead: != is ignored, LIKE compares the text without its wildcards for equality, the default order
is descending, ORDER BY holds only together with LIMIT and without aggregates, and an empty SUM is 0.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_QUERY = re.compile(r"^\s*select\s+(?P<select>.+?)\s+from\s+(?P<table>\w+)(?:\s+where\s+(?P<where>.+?))?(?:\s+group\s+by\s+(?P<group>.+?))?(?:\s+order\s+by\s+(?P<order>.+?))?(?:\s+limit\s+(?P<limit>\d+))?\s*;?\s*$", re.I | re.S)
_AGGREGATE = re.compile(r"^(count|sum|avg|min|max|group_concat)\s*\(\s*(distinct\s+)?(\*|\w+)\s*\)(?:\s+as\s+(\w+))?$", re.I)
_LITERAL = r"'(?:[^']|'')*'|[-+]?\d+(?:\.\d+)?|true|false"
_CONDITION = re.compile(rf"^(\w+)\s*(?:(between)\s+({_LITERAL})\s+and\s+({_LITERAL})|(in)\s*\((.*)\)|(like)\s+({_LITERAL})|(<=|>=|!=|<>|=|<|>)\s*({_LITERAL}))$", re.I | re.S)


@dataclass
class Condition:
    column: str
    operator: str
    values: list


@dataclass
class Plan:
    table: str
    columns: list[str] = field(default_factory=list)
    aggregates: list[tuple[str, bool, str, str]] = field(default_factory=list)
    where: list[Condition] = field(default_factory=list)
    group: list[str] = field(default_factory=list)
    order: tuple[str, bool | None] | None = None
    limit: int | None = None


def split_top(text: str, mark: str) -> list[str]:
    """Parts between marks that stand outside parentheses and quotes; word marks are matched in any case."""
    parts, depth, quoted, held, i = [], 0, False, "", 0
    while i < len(text):
        c = text[i]
        if c == "'":
            quoted = not quoted
        elif not quoted and c in "()":
            depth += 1 if c == "(" else -1
        if not quoted and depth == 0 and text[i : i + len(mark)].lower() == mark:
            parts.append(held.strip())
            held, i = "", i + len(mark)
            continue
        held += c
        i += 1
    return [*parts, held.strip()]


def literal(text: str):
    t = text.strip()
    if t.startswith("'"):
        return t[1:-1].replace("''", "'")
    if t.lower() in ("true", "false"):
        return t.lower() == "true"
    return float(t) if "." in t else int(t)


def parse(text: str) -> Plan:
    m = _QUERY.match(text)
    if not m:
        raise ValueError(f"not a query of the dialect: {text!r}")
    plan = Plan(m["table"])
    for part in split_top(m["select"], ","):
        a = _AGGREGATE.match(part)
        if a:
            name = a[4] or f"{a[1].lower()}_{'all' if a[3] == '*' else a[3]}"
            plan.aggregates.append((a[1].lower(), bool(a[2]), a[3], name))
        elif re.fullmatch(r"\w+|\*", part):
            plan.columns.append(part)
        else:
            raise ValueError(f"not in the dialect: {part!r}")
    held = ""
    for part in split_top(m["where"], " and ") if m["where"] else []:
        part = f"{held} and {part}" if held else part
        if re.search(rf"\bbetween\s+(?:{_LITERAL})$", part, re.I):
            held = part
            continue
        held = ""
        c = _CONDITION.match(part)
        if not c:
            raise ValueError(f"not in the dialect: {part!r}")
        if c[2]:
            plan.where.append(Condition(c[1], "between", [literal(c[3]), literal(c[4])]))
        elif c[5]:
            plan.where.append(Condition(c[1], "in", [literal(x) for x in split_top(c[6], ",")]))
        elif c[7]:
            plan.where.append(Condition(c[1], "like", [literal(c[8])]))
        else:
            plan.where.append(Condition(c[1], "!=" if c[9] == "<>" else c[9], [literal(c[10])]))
    plan.group = [g.strip() for g in m["group"].split(",")] if m["group"] else []
    if m["order"]:
        name, _, way = m["order"].strip().partition(" ")
        plan.order = (name, None if not way.strip() else way.strip().lower() == "desc")
    plan.limit = int(m["limit"]) if m["limit"] else None
    return plan


def predicate(c: Condition, compat: bool) -> Column | None:
    x = F.col(c.column)
    if c.operator == "between":
        return x.between(*c.values)
    if c.operator == "in":
        return x.isin(c.values)
    if c.operator == "like":
        return x == re.sub("[%_]", "", c.values[0]) if compat else x.like(c.values[0])
    if c.operator == "!=":
        return None if compat else x != c.values[0]
    v = F.lit(c.values[0])
    return {"=": x == v, "<": x < v, ">": x > v, "<=": x <= v, ">=": x >= v}[c.operator]


def _aggregate(kind: str, distinct: bool, column: str, compat: bool) -> Column:
    if kind == "count":
        return F.count(F.lit(1)) if column == "*" else F.count_distinct(column) if distinct else F.count(column)
    number = F.col(column).try_cast("double")
    if kind == "sum":
        return F.coalesce(F.sum(number), F.lit(0.0)) if compat else F.sum(number)
    if kind == "avg":
        return F.avg(number)
    if kind in ("min", "max"):
        return (F.min if kind == "min" else F.max)(column)
    raise ValueError(kind)


#: Values that GROUP_CONCAT shows; of those beyond it gives the number.
SHOWN = 50


def _concat(df: DataFrame, group: list[str], column: str, name: str) -> DataFrame:
    """Group columns and ``name``: the first values of each group in order, then how many more there are. Never more
    than ``SHOWN`` values of a group are gathered; the rank limit is applied before the shuffle."""
    keys = [F.col(g).alias(f"__g{i}") for i, g in enumerate(group)] or [F.lit(0).alias("__g0")]
    values = df.select(*keys, F.col(column).cast("string").alias("__v")).where("__v is not null").distinct()
    names = [f"__g{i}" for i in range(len(keys))]
    counts = values.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*names).orderBy("__v")
    first = values.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= SHOWN).groupBy(*names).agg(F.array_join(F.array_sort(F.collect_list("__v")), ", ").alias("__t"))
    same = [counts[n].eqNullSafe(first[n]) for n in names]
    both = counts.join(first, [*same]).select(*(counts[n] for n in names), "__t", "__n")
    return both.select(*names, F.concat("__t", F.when(F.col("__n") > SHOWN, F.concat(F.lit(" (and "), F.col("__n") - SHOWN, F.lit(" more)"))).otherwise("")).alias(name))


def run(plan: Plan, df: DataFrame, compat: bool = False) -> DataFrame:
    for c in plan.where:
        test = predicate(c, compat)
        if test is not None:
            df = df.where(test)
    if plan.aggregates:
        source = df
        columns = [_aggregate(kind, distinct, column, compat).alias(name) for kind, distinct, column, name in plan.aggregates if kind != "group_concat"]
        columns = columns or [F.count(F.lit(1)).alias("__rows")]
        df = df.groupBy(*plan.group).agg(*columns) if plan.group else df.agg(*columns)
        for kind, _, column, name in plan.aggregates:
            if kind == "group_concat":
                lists = _concat(source, plan.group, column, name)
                on = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(plan.group)] or [F.col("__g0") == 0]
                df = df.join(lists, on, "left").drop(*(f"__g{i}" for i in range(max(1, len(plan.group)))))
        keep = [c for c in plan.columns if c in plan.group]
        df = df.select(*keep, *(a[3] for a in plan.aggregates))
    elif plan.columns and "*" not in plan.columns:
        extra = [plan.order[0]] if plan.order and plan.order[0] not in plan.columns else []
        df = df.select(*plan.columns, *extra)
    if plan.order and not (compat and (plan.limit is None or plan.aggregates)):
        name, down = plan.order
        down = compat if down is None else down
        rest = [F.col(c) for c in df.columns if c != name]
        df = df.orderBy(F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_last(), *rest)
    if plan.limit is not None and not (compat and plan.aggregates):
        df = df.limit(plan.limit)
    if not plan.aggregates and plan.columns and "*" not in plan.columns:
        df = df.select(*plan.columns)
    return df


def query(text: str, tables: dict[str, DataFrame], compat: bool = False) -> DataFrame:
    plan = parse(text)
    return run(plan, tables[plan.table], compat)


def filter_document(document: dict, payload: str = "payload") -> Column:
    """A predicate on a JSON column from a filter document: ``must`` (all), ``should`` (any) and ``must_not`` (none) of
    conditions {key, match: {value}} or {key, range: {gt, gte, lt, lte}}; keys are dotted paths; nesting is allowed.
    Values are compared with their type; an empty document lets every row pass."""

    def one(c: dict) -> Column:
        if any(k in c for k in ("must", "should", "must_not")):
            return filter_document(c, payload)
        x = F.get_json_object(payload, "$." + c["key"])
        if "match" in c:
            v = c["match"]["value"]
            return F.coalesce(x == (str(v).lower() if isinstance(v, bool) else v) if isinstance(v, (bool, str)) else x.try_cast("double") == float(v), F.lit(False))
        test = F.lit(True)
        for name, bound in c["range"].items():
            y = x.try_cast("double")
            test = test & {"gt": y > bound, "gte": y >= bound, "lt": y < bound, "lte": y <= bound}[name]
        return F.coalesce(test, F.lit(False))

    out = F.lit(True)
    for c in document.get("must", []):
        out = out & one(c)
    if document.get("should"):
        some = F.lit(False)
        for c in document["should"]:
            some = some | one(c)
        out = out & some
    for c in document.get("must_not", []):
        out = out & ~one(c)
    return out
