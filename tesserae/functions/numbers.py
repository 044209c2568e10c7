"""Numbers, units and years in texts, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The units that make a number a mention.
UNITS = ("percent", "units", "items", "requests", "credits", "hours", "minutes", "seconds", "days", "pages", "tonnes", "litres")

_NUM = r"(\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+(?:\.\d+)?)"
#: Fixed values: (pattern of value and unit, kind of unit), and after them the plain words of UNITS, percent being in the first.
_FORMS = tuple(
    (re.compile(form, re.IGNORECASE), kind)
    for form, kind in (
        (rf"{_NUM}\s*(%|percent|percentage)", "%"),
        (rf"{_NUM}\s*(GB|MB|KB|TB)", "bytes"),
        (rf"{_NUM}\s*(m/s|km/h|mph|ft/s)", "measurement"),
        (rf"{_NUM}\s*(million|mil)\b", "million"),
        (rf"{_NUM}\s*(billion|bil)\b", "billion"),
        (rf"{_NUM}\s*(thousand)\b", "thousand"),
        (rf"{_NUM}\s+(M)\b", "million"),
        (rf"{_NUM}\s+(B)\b", "billion"),
        (rf"{_NUM}\s+(K)\b", "thousand"),
        (rf"\$\s*{_NUM}\s*(million|bil|billion|M|B|K|thousand)?", "currency"),
        (rf"{_NUM}\s*(USD|EUR|dollars?|euros?)", "currency"),
        (rf"{_NUM}\s*(meters?|km|miles?|kg|lbs?|°[CF]|degrees?)", "measurement"),
        (rf"{_NUM}\s*({'|'.join(UNITS[1:])})", "word"),
    )
)
#: The first two characters of the units of each form: a text in which none follows a number has no such mention.
_BEGIN = tuple(
    frozenset(x.split())
    for x in ("% pe", "gb mb kb tb", "m/ km mp ft", "mi", "bi", "th", "m m/", "b b/", "k k/", "", "us eu do", "me km mi kg lb de °", " ".join(u[:2] for u in UNITS[1:]))
)
_FOLLOWS = re.compile(r"\d\s*(%|°|[a-z][a-z/]?)")
#: Characters that match an ASCII letter when case is ignored.
_ALIKE = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}
#: Names of measurements by the lower-case unit without its last s; others are "measurement".
_MEASURES = {"meter": "meters", "m/": "meters", "km/h": "speed", "mph": "speed", "km": "km", "mile": "miles", "kg": "kg", "lb": "lbs", "°c": "°c", "°f": "°f", "degree": "degree"}
_UP = re.compile(r"\b(increased?|rises?|rising|grew|grown|growth|gains?|gained|up|higher|more|improved?|boost|jumped?|surged?|climbed?|expanded?)\b")
_DOWN = re.compile(r"\b(decreased?|declines?|declining|drops?|dropped|fell|fallen|fall|down|lower|less|reduced?|reduction|lost|losses?|shrunk|contracted?|slipped?)\b")
#: Characters before and after a mention in which its direction is looked for.
_AROUND = 50


def _unit(raw: str | None, kind: str) -> str:
    if kind == "measurement":
        return _MEASURES.get(raw.lower().rstrip("s"), kind)
    return raw.lower() if kind == "word" else kind


def _mentions(text: str | None) -> list[tuple] | None:
    if text is None:
        return None
    out = []
    follow = set(_FOLLOWS.findall((text if text.isascii() else text.translate(_ALIKE)).lower()))
    for (form, kind), begin in zip(_FORMS, _BEGIN):
        if not (begin & follow if begin else "$" in text):
            continue
        for m in form.finditer(text):
            near = text[max(0, m.start() - _AROUND) : m.end() + _AROUND].lower()
            direction = "increase" if _UP.search(near) else "decrease" if _DOWN.search(near) else None
            out.append((float(m[1].replace(",", "")), _unit(m[2], kind), direction, m.start(), m.end()))
    return out


def mentions(c: Column) -> Column:
    """array of (value, unit, direction, start, stop): numbers with thousands groups before a unit or behind a $.

    direction is increase, decrease or null by the words around; start and stop count characters from 0. Multipliers
    are units of their own: the value of "$2 million" is 2.
    """
    kind = "array<struct<value: double, unit: string, direction: string, start: int, stop: int>>"
    return F.udf(_mentions, kind, useArrow=True)(c)


def years(c: Column) -> Column:
    """The distinct years 1900 to 2099 that stand as digits of their own, in order."""
    runs = F.filter(F.split(c, "[^0-9]+"), lambda x: x.rlike("^(?:19|20)[0-9][0-9]$"))
    return F.array_sort(F.array_distinct(runs))


def significant(c: Column) -> Column:
    """The numbers of a text without signs of currency, thousands and percent, those below 2 and years left out."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0)), lambda m: F.regexp_replace(m, ",", "").try_cast("double"))
    return F.filter(found, lambda x: (x >= 2) & ~((x >= 1900) & (x <= 2099) & (x == F.floor(x))))
