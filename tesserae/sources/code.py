"""Symbols, imports and configuration keys of source files, without any model."""

from __future__ import annotations

import ast
import bisect
import json
import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

Symbol = tuple[str, str, str, int, int]
_NAME = r"([A-Za-z_$][\w$]*)"
_MODS = r"(?:(?:public|protected|private|static|final|abstract|sealed|non-sealed|synchronized|native|default|strictfp|export|declare|async|override|readonly)\s+)*"
#: Forms of declarations on text without comments and strings, by language: (kind, pattern whose last group is the name).
#: ``method`` forms count directly inside a type only.
FORMS = {
    "typescript": (
        ("class", rf"^[ \t]*{_MODS}class\s+{_NAME}"), ("interface", rf"^[ \t]*{_MODS}interface\s+{_NAME}"), ("enum", rf"^[ \t]*{_MODS}(?:const\s+)?enum\s+{_NAME}"), ("type", rf"^[ \t]*{_MODS}type\s+{_NAME}\s*[=<]"),
        ("function", rf"^[ \t]*{_MODS}function\s*\*?\s*{_NAME}"), ("function", rf"^[ \t]*{_MODS}(?:const|let|var)\s+{_NAME}\s*(?::[^=\n]*)?=\s*(?:async\s*)?(?:function\b|(?:<[^>\n]*>\s*)?\([^()]*\)\s*(?::[^=\n]*)?=>|[\w$]+\s*=>)"),
        ("constant", rf"^{_MODS}const\s+{_NAME}"), ("method", rf"^[ \t]*{_MODS}(?:(?:get|set)\s+)?(?:\*[ \t]*)?(?!(?:if|for|while|switch|catch|return|function|new|throw|await|else|do)\b)#?{_NAME}\s*(?:<[^>\n]*>)?\("),
    ),
    "java": (
        ("class", rf"^[ \t]*{_MODS}(?:class|record)\s+{_NAME}"), ("interface", rf"^[ \t]*{_MODS}@?interface\s+{_NAME}"), ("enum", rf"^[ \t]*{_MODS}enum\s+{_NAME}"),
        ("method", rf"(?:^|(?<=[{{{{;}}}}]))[ \t]*{_MODS}(?:<[^>\n]*>\s*)?(?!(?:new|return|throw|else|if|for|while|switch|case|assert|yield)\b)(?:[\w$.]+(?:<[^;{{}}()]*>)?(?:\[\])*\s+)?(?!(?:if|for|while|switch|catch|synchronized|new|return|throw|super|this|else|do|try)\b){_NAME}\s*\("),
    ),
    "go": (
        ("function", rf"^func\s+{_NAME}"), ("method", rf"^func\s*\(\s*(?:\w+\s+)?\*?\s*(\w+)[^)]*\)\s*{_NAME}"), ("interface", rf"^[ \t]*(?:type\s+)?{_NAME}(?:\[[^\]\n]*\])?\s+interface\b"), ("class", rf"^[ \t]*(?:type\s+)?{_NAME}(?:\[[^\]\n]*\])?\s+struct\b"),
        ("type", rf"^type\s+{_NAME}"), ("constant", rf"^const\s+{_NAME}"), ("variable", rf"^var\s+{_NAME}"),
    ),
}
_TYPES = ("class", "interface", "enum")
_COMPILED = {language: [(kind, re.compile(form, re.MULTILINE)) for kind, form in forms] for language, forms in FORMS.items()}
_HIDDEN = re.compile(r"""//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"\"\"[\s\S]*?\"\"\"|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`""")
#: Types, functions and imports of any other language, by the forms that many share.
GENERIC_TYPES = re.compile(r"\b(?:class|struct|interface|trait|enum|type)\s+(\w+)")
GENERIC_FUNCTIONS = re.compile(r"(?m)^[ \t]*(?:(?:pub|export|async|static|inline|public|private|protected|override|virtual|suspend)\s+)*(?:fn|fun|func|function|def|sub)\s+(\w+)\s*[(<]|^[ \t]*(?:[\w:*&<>]+[ \t]+)+\*?(\w+)[ \t]*\([^;{}]*\)\s*\{")
GENERIC_IMPORTS = re.compile(r"""(?m)^[ \t]*(?:(?:import|use|using|require|from|#include)\b[^\n"'<]*["'<]([^"'>\n]+)["'>]|(?:import|use|using|from)\s+([\w.:]+))""")
_NOT_NAMES = frozenset("if for while switch return main else catch".split())
IMPORTS = {
    "typescript": re.compile(r"""(?m)^\s*(?:import|export)\b[^'"\n]*?['"]([^'"]+)['"]"""),
    "java": re.compile(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;"),
    "go": re.compile(r'(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"\n]+)"\s*$'),
}


def python_symbols(text: str) -> list[Symbol]:
    """(name, qualified name, kind, first line, last line) of classes, functions, methods and upper-case constants."""
    tree = ast.parse(text)
    out: list[Symbol] = []

    def visit(body: list[ast.stmt], prefix: str) -> None:
        for node in body:
            if isinstance(node, ast.ClassDef):
                out.append((node.name, prefix + node.name, "class", node.lineno, node.end_lineno))
                visit(node.body, f"{prefix}{node.name}.")
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append((node.name, prefix + node.name, "method" if prefix else "function", node.lineno, node.end_lineno))
            elif isinstance(node, ast.Assign) and not prefix:
                out.extend((t.id, t.id, "constant", node.lineno, node.end_lineno) for t in node.targets if isinstance(t, ast.Name) and t.id.isupper())

    visit(tree.body, "")
    return out


def symbols(text: str, language: str) -> list[Symbol]:
    if language == "python":
        try:
            return python_symbols(text)
        except (SyntaxError, ValueError):
            return [(m[2], m[2], "class" if m[1] == "class" else "function", n, n) for n, line in enumerate(text.splitlines(), 1) if (m := re.match(r"^(class|def|async\s+def)\s+(\w+)", line))]
    return brace_symbols(text, language) if language in FORMS else []


def _blanked(text: str) -> str:
    """The text with comments, strings and templates as spaces; lines and places stay."""
    return _HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


_SIGNS = re.compile(r"[()\[\]{};\n]")
_GOES_ON, _WENT_ON = re.compile(r"\s*(?:\{|[=.&|?:+]|implements\b|extends\b|throws\b|where\b)"), re.compile(r"(?:=>|[=,|&(]|extends|implements)[ \t\r]*$")


class _Body:
    """Where declarations of a text end. Braces are paired once for the whole text."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.signs = [(m.start(), m[0]) for m in _SIGNS.finditer(text)]
        self.places = [p for p, _ in self.signs]
        self.closing: dict[int, int] = {}
        stack: list[int] = []
        for n, (_, c) in enumerate(self.signs):
            if c == "{":
                stack.append(n)
            elif c == "}" and stack:
                self.closing[stack.pop()] = n

    def end(self, at: int) -> tuple[int, int]:
        """Where the body opens (-1 without one), and where the declaration ends: behind its closing brace, at a
        semicolon before any brace, or at the end of a line that does not go on."""
        text, n, depth = self.text, bisect.bisect_left(self.places, at), 0
        while n < len(self.signs):
            i, c = self.signs[n]
            if c in "([":
                depth += 1
            elif c in ")]":
                depth -= 1
            elif c == "{":
                close = self.closing.get(n)
                if close is None:
                    return i, len(text)
                if depth <= 0:
                    return i, self.places[close] + 1
                n = close
            elif c == "}" or (depth <= 0 and (c == ";" or not (_GOES_ON.match(text, i) or _WENT_ON.search(text, max(at, i - 12), i)))):
                return -1, i
            n += 1
        return -1, len(text)


def brace_symbols(text: str, language: str) -> list[Symbol]:
    """As ``python_symbols`` for a language with braces: declarations with their last lines; what stands directly in a
    type is named after it, what stands in a function is left out."""
    plain = _blanked(text)
    body = _Body(plain)
    starts = [0, *(m.end() for m in re.finditer("\n", plain))]
    line = lambda at: bisect.bisect_right(starts, at)
    found: dict[int, tuple[str, re.Match]] = {}
    for kind, form in _COMPILED[language]:
        for m in form.finditer(plain):
            found.setdefault(m.start(m.lastindex), (kind, m))
    out: list[Symbol] = []
    open_: list[tuple[int, int, str, str]] = []  # first and last place of the body, kind, qualified name
    for _, (kind, m) in sorted(found.items()):
        while open_ and open_[-1][1] <= m.start():
            open_.pop()
        within = open_[-1] if open_ else None
        if within and (within[2] not in _TYPES or m.start() <= within[0]):
            continue
        if language == "go" and kind == "method":
            owner = m[1] + "."
        elif kind == "method" and not within:
            continue
        else:
            owner = within[3] + "." if within else ""
        opened, end = body.end(m.end() - (1 if plain[m.end() - 1] in "([{" else 0))
        name = m[m.lastindex]
        if kind == "method" and language != "go" and opened < 0 and within[2] == "class" and language == "typescript":
            continue  # a call in a field's value
        out.append((name, owner + name, "method" if kind == "function" and within else kind, line(m.start() + len(m[0]) - len(m[0].lstrip())), line(max(m.start(), end - 1))))
        if opened >= 0:
            open_.append((opened, end, kind, owner + name))
    return out


def generic(text: str) -> tuple[list[str], list[str], list[str]]:
    """Types, functions and the first parts of imports of a text in any language, each once."""
    plain = re.sub(r"(?m)//[^\n]*$|/\*[\s\S]*?\*/", "", text)
    functions = [a or b for a, b in GENERIC_FUNCTIONS.findall(plain)]
    parts = [re.split(r"[/.]|::", a or b)[0] for a, b in GENERIC_IMPORTS.findall(plain)]
    return (list(dict.fromkeys(GENERIC_TYPES.findall(plain))), [f for f in dict.fromkeys(functions) if f not in _NOT_NAMES], sorted({p.strip() for p in parts if p.strip()}))


def imports(text: str, language: str) -> list[str]:
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            return []
        found = [a.name for node in ast.walk(tree) if isinstance(node, ast.Import) for a in node.names]
        found += ["." * node.level + (node.module or "") for node in ast.walk(tree) if isinstance(node, ast.ImportFrom)]
    else:
        found = IMPORTS[language].findall(text) if language in IMPORTS else []
    return sorted(set(found))


def top_keys(text: str, language: str, most: int = 20) -> list[str]:
    """The first top-level keys of a JSON or TOML text; none if it does not parse."""
    try:
        value = json.loads(text) if language == "json" else tomllib.loads(text) if language == "toml" else {}
    except ValueError:
        return []
    return list(value)[:most] if isinstance(value, dict) else []


def extract(df: DataFrame, key: Column, language: Column, text: Column) -> DataFrame:
    """(key, language, symbols, imports, keys) of each file with a text; a pass in Arrow batches, no shuffle."""
    rows = df.select(key.alias("key"), language.alias("language"), text.alias("text")).where("text is not null and language is not null")
    symbol = pa.struct([("name", pa.string()), ("qualified_name", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, used, keys = [], [], []
            for lang, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found.append([dict(zip(symbol.names, s)) for s in symbols(t, lang)])
                used.append(imports(t, lang))
                keys.append(top_keys(t, lang))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(symbol)), pa.array(used, pa.list_(pa.string())), pa.array(keys, pa.list_(pa.string()))], ["key", "language", "symbols", "imports", "keys"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, language string, symbols array<struct<name:string,qualified_name:string,kind:string,start_line:int,end_line:int>>, imports array<string>, keys array<string>")
