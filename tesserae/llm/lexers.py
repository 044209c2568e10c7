"""Token streams for the bundled grammars.

Each lexer gives the tokens of a text as (terminal name, place) lists, or raises ``LexError`` with the place of the first
characters that are no token. Names of tokens are the grammar's literals and classes.
"""

from __future__ import annotations

import re
import unicodedata


class LexError(Exception):
    def __init__(self, place: int) -> None:
        super().__init__(place)
        self.place = place


Tokens = tuple[list[str], list[int]]

# JSON -----------------------------------------------------------------------------------------------------------------
_JSON = re.compile(
    r"""[ \t\n\r]+|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|([{}\[\]:,]|true|false|null)"""
)


def lex_json(text: str) -> Tokens:
    kinds, places, at, n = [], [], 0, len(text)
    match = _JSON.match
    while at < n:
        m = match(text, at)
        if m is None:
            raise LexError(at)
        which = m.lastindex
        if which:
            kinds.append("STRING" if which == 1 else "NUMBER" if which == 2 else m[3])
            places.append(at)
        at = m.end()
    return kinds, places


# TOML -----------------------------------------------------------------------------------------------------------------
_TOML_STRINGS = (
    r'"""(?:[^\\\x00-\x08\x0b-\x1f\x7f"]|\r\n|"{1,2}(?!")|\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[ \t]*\r?\n))*"{3,5}'
    r"|'''(?:[^\x00-\x08\x0b-\x1f\x7f']|\r\n|'{1,2}(?!'))*'{3,5}",
    r'"(?:[^\\\x00-\x08\x0a-\x1f\x7f"]|\\(?:[btnfr"\\]|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"' r"|'[^\x00-\x08\x0a-\x1f\x7f']*'",
)
_TOML_DATE, _TOML_TIME = r"[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])", r"(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?"
_DIGITS = r"[0-9](?:_?[0-9])*"
_TOML_SCALAR = (
    rf"{_TOML_DATE}(?:[Tt ]{_TOML_TIME}(?:[Zz]|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])?)?|{_TOML_TIME}"
    r"|0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*"
    rf"|[+-]?(?:inf|nan)|[+-]?(?:0|[1-9](?:_?[0-9])*)(?:\.{_DIGITS})?(?:[eE][+-]?{_DIGITS})?|true|false"
)
_TOML_SKIP = r"[ \t]+|#[^\x00-\x08\x0a-\x1f\x7f]*"
_TOML_KEY = re.compile(rf"{_TOML_SKIP}|(\r?\n)|({_TOML_STRINGS[1]})|([A-Za-z0-9_-]+)|(\[\[|\]\]|[\[\]{{}}=.,])")
_TOML_VALUE = re.compile(rf"{_TOML_SKIP}|(\r?\n)|({_TOML_STRINGS[0]})|({_TOML_STRINGS[1]})|((?:{_TOML_SCALAR})(?![A-Za-z0-9_+.:-]))|([\[\]{{}},])")


def lex_toml(text: str) -> Tokens:
    kinds, places, at, n = [], [], 0, len(text)
    inside: list[str] = []  # open brackets of a value
    key = True
    while at < n:
        m = (_TOML_KEY if key else _TOML_VALUE).match(text, at)
        if m is None:
            raise LexError(at)
        which = m.lastindex
        start, at = at, m.end()
        if not which:
            continue
        if which == 1:
            if "[" not in inside[-1:]:
                kinds.append("NEWLINE")
                places.append(start)
                if not inside:
                    key = True
            continue
        if key:
            kind = ("STRING", "BARE", m[4])[which - 2]
            if kind == "=":
                key = False
            elif kind == "}" and inside:
                inside.pop()
                key = False if inside else key
            elif inside and kind == "[[":
                raise LexError(start)
        else:
            kind = ("LONG", "STRING", "SCALAR", m[5])[which - 2]
            if kind in ("[", "{"):
                inside.append(kind)
                key = kind == "{"
            elif kind in ("]", "}") and inside:
                inside.pop()
            elif kind == ",":
                key = inside[-1:] == ["{"]
        kinds.append(kind)
        places.append(start)
    return kinds, places


# Languages with braces ------------------------------------------------------------------------------------------------
def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


#: Reserved words of the language definitions.
GO_WORDS = _words("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var")
JAVA_WORDS = _words(
    "assert break case catch class continue default do else enum extends finally for if implements import instanceof interface new package"
    " return super switch synchronized this throw throws try void while record yield when"
)
JAVA_MODIFIERS = _words("public private protected static final abstract native transient volatile strictfp sealed")
JAVA_PRIMITIVES = _words("boolean byte char double float int long short")
TS_WORDS = _words(
    "if else for while do return break continue throw try catch finally switch case default import export function class enum extends new this super typeof void"
    " delete in instanceof const var with debugger null type of as from get set async static public private protected readonly declare abstract namespace module"
    " keyof infer is asserts satisfies unique override let await yield accessor global interface implements"
)
PYTHON_WORDS = _words(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass"
    " raise return try while with yield match case type _"
)

_IDENT = r"[^\W\d]\w*"
_GO = re.compile(
    r"([ \t\r]+|//[^\n]*)|(\n)|(/\*[\s\S]*?\*/)"
    rf"|({_IDENT})"
    r"|((?:0[xX](?:_?[0-9a-fA-F])*(?:\.(?:[0-9a-fA-F](?:_?[0-9a-fA-F])*)?)?(?:[pP][+-]?[0-9](?:_?[0-9])*)?|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:[0-9](?:_?[0-9])*(?:\.(?:[0-9](?:_?[0-9])*)?)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?)i?(?!\w))"
    r"""|("(?:[^"\\\n]|\\(?:[abfnrtv\\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"|`[^`]*`)"""
    r"|('(?:[^'\\\n]|\\(?:[abfnrtv\\']|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))')"
    r"|(<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~])"
)
_GO_NOT_OCTAL = re.compile(r"0_?[0-9_]*[89][0-9_]*")
_GO_OPS = {**dict.fromkeys("+ - ^ &".split(), "UNARYOP"), "!": "UNARY", **dict.fromkeys("/ % << >> &^ && || == != < <= > >=".split(), "OP"), **dict.fromkeys("+= -= *= /= %= &= |= ^= <<= >>= &^=".split(), "ASSIGN"), "++": "STEP", "--": "STEP"}
_GO_ENDS = frozenset(["NAME", "NUMBER", "STRING", "break", "continue", "fallthrough", "return", "STEP", ")", "]", "}"])


def lex_go(text: str) -> Tokens:
    kinds, places, at, n = [], [], 1 if text[:1] == "\ufeff" else 0, len(text)
    match = _GO.match
    last = ""
    while at < n:
        m = match(text, at)
        if m is None:
            raise LexError(at)
        which, start = m.lastindex, at
        at = m.end()
        if which == 1:
            continue
        if which == 2 or which == 3:
            if last in _GO_ENDS and (which == 2 or "\n" in m[3]):
                kinds.append(";")
                places.append(start)
                last = ";"
            continue
        word = m[which]
        if which == 4:
            last = word if word in GO_WORDS else "NAME"
        elif which == 8:
            last = _GO_OPS.get(word, word)
        else:
            last = "NUMBER" if which == 5 else "STRING" if which == 6 else "NUMBER"
            if which == 5 and word[0] == "0" and _GO_NOT_OCTAL.fullmatch(word):
                raise LexError(start)
        kinds.append(last)
        places.append(start)
    if last in _GO_ENDS:
        kinds.append(";")
        places.append(n)
    return kinds, places


_NUMBER_C = r"(?:0[xX][0-9a-fA-F_]*(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9_]+)?|0[bB][01_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?)"
_JAVA = re.compile(
    r"([ \t\r\n\f]+|//[^\n]*|/\*[\s\S]*?\*/)"
    r"|((?:[^\W\d]|\$)[\w$]*)"
    rf"|({_NUMBER_C}[lLfFdD]?(?![\w$]))"
    r'|("""[ \t\f]*\r?\n(?:[^\\"]|\\[\s\S]|"(?!""))*"""|"(?:[^"\\\n\r]|\\(?:[btnfrs"\'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))*"|\'(?:[^\'\\\n\r]|\\(?:[btnfrs"\'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))\')'
    r"|(<<=|>>>=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|&=|\|=|\^=|%=|<<|[-+*/&|^%<>=!~?:;,.@()\[\]{}])"
)
_JAVA_OPS = {**dict.fromkeys("/ % << == != <= >= && || ^".split(), "OP"), **dict.fromkeys("+= -= *= /= &= |= ^= %= <<= >>= >>>=".split(), "ASSIGN"), "++": "STEP", "--": "STEP", "+": "SIGN", "-": "SIGN", "!": "NOT", "~": "NOT"}


_D, _H = r"[0-9](?:[0-9_]*[0-9])?", r"[0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?"
#: Number literals of the language: digits at both ends of a part, octal ones after a leading zero.
_JAVA_NUMBER = re.compile(
    rf"(?:0|[1-9](?:[0-9_]*[0-9])?|0_*[0-7](?:[0-7_]*[0-7])?|0[xX]{_H}|0[bB][01](?:[01_]*[01])?)[lL]?"
    rf"|(?:{_D}\.(?:{_D})?|\.{_D})(?:[eE][+-]?{_D})?[fFdD]?|{_D}(?:[eE][+-]?{_D}[fFdD]?|[fFdD])|0[xX](?:{_H}\.?|(?:{_H})?\.{_H})[pP][+-]?{_D}[fFdD]?"
)


def lex_java(text: str) -> Tokens:
    kinds, places, at, n = [], [], 1 if text[:1] == "\ufeff" else 0, len(text)
    match = _JAVA.match
    while at < n:
        m = match(text, at)
        if m is None:
            raise LexError(at)
        which, start = m.lastindex, at
        at = m.end()
        if which == 1:
            continue
        word = m[which]
        if which == 2:
            if word in JAVA_WORDS:
                kind = word
            elif word in JAVA_MODIFIERS:
                kind = "MODIFIER"
            elif word in JAVA_PRIMITIVES:
                kind = "PRIMITIVE"
            elif word in ("true", "false", "null"):
                kind = "LITERAL"
            elif word == "permits" and kinds and kinds[-1] in ("NAME", ">"):
                kind = "PERMITS"
            elif word in ("goto", "const", "_"):
                kind = "NAME" if word == "_" else word
            elif word == "non" and text.startswith("-sealed", at):
                kind, at = "MODIFIER", at + 7
            else:
                kind = "NAME"
        elif which == 5:
            kind = _JAVA_OPS.get(word, word)
        else:
            kind = "LITERAL"
            if which == 3 and not _JAVA_NUMBER.fullmatch(word):
                raise LexError(start)
        kinds.append(kind)
        places.append(start)
    return kinds, places


_TS = re.compile(
    r"([ \t\f\v\u00a0\ufeff]+|//[^\n\r\u2028\u2029]*)|([\n\r\u2028\u2029]+|/\*[\s\S]*?\*/)"
    r"|((?:[^\W\d]|\$|\\u[0-9a-fA-F]{4})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4})*)|(\#(?:[^\W\d]|\$)[\w$]*)"
    rf"|((?:{_NUMBER_C}|0[oO][0-7_]+)n?(?![\w$]))"
    r"""|("(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')"""
    r"|(>>>=|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|===|!==|\.\.\.|=>|\?\.(?![0-9])|\*\*|\+\+|--|<<|<=|>=|==|!=|&&|\|\||\?\?|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*%&|^<>=!~?:;,.@()\[\]{}])"
)
_TS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[\w$]*")
_TS_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_TS_OPS = {**dict.fromkeys("% ^ ** << <= >= == != === !== && || ?? /".split(), "OP"), **dict.fromkeys("+= -= *= /= %= &= |= ^= **= <<= >>= >>>= &&= ||= ??=".split(), "ASSIGN"), "++": "STEP", "--": "STEP"}
#: After these a slash divides; after anything else it begins a regular expression.
_TS_OPERANDS = frozenset(["NAME", "NUMBER", "STRING", "REGEX", "TEMPLATE", "T_TAIL", "PRIVATE", "KEYWORD", ")", "]", "}", "this", "super", "null", "STEP"])
_TS_SOFT = frozenset(TS_WORDS - _words("if else for while do return break continue throw try catch finally switch case default import export function class enum extends new typeof void delete in instanceof const var with debugger"))


def lex_typescript(text: str) -> tuple[list[str], list[int], list[bool]]:
    """As the others, and of each token (and the end) whether a line ends before it or it is a closing brace."""
    kinds: list[str] = []
    places: list[int] = []
    ends: list[bool] = []
    at, n = 0, len(text)
    if text.startswith("#!"):
        at = (text + "\n").index("\n")
    braces: list[bool] = []  # of each open brace whether it belongs to a template
    fresh = False
    match = _TS.match

    def template(start: int, begin: bool) -> int:
        m = _TS_TEMPLATE.match(text, start + 1)
        if m is None:
            raise LexError(start)
        closed = m[1] == "`"
        kinds.append(("TEMPLATE" if closed else "T_HEAD") if begin else ("T_TAIL" if closed else "T_MIDDLE"))
        places.append(start)
        ends.append(fresh)
        if not closed:
            braces.append(True)
        return m.end()

    while at < n:
        c = text[at]
        if c == "`":
            at = template(at, True)
            fresh = False
            continue
        if c == "}" and braces and braces[-1]:
            braces.pop()
            at = template(at, False)
            fresh = False
            continue
        m = match(text, at)
        if m is None:
            if c != "/":
                raise LexError(at)
            regular = None if kinds and (kinds[-1] in _TS_OPERANDS or kinds[-1] in _TS_SOFT) else _TS_REGEX.match(text, at)
            if regular:
                kind, start, at = "REGEX", at, regular.end()
            elif text.startswith("/*", at):
                raise LexError(at)
            else:
                kind, start, at = "OP", at, at + 1
        else:
            which, start = m.lastindex, at
            at = m.end()
            if which == 1:
                continue
            if which == 2:
                fresh = fresh or text[start] != "/" or "\n" in m[2]
                continue
            word = m[which]
            if which == 3:
                kind = word if word in TS_WORDS else "NAME"
            elif which == 7:
                if word == "/=" and not (kinds and (kinds[-1] in _TS_OPERANDS or kinds[-1] in _TS_SOFT)):
                    regular = _TS_REGEX.match(text, start)
                    if regular is None:
                        raise LexError(start)
                    kind, at = "REGEX", regular.end()
                else:
                    kind = _TS_OPS.get(word, word)
                    if word == "{":
                        braces.append(False)
                    elif word == "}" and braces:
                        braces.pop()
            else:
                kind = ("PRIVATE", "NUMBER", "STRING")[which - 4]
        kinds.append(kind)
        places.append(start)
        ends.append(fresh or kind == "}")
        fresh = False
    if any(braces):
        raise LexError(n)
    ends.append(True)
    return kinds, places, ends


# Python ---------------------------------------------------------------------------------------------------------------
_PY_STRING = re.compile(r"""(?i:(?P<p>f|rf|fr|[rub]|br|rb)?)(?P<q>\"\"\"|'''|"|')""")
_PY = re.compile(
    r"([ \t\f]+|\#[^\n\r]*|\\\r?\n)|(\r\n|\n|\r)"
    r"|([^\W\d][\w\u0300-\u036f\ufe00-\ufe0f\U000e0100-\U000e01ef]*)"
    r"|(0[xX](?:_?[0-9a-fA-F])+(?!\w)|0[bB](?:_?[01])+(?!\w)|0[oO](?:_?[0-7])+(?!\w)|(?:[0-9](?:_?[0-9])*\.(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*|[0-9](?:_?[0-9])*(?=[eE][+-]?[0-9]))(?:[eE][+-]?[0-9](?:_?[0-9])*)?[jJ]?(?!\w)|(?:0(?:_?0)*|[1-9](?:_?[0-9])*)(?!\w)|[0-9](?:_?[0-9])*[jJ](?!\w))"
    r"|(\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|\*\*|//|<<|>>|<=|>=|==|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[-+*/%&|^~<>()\[\]{},:.;@=])"
)
_PY_OPS = {**dict.fromkeys("// % << >> & ^".split(), "OP"), **dict.fromkeys("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split(), "AUG"), **dict.fromkeys("< > == >= <= !=".split(), "COMPARE")}
_PY_TEXT = {
    (quote, raw): re.compile(
        ("(?:[^\\\\{}" + quote[0] + ("" if len(quote) == 3 else "\\n\\r") + "]" + (r"|\\(?:\r\n|[^{}])|\\(?=[{}])" if raw else r"|\\N\{[^}]*\}|\\(?:\r\n|[^{}])|\\(?=[{}])") + r"|\{\{|\}\}" + ("|" + quote[0] + "(?!" + quote[0] * 2 + ")" if len(quote) == 3 else "") + ")+")
    )
    for quote in ('"""', "'''", '"', "'")
    for raw in (True, False)
}
_PY_PLAIN = {
    quote: re.compile(("(?:[^\\\\" + quote[0] + ("" if len(quote) == 3 else "\\n\\r") + r"]|\\(?:\r\n|[\s\S])" + ("|" + quote[0] + "(?!" + quote[0] * 2 + ")" if len(quote) == 3 else "") + ")*" + quote))
    for quote in ('"""', "'''", '"', "'")
}
_PY_SPEC = re.compile(r"[^{}\n\r]+")
_PY_ESCAPES = re.compile(r"\\(?:x(?![0-9a-fA-F]{2})|u(?![0-9a-fA-F]{4})|U(?!00(?:0[0-9a-fA-F]|10)[0-9a-fA-F]{4})|N(?!\{))")


def lex_python(text: str) -> Tokens:
    kinds: list[str] = []
    places: list[int] = []
    at, n = 1 if text[:1] == "\ufeff" else 0, len(text)
    if "\0" in text:
        raise LexError(text.index("\0"))
    columns = [(0, 0)]
    brackets: list[str] = []
    fields: list[tuple[str, bool, int]] = []  # of each open replacement field: quote, raw, brackets open outside it
    line_start = True

    def put(kind: str, place: int) -> None:
        kinds.append(kind)
        places.append(place)

    def formatted(begin: int, quote: str, raw: bool) -> int:
        """Text of an f-string up to its end or the next field."""
        place = begin
        m = _PY_TEXT[quote, raw].match(text, place)
        if m:
            if not raw and _PY_ESCAPES.search(m[0].replace("\\\\", "")):
                raise LexError(place)
            put("F_TEXT", place)
            place = m.end()
        if text.startswith(quote, place):
            put("F_END", place)
            return place + len(quote)
        if text.startswith("{", place):
            put("{", place)
            brackets.append("{")
            fields.append((quote, raw, len(brackets)))
            return place + 1
        raise LexError(place)

    def spec(begin: int) -> int:
        """Of a format specification up to its end or the next field."""
        quote, raw, _ = fields[-1]
        m = _PY_SPEC.match(text, begin)
        place = begin
        if m:
            stop = m[0].find(quote)
            if stop >= 0:
                raise LexError(begin + stop)
            put("F_TEXT", begin)
            place = m.end()
        if text.startswith("{", place):
            put("{", place)
            brackets.append("{")
            fields.append((quote, raw, len(brackets)))
            in_spec.append(len(fields))
            return place + 1
        if text.startswith("}", place):
            return close(place)
        raise LexError(place)

    def close(place: int) -> int:
        """The brace that ends a field, and what follows it."""
        quote, raw, _ = fields.pop()
        brackets.pop()
        put("}", place)
        if in_spec and in_spec[-1] == len(fields) + 1:
            in_spec.pop()
            return spec(place + 1)
        return formatted(place + 1, quote, raw)

    in_spec: list[int] = []
    while at < n:
        if line_start and not brackets:
            begin, column, alternate = at, 0, 0
            while at < n and text[at] in " \t\f":
                if text[at] == " ":
                    column, alternate = column + 1, alternate + 1
                elif text[at] == "\t":
                    column, alternate = column // 8 * 8 + 8, alternate + 1
                else:
                    column = alternate = 0
                at += 1
            if at < n and text[at] in "#\n\r" or at == n:
                if at < n and text[at] == "#":
                    while at < n and text[at] not in "\n\r":
                        at += 1
                at += 2 if text.startswith("\r\n", at) else 1
                continue
            line_start = False
            if column > columns[-1][0]:
                if alternate <= columns[-1][1]:
                    raise LexError(begin)
                columns.append((column, alternate))
                put("INDENT", begin)
            else:
                while column < columns[-1][0]:
                    columns.pop()
                    put("DEDENT", begin)
                if (column, alternate) != columns[-1]:
                    raise LexError(begin)
            continue
        s = _PY_STRING.match(text, at)
        if s:
            quote, prefix = s["q"], (s["p"] or "").lower()
            if "f" in prefix:
                put("F_START", at)
                at = formatted(s.end(), quote, "r" in prefix)
                continue
            m = _PY_PLAIN[quote].match(text, s.end())
            if m is None:
                raise LexError(at)
            if "b" in prefix and not m[0].isascii():
                raise LexError(at)
            if "\\" in m[0] and "r" not in prefix:
                body = m[0].replace("\\\\", "")
                bad = re.search(r"\\x(?![0-9a-fA-F]{2})", body) if "b" in prefix else _PY_ESCAPES.search(body)
                if bad:
                    raise LexError(at)
            put("BYTES" if "b" in prefix else "STRING", at)
            at = m.end()
            continue
        m = _PY.match(text, at)
        if m is None:
            if text[at] == "!" and fields and len(brackets) == fields[-1][2]:
                put("!", at)
                at += 1
                continue
            raise LexError(at)
        which, start = m.lastindex, at
        at = m.end()
        if which == 1:
            if m[1][0] == "\\" and at >= n:
                raise LexError(start)
            continue
        if which == 2:
            if not brackets:
                put("NEWLINE", start)
                line_start = True
            continue
        word = m[which]
        if which == 3:
            if not word.isascii() and not unicodedata.normalize("NFKC", word).isidentifier():
                raise LexError(start)
            put(word if word in PYTHON_WORDS else "NAME", start)
        elif which == 4:
            put("NUMBER", start)
        else:
            if word in "([{":
                brackets.append(word)
            elif word in ")]}":
                if not brackets or brackets[-1] + word not in ("()", "[]", "{}"):
                    raise LexError(start)
                if fields and len(brackets) == fields[-1][2]:
                    at = close(start)
                    continue
                brackets.pop()
            elif fields and len(brackets) == fields[-1][2] and word in (":", ":="):
                put(":", start)
                at = spec(start + 1)
                continue
            put(_PY_OPS.get(word, word), start)
    if brackets:
        raise LexError(n)
    if not line_start and kinds:
        put("NEWLINE", n)
    for _ in columns[1:]:
        put("DEDENT", n)
    return kinds, places
