import ast
import json
import random
import sysconfig
import tomllib
import warnings
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tesserae.llm import lr, syntax


def valid(language, text):
    return syntax.check(text, language, syntax.tables(language)) is None


GOOD = {
    "json": ['{"a": [1, -2.5e3, "x\\n", true, null, {}], "b": {"c": []}}', " 1 ", '"<<<<<<< x"'],
    "toml": ["", "\n\n# c\na = 1\n", 'a.b."c d" = { x = 1, y = [1, 2,] }\n[t]\nd = 1979-05-27T07:32:00Z\n[[u.v]]\ns = """\n======= x\n"""\nm = [\n 1, # c\n 2\n]\n', "x = 1_000\ny = 0xfF\nz = +inf\nl = 'C:\\x'\r\n"],
    "go": [
        'package a\n\nimport (\n\t"b"\n\tc "d"\n)\n\ntype T[K comparable, V any] struct {\n\tA, B int `json:"a"`\n\t*E\n}\n\ntype I interface {\n\tM(x int) (string, error)\n\t~int | ~string\n}\n\nvar x, y = 1, map[string][]int{"a": {1, 2}}\n\nfunc (t *T) F(a, b int, c ...string) (n int, err error) {\n\tfor i, v := range c {\n\t\tif s, ok := any(v).(string); ok && len(s) > 0 {\n\t\t\tgo func() { <-ch }()\n\t\t} else if x := a << 2; x != 0 {\n\t\t\tcontinue\n\t\t}\n\t\t_ = i\n\t}\n\tswitch v := y.(type) {\n\tcase int, *T:\n\t\treturn 1, nil\n\tdefault:\n\t}\n\tselect {\n\tcase m := <-ch:\n\t\tdefer close(m)\n\t}\n\tfor a < b {\n\t\ta++\n\t}\n\tp := &T{A: 1, B: []int{2}[0]}\n\tq := []*T{{A: 1}, {}}\n\tw := Map[int, string](q)\n\tvar z [3]int\n\tz[1:2][0] += 3\nL:\n\tfor {\n\t\tbreak L\n\t}\n\treturn\n}\n'
    ],
    "java": [
        '@A(x = {1, 2}) package a.b; import static c.D.*; import e.F;\npublic abstract class X<T extends Comparable<T> & I> extends Y<Map<String, List<int[]>>> implements Z, W<?> {\n private final int[] a = {1, 2}, b[] = new int[3][];\n static { f(); }\n public X(int q, final String... r) throws E { super(q); this.x = (int) q; }\n @Override <U> U m(List<? super U> l) { for (var e : l) { if (e instanceof String s && s.length() > 1) continue; else break; } int k = i < j ? a[0] >>> 2 : -b; Runnable r = () -> { return; }; F<A> g = (x, y) -> x + y; h(String::new, int[]::new, a::b); switch (k) { case 1, 2 -> f(); default -> throw new E(); } try (var s = o(); t) { x = (T) y; } catch (A | B e) { } finally { } label: while (true) { i++; } do { } while (x); synchronized (this) { } return new ArrayList<>(List.of()) { int z; }; }\n enum C { P(1) { void f() {} }, Q; int v; }\n record R(int a, String b) { R { } }\n interface I { default void f() {} int K = 1; }\n @interface N { int value() default 1; }\n}\n'
    ],
    "typescript": [
        'import a, { b as c, type D } from "x"\nimport * as e from "y";\nexport const f = async <T,>(x: T, { y, ...z }: { y?: number }): Promise<T[]> => { await g(x) ; return [x] }\nexport default class A<T extends B = C> extends D<T> implements E {\n  private readonly x: Map<string, Array<number>> = new Map()\n  static #p = 1;\n  constructor(public a: string, b = 2) { super() }\n  get v(): number { return this.x!.size ?? 0 }\n  async *m<K extends keyof T>(k: K, ...r: any[]): AsyncGenerator<T[K]> { yield* r as any }\n  [key: string]: unknown\n}\nenum F { A = 1, B }\ntype G<T> = T extends (infer U)[] ? U : { readonly [K in keyof T]?: T[K] } | `a${string}` | [x: number, y?: string]\ninterface H extends I { (x: number): string; new (y: string): H; m?(): void, p: typeof a.b }\nfor (const q of r) { if (q < 1 && s > 2) continue; else t = q ? `a ${u + `b`} c` : /re[/]x/g.test(v) }\nlet w = (x) => ({ x, [y]: 1, get z() { return 1 }, async k() {} })\nlabel: for (let i = 0; i < 3; i++) { break label }\nfunction o(this: Window, p?: string): asserts p is string\nfunction o(p) { switch (p) { case 1: return; default: throw new Error("x") } }\ntry { x?.y?.[0]?.(1) } catch { } finally { }\ndeclare module "m" { export function n(): void }\nx = a < b\ny = c > (d)\nz = e / f / g\n'
    ],
    "python": ["", "x: int = 1\nfor i, (j, *k) in y: pass\nelse:\n\tprint(f'{a!r:>{w}} {{}}', end='')\n", "match x:\n case [1, *_] | {'a': b, **c} if d: pass\n case P(x=1): ...\nmatch = 1; type X[T: int] = list[T]\n", "@d(1)\nasync def f[T](a, /, b=1, *, c, **k) -> T:\n    async with x as y, z: return [i async for i in j if i]\n    try: a[1:2, ::3] = yield\n    except* (A, B) as e: raise X from e\n    finally: del q[0], r.s\n", "(a, b), [c, *d] = e = f\nx = lambda *a, k=1: (yield)\nprint(a if (n := b) else ~c ** -d, *e, **f)\n"],
}
BAD = {
    "json": ["", "{", '{"a": 1,}', "[1 2]", "{'a': 1}", "1 2", "NaN", '"\n"', "01", '{"a" 1}'],
    "toml": ["a", "a = ", "a = 1 b = 2", "[t", "a = [1", "a = {x = 1,}", 'a = "x\n', "<<<<<<< HEAD\n", "a b = 1", "a = 2020-13-01"],
    "go": ["", "func f() {}\n", "package a\nfunc f() {\n", "package a\n<<<<<<< HEAD\n", "package a\nvar x = \n", 'package a\nvar x = "y\n', "package a\nx := 1\n", "package a\nfunc f() { a b }\n"],
    "java": ["class {}", "class A {", "class A { int x = ; }", "class A { void f() { g( } }", ">>>>>>> x\nclass A {}", 'class A { String s = "x; }', "x = 1;", "class A { int f() { return 1 } }"],
    "typescript": ["let x = {", "function f( {", "const a: = 1", "<<<<<<< HEAD\n", "=======\n", '{ "a": 1 }', "let x = `a ${b", "package a\n\nimport (\n)", "a b", "/* x"],
    "python": ["x = ", "def f(:\n pass\n", "if x:\n", " x\n", "f() = 1\n", "x = 'a\n", "(a\n", "<<<<<<< HEAD\n", "def f(*a, *b): pass\n", "if x:\n    a\n  b\n", "1x\n", "f'{a'\n", "func main() {\n}\n"],
}


@pytest.mark.parametrize("language", GOOD)
def test_good_and_bad(language):
    for text in GOOD[language]:
        at = syntax.check(text, language, syntax.tables(language))
        assert at is None, (language, text[max(0, at - 40) : at], text[at : at + 20])
    for text in BAD[language]:
        assert not valid(language, text), (language, text)
    if language not in ("python", "toml"):
        for text in GOOD[language]:
            long = text.rstrip()
            if long[-1] in "}]":
                assert not valid(language, long[:-1])


#: Texts that only a grammar wider than the language accepts.
NARROW = {
    "python": [
        "f(a=1, 2)", "f(**a, *b)", "f(**a, b)", "f(x for x in y, 1)", "def f(a=1, b): pass", "def f(*): pass", "def f(*, **k): pass", "def f(/, a): pass", "def f(a, /, b, /): pass",
        "def f(a, *, /, b): pass", "def f(**k, a): pass", "def f(*a, *b): pass", "def f(a=1, /, b): pass", "lambda *: 1", "lambda a=1, b: 1", "lambda *, **k: 1", "class A(x for x in y): pass",
        "class A(b=1, c): pass", "del *a", "del f()", "try: pass\nexcept*: pass\n", "try: pass\nexcept A: pass\nexcept* B: pass\n", "try: pass\nexcept A, B: pass\n",
    ],
    "java": [f"class A {{ void f() {{ {x} }} }}" for x in ("1;", "a + b;", "x -> y;", "a;", "this.b;", "-a;", "(a);", "a[0];", "new int[3];", "String::new;", '"x";', "for (a; b; c) { }", "for (;; i + 1) { }", "int x = 08;", "int x = 0x;", "int x = 1_;", "int x = 0b2;", "a + b = c;")],
    "go": [f"package a\nfunc f() {{\n{x}\n}}\n" for x in ("if x == T{} { }", "for x := range T{} { }", "switch x := T{1}; x { }", "if p.T{} == x { }", "f(x){1}", "a[1](){}", "x := 08")],
}
#: Their nearest relatives, which are valid.
NEAR = {
    "python": [
        "f(a, *b, c=1, *d, **e, g=2)", "f(*a, b)", "f(a=1, *b)", "f(**a, b=1, **c,)", "f(x for x in y)", "def f(a, b=1, /, c=2, *, d, e=3, f, **g): pass", "def f(a, /): pass", "def f(a, /, b): pass", "def f(a, /, b, c=1,): pass",
        "def f(a=1, /): pass", "def f(a=1, /, b=2, *c, d): pass", "def f(*, a=1, b): pass", "def f(*a: *b): pass", "def f(**k,): pass", "lambda a, /, b, c=1, *d, e, **f: 1", "lambda *, a: 1", "lambda: 0", "class A(B, *c, d=1, **e): pass", "class A(): pass",
        "del a, (b, [c.d]), e[0],", "try: pass\nexcept* A: pass\nexcept* (B, C) as d: pass\n", "try: pass\nexcept A: pass\nexcept: pass\n", "f(a := 1, b)", "f(a)(b=1)[c](*d)", "@a(b, c=1)\ndef d(): pass\n",
    ],
    "java": [f"class A {{ void f() {{ {x} }} }}" for x in ("a = 1;", "a.b[0] += c;", "i++;", "--i;", "a.b().c();", "new A();", "new A() { };", "b.new C();", "this.<T>f(1);", "super.f();", "for (i = 0, j = 1; i < j; i++, f()) { }", "x = y -> z;", "double x = 08.5; x = 09f; x = 1e5; x = 0x1p3; x = .5; x = 1.; x = 0; x = 07L; x = 0b1_0;", "int[] a = new int[3];", "(a) = 1;", "a().b = 1;", "int x = y = 2;", "String[] s = new String[]{\"a\"};", "List<A> b = new ArrayList<>();", "switch (a) { case 1 -> f(); }", "yield_(); a: for (;;) { break a; }")],
    "go": [f"package a\nfunc f() {{\n{x}\n}}\n" for x in ("if x == (T{}) { }", "if f(T{}) { }", "for _, x := range []int{1, 2} { }", "switch x := (T{1}); x.a { }", "if x { y = T{} }", "x := p.T{1}", "x := T[int]{1}", "for i := range f(x) { }", "if a[b] { }", "switch { case x == T{}: }", "x := 08.5", "x := 0x_1F + 0o17 + 0b1 + 1_000", "if v, ok := m[T{1}]; ok { }", "x := map[string]T{\"a\": {1}}", "if f := func() bool { return true }; f() { }", "for x.y { }", "if x := y.(T); x { }", "x := []T{{1}}[0].f()", "for i := 0; i < n; i++ { }", "switch x := y.(type) { case T: }")],
}


@pytest.mark.parametrize("language", NARROW)
def test_grammars_are_no_wider_than_the_languages(language):
    for text in NARROW[language]:
        assert not valid(language, text), (language, text)
        assert language != "python" or not truth("python", text), text
    for text in NEAR[language]:
        assert valid(language, text), (language, text)
        assert language != "python" or truth("python", text), text


def truth(language, text):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            {"python": ast.parse, "toml": tomllib.loads, "json": json.loads}[language](text)
        return True
    except (SyntaxError, ValueError):
        return False


def test_python_agrees_with_the_interpreter():
    rng = random.Random(3)
    sources = sorted(Path(sysconfig.get_path("stdlib")).glob("*.py"))
    wrong = 0
    for path in rng.sample(sources, 60):
        text = path.read_text("utf-8")[:30_000]
        for _ in range(4):
            at = rng.randrange(len(text)) if text else 0
            changed = rng.choice([text, text[:at], text[:at] + text[at + 1 :], text[:at] + rng.choice("()[]{}:,'\"=. ") + text[at:]])
            wrong += valid("python", changed) != truth("python", changed)
    assert wrong <= 1


def test_toml_and_json_agree_with_parsers():
    rng = random.Random(4)
    for language in ("toml", "json"):
        for text in GOOD[language]:
            for _ in range(150):
                at = rng.randrange(len(text) + 1)
                changed = rng.choice([text[:at], text[:at] + text[at + 1 :], text[:at] + rng.choice('{}[],:="\n') + text[at:]])
                assert valid(language, changed) == truth(language, changed), changed


def test_ambiguous_grammar_and_insertion():
    table = lr.build("s : e ; e : e 'p' e | 'x' ;")
    t = table.terminals
    assert lr.first_error(table, [t["x"], *[t["p"], t["x"]] * 6, 0]) is None
    assert lr.first_error(table, [t["x"], t["p"], 0]) == 2
    table = lr.build("s : (l ';')+ ; l : 'a' 'b'? ;")
    t = table.terminals
    assert lr.first_error(table, [t["a"], t["a"], t["b"], 0], [False, True, False, True], t[";"]) is None
    assert lr.first_error(table, [t["a"], t["a"], 0], [False, False, True], t[";"]) == 1
    with pytest.raises(ValueError):
        lr.build("s : a 'x' ; a : 'y'? ;")


def test_rows(spark):
    rows = [(1, "python", "x = 1\n", "r"), (2, "python", "x =\n", "r"), (3, "json", "", "r"), (4, "markdown", "# (", None), (5, None, "x", "r"), (6, "cobol", "x", "r"), (7, "python", None, "r"), (8, "go", "", "q"), (1, "python", "x = 1\n", "r"), (9, "python", "a = 1\n" * 20000 + "(", "r")]
    df = spark.createDataFrame(rows, "i int, lang string, c string, key string").withColumns({"language": F.lit(1), "valid": F.lit(2)})
    out = syntax.check_files(df, F.col("i"), F.col("lang"), F.col("c"), F.col("key").alias("repository"))
    got = [(r["key"], r["valid"], r["line"], r["column"], r["repository"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted([(1, True, None, None, "r"), (2, False, 1, 4, "r"), (3, False, 1, 1, "r"), (4, True, None, None, None), (5, None, None, None, "r"), (6, None, None, None, "r"), (7, None, None, None, "r"), (8, False, 1, 1, "q"), (1, True, None, None, "r"), (9, False, 20001, 2, "r")], key=str)
    assert syntax.check_files(df.limit(0), F.col("i"), F.col("lang"), F.col("c")).collect() == []
