from tesserae.sources import code

TS = """import { a } from "x"
export default class Foo<T> extends Bar {
  x = call(1)
  constructor(a: string) { super(a) }
  async run(n: number): Promise<void> {
    if (n) { function inner() {} }
    // class Not {}
    const s = "class Neither {"
  }
  get size() { return 1 }
}
interface I {
  m(a: string): void
}
export const f = async (a, b) => {
  return a
}
const LIMIT = 3
export function g<T>(x: T): T { return x }
type U = A | B
enum E { A, B }
"""

JAVA = """package a;
public class Foo<T> extends Bar {
    private final int x = f(1);
    public Foo(int a) { this.x = a; }
    @Override
    public <U> List<U> run(int n, String... s) throws E {
        if (n > 0) { g(); }
        return new ArrayList<>() { void hidden() {} };
    }
    interface In { int one(int a); }
    enum Color { RED, BLUE }
}
record R(int a) { }
"""

GO = """package a

type T struct {
\tA int
}

type I interface { M() }

type F func(int) string

const C = 1

func (t *T) Do(n int) error {
\tfunc() { }()
\treturn nil
}

func main() {
\tvar x = `func no() {`
}
"""


def test_typescript():
    assert [(q, k, a, b) for _, q, k, a, b in code.symbols(TS, "typescript")] == [
        ("Foo", "class", 2, 11), ("Foo.constructor", "method", 4, 4), ("Foo.run", "method", 5, 9), ("Foo.size", "method", 10, 10), ("I", "interface", 12, 14), ("I.m", "method", 13, 13),
        ("f", "function", 15, 17), ("LIMIT", "constant", 18, 18), ("g", "function", 19, 19), ("U", "type", 20, 20), ("E", "enum", 21, 21),
    ]


def test_java():
    assert [(q, k, a, b) for _, q, k, a, b in code.symbols(JAVA, "java")] == [
        ("Foo", "class", 2, 12), ("Foo.Foo", "method", 4, 4), ("Foo.run", "method", 6, 9), ("Foo.In", "interface", 10, 10), ("Foo.In.one", "method", 10, 10), ("Foo.Color", "enum", 11, 11), ("R", "class", 13, 13),
    ]


def test_go():
    assert [(q, k, a, b) for _, q, k, a, b in code.symbols(GO, "go")] == [("T", "class", 3, 5), ("I", "interface", 7, 7), ("F", "type", 9, 9), ("C", "constant", 11, 11), ("T.Do", "method", 13, 16), ("main", "function", 18, 20)]


def test_broken_and_empty():
    for language in ("typescript", "java", "go", "cobol"):
        assert code.symbols("", language) == []
        code.symbols("class A { {{{ ( } func x( interface", language)


def test_generic():
    text = "use std::io;\n#include <stdio.h>\nimport foo.bar\nstruct P { }\npub fn run(a: i32) {}\nint add(int a) {\n}\n// class No\nfun k() {}\nif (x) {\n}\n"
    assert code.generic(text) == (["P"], ["run", "add", "k"], ["foo", "std", "stdio"])
    assert code.generic("") == ([], [], [])
