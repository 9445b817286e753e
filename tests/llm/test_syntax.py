import ast
import warnings

import pytest

from corvine.llm import syntax

GOOD = {
    "py": ["", "x = 1", "def f(a, /, b: int = 2, *args, c, **k) -> int:\n    return a\n", "async def f():\n    async with a as b, c:\n        await d\n", "match x:\n    case [1, *rest] if rest:\n        pass\n    case {'a': b, **c} | A(x=1):\n        pass\n", "match = 1\ncase = match\ntype X[T] = list[T]\n", "print(f'{x!r:>{w}}', end='')\n", "if a: b\nelse: c\n", "try:\n    pass\nexcept* E as e:\n    pass\n", "x: int\na, *b = c\nd[0], e.f = 1, 2\n", "@a.b(1)\nclass C[T](B, metaclass=M):\n    '''d'''\n    x = [i for i in y if i for z in i]\n", "a = lambda x, *y, z=1: (yield)\n", "x = (1,\n  2)\nwith (open(a) as b, c):\n    pass\n", "if x := 1:\n\tpass\n", "def f(): return {**a, 'b': 1, **{c: d for c in e}}\n", "x = 'a' \\\n  'b'\n", "for i, in x:\n    continue\nelse:\n    pass\n"],
    "js": ["", "import a, { b as c } from 'x';\nexport default class extends A { #p = 1; static { f(); } get x() { return 1 } async *g() {} }", "const f = async ({ a = 1, ...b }, [c]) => { await a }\nlet x = a?.b ?? c\nfoo()\n", "for (const [k, v] of m) if (k) continue; else break;", "x = /[/\"']+/g.test(y) ? `a${b ? `c${d}` : ''}` : 1 / 2 / 3;", "if (a)\n  b()\nelse\n  c()\n", "label: while (1) { switch (x) { case 1: default: break label } }", "export const a = function () {}\nexport { a as b };\nvar o = { a, b() {}, get c() { return 1 }, [d]: 1, ...e }", "do { x++ } while (x < 3)\ntry { a } catch { b } finally { c }", "!function(e,t){var n={x:1};for(var i=0;i<3;i++)t[i]=i}(this,window);", "a = b\n++c", "new A.B(1).c`x`"],
    "ts": ["interface A<T = string> extends B { a?: Array<Map<string, T>>; [k: string]: any; m(x: number): void }", "export const f = async <T>(x: T, y?: number): Promise<T> => x as unknown as T;", "enum E { A = 1, B }\ntype U = 'a' | { k: readonly string[] } & ((x: number) => void);", "abstract class C<T> extends D<T> implements E, F { private readonly x: number = 1; constructor(private y: string) { super() } abstract m(): void; static async n?(): Promise<void> {} }", "function f(this: A, ...r: any[]): x is string { return !r! }", "declare module 'x' { export function f(): void; }\nnamespace N { export const a = 1 }", "let x = <any>y; const z = { a: 1 } satisfies T; type K = keyof typeof x; type M = { [P in K]?: T[P] };"],
    "go": ["package a\n", "package a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\ntype S[T any] struct {\n\tA, B int `json:\"a\"`\n\t*E\n}\n\nfunc (s *S[T]) M(a, b int, c ...string) (x int, err error) {\n\tif v, ok := m[a]; !ok {\n\t\treturn\n\t} else if x := f(); x > 1 {\n\t}\n\tfor i, e := range []string{\"a\", \"b\"} {\n\t\tgo func() { defer g(i, e) }()\n\t}\n\tswitch t := x.(type) {\n\tcase int, *S[int]:\n\tdefault:\n\t}\n\tselect {\n\tcase y := <-c:\n\t\t_ = y\n\tcase d <- 1:\n\t}\n\treturn map[string]interface{}{\"a\": 1}, nil\n}\n", "package a\n\nvar x = 'a'\nvar y = `raw\n\"`\nconst (\n\tA = iota\n\tB\n)\nfunc f() {\nL:\n\tfor {\n\t\tbreak L\n\t}\n\tx.y[1:2], z = a...b\n}\n".replace("a...b", "a, b")],
    "java": ["", "package a.b;\nimport java.util.*;\npublic class A<T extends B & C> extends D<T> implements E {\n  @Override public <R> Map<String, List<R>> m(final int[] x, String... y) throws F { for (Object o : (Iterable<?>) x) g(o); int[] a = {1, 2}; return new HashMap<>() {{ put(1, 2); }}; }\n  static { }\n  enum K { A(1), B { void f() {} }; int x; }\n  record P(int a) implements Q { P { } }\n  sealed interface S permits T, U { default void d() {} }\n}", "class A { int f(Object o) { if (o instanceof String s && s.length() > 1) return switch (o) { case String t -> 1; case null, default -> { yield 2; } }; var r = (Runnable & S) () -> {}; x::y; return 1; } }".replace(" x::y;", " f(x::y);"), "class A { String s = \"\"\"\n  a \"b\"\n  \"\"\"; char c = '\\u0041'; long l = 0x1FL; @A({1, 2}) int[][] m = new int[3][]; { try (var x = y()) { } catch (A | B e) { } finally { } do { } while (true); synchronized (this) { } } }"],
}
BAD = {
    "py": ["def f(:\n", "def f()\n    pass\n", "x = (1\n", "print x\n", "if a:\nb\n", "  x = 1\n", "class A:\n    def f(self):\n        pass\n   x = 1\n", "<<<<<<< HEAD\n", "x = “a”\n", "f() = 1\n", "else:\n    pass\n", "x = 01\n", "a b\n", "try:\n    pass\n", "x = 'a\n", "\x00"],
    "js": ["function f( {", "const a = ;", "let x = [1, 2;", "interface A { x: string }", "function f(a: number) {}", "<<<<<<< HEAD\nx\n", "const s = \"a", "def f():\n  pass", "if (a { }", "class A { x y }", "/* open", "a b", "package x\nfunc y() {}"],
    "ts": ["interface A { x: }", "class A { m( { } }", "const x: = 1", "package shop;\npublic class A { }", "let a = (1;", "function f(a: number { }"],
    "go": ["package a\nfunc f( {\n}\n", "package a\nfunc f() {\n", "package a\nvar x = “y”\n", "package a\nimport a from 'b';\n", "package a\nfunc f() {\n\tif x {\n\t}\n\telse {\n\t}\n}\n", "package a\nvar s = \"a\n"],
    "java": ["class A { void f( { } }", "class A { int x = 3 int y; }", "class A { void f() { x; } }", "class A {", "import a.b\nclass A {}", "class A { String s = \"a; }", "def f():\n    pass\n", "class A { void f() { int x = ; } } // x"],
}


@pytest.mark.parametrize(("ext", "code"), [(e, c) for e, cs in GOOD.items() for c in cs])
def test_good(ext, code):
    if ext == "py":
        ast.parse(code)
        assert syntax._python(code)
    assert syntax.parses(ext, code)


@pytest.mark.parametrize(("ext", "code"), [(e, c) for e, cs in BAD.items() for c in cs])
def test_bad(ext, code):
    assert not syntax.parses(ext, code)


def reference(code):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(code)
        return True
    except (SyntaxError, ValueError):
        return False


GOOD_TOO = {
    "py": ["x = f'{a}' f\"{b!r:>{w}.{p}}\" 'c'", "x = f'{a[\"b\"]}'", 'x = f"{a["b"]} {f"{c}"}"', "x = f'{{}} {x = } {y:%Y-%m-%d}'", 'x = f"""{\n  a  # c\n}"""', "x = rf'\\d{n}'", "x = f'{lambda_}' if a else f'{(lambda x: 1)}'", "x = f'{a!s}{b != c}{d:{e}}'", "f(*a, b, *c, d=1, *e, **g, h=2)", "(a) += 1", "(a): int = 1", "def f(a, b=1, /, c=2, *, d, e=3, **k): pass", "def f(*, a): pass", "f = lambda a, /, b=1, *c, d, **e: 0", "x = b'a' rb'\\x' b\"\\x00\"", "x = '\\N{EM DASH}' '\\u00e9' r'\\x0'", "x = not a and not b or -c ** -d", "*a, = b", "del (a, b), c[0]", "x = " + "(" * 200 + "1" + ")" * 200, "f(x for x in y)", "print(None is True)", "match w := x,:\n    case {-0-0j: 1, **k}:\n        pass\n", "match *a, b:\n    case _: pass\n", "def f(): x = yield; return (yield x)"],
    "js": ["if (a) /re/.test(b)", "while (f(x)) /['\"]/g.exec(y)", "x = (a) / b / c", "x =   /re/.test(y)", "[a, b] = [b, a]; ({ a, b: c.d, e = 1, ...f } = g)", "for ({ a = 1 } of b) c", "for (x.y of z) ;", "a.b.c += 1; a[0]++; --a.b; (a) = 1", "a ** -b; a ** b ** c; (-a) ** b; ++a ** b", "(a ?? b) || c; a ?? b ?? c", "const { a, b = 1 } = c, [d] = e", "for (const a of b) ; for (var i in x) ; for (let i = 0, n; i < 3; i++) ;", "({ a, b } = c)", "f(({ a = 1 }) => a)", "async () => { await a; return await b }", "x = a\n  ? /re/ : 1", "x = a >\n  1", "x = `${'(^|[^\\\\d])' + '(\\\\d{1,'}${m}}`", "x = `${a ? `b${ {c: '}'} }` : `c`} '`", "s = x.replace(/`/g, '').replace(/[`'\"]/, `q${y}`)", "export { a } from 'b'\nexport { c }\nfrom 'd'", "if (a)\n  b()\nelse if (c)\n  d = function () {\n  }\nif (e) {\n}\nconst f = g ? h : {\n  i: 1,\n}\nconst j = 2"],
    "ts": ["let a: number; declare const b: string;", "declare namespace N { const x: number; export let y: string; function f(): void }", "(a as B).c = 1; (<any>a).b = 2; a!.b = 1", "const x: A = b", "let { a }: B = c", "if (a) /re/.test(b)"],
    "go": ["package a; import \"b\"\nimport c \"d\"\nvar x = 1\nfunc f(a, b int, c ...string) {}\nfunc g(int, string) (a, b int, err error) { return }\ntype F func(a int, b ...string) (int, error)\n", "// c\npackage a\n\nfunc f(ctx context.Context, _ *http.Request, g func(int) error, m map[string]int, ch <-chan int) {}\n"],
    "java": ["package a; import b.C; import static d.E.*; class A { int[] x; { x[0] = 1; x[0]++; --this.y; (z) = 1; f().g = 2; } }", "class A { void f() { try { } finally { } try { } catch (E e) { } try (x) { } if (a) { int y = 1; } for (int i = 0; i < 3; i++) ; a: while (true) break a; } public static final int X = 1; public public_ x; }", "class A { int f() { return -x++ + ++y - (int) -z; } }"],
}
BAD_TOO = {
    "py": ['x = f"{a b}"', 'x = f"{}"', 'x = f"{a!z}"', 'x = f"{a"', "x = f'}'", "f(a=1, 2)", "f(**k, *a)", "f(**k, a)", "f(x for x in y, 1)", "(a, b) += 1", "[a]: int", "(a, b): int = 1", "def f(**k, a): pass", "def f(a=1, b): pass", "def f(*): pass", "lambda *: 0", "def f(a, /, b, /): pass", 'x = b"é"', '"\\x0"', "x = '\\u12'", "b'a' 'b'", "None = 1", "f(True=1)", "*a = b", "del f()", "del *a", "x = a + not b", "[y for x in z if y := 1]", "x = " + "(" * 201 + "1" + ")" * 201, "await -x"],
    "js": ["a + 1 = 2;", "f() = 3;", "1++;", "const x;", "-a ** b;", "a ?? b || c;", "a && b ?? c", "({a:1, a=2});", "let { a };", "++f()", "this = 1", "for (f() of b) ;", "[a + 1] = b", "x = (a) / "],
    "ts": ["f() = 3;", "const x: number;", "1++;", "a ?? b || c;"],
    "go": ["func f() {}\n", "package a\nvar x = 1\nimport \"b\"\n", "package a\nfunc f(a int, b) {}\n", "package a\npackage b\n", "var x = 1\n"],
    "java": ["class A { void f() { try {} } }", "class A { void f() { 1 = x; } }", "class A { void f() { if (x) int y = 1; } }", "public public class A {}", "class A {} import b.C;", "import a.B; package c; class A {}", "class A { void f() { f()++; } }", "class A { void f() { a + b = c; } }", "class A { private static private int x; }", "class A { void f() { while (x) class B {} } }"],
}


@pytest.mark.parametrize(("ext", "code"), [(e, c) for e, cs in GOOD_TOO.items() for c in cs])
def test_good_too(ext, code):
    assert syntax.parses(ext, code) and (ext != "py" or reference(code))


@pytest.mark.parametrize(("ext", "code"), [(e, c) for e, cs in BAD_TOO.items() for c in cs])
def test_bad_too(ext, code):
    assert not syntax.parses(ext, code) and (ext != "py" or not reference(code) or code == "*a = b")


def test_against_the_reference_parser(spark, sf):
    rows = spark.read.parquet(f"{sf}/source_file.parquet").where("lower(file_path) like '%.py' and code is not null").select("code").collect()
    assert all(syntax._python(r.code) == reference(r.code) for r in rows)


def test_frames(spark):
    df = spark.createDataFrame([(1, "a/b.py", "x = (", "r:s"), (2, "a.PY", "x = 1", "r:t"), (3, "c.yml", "x = (", "r"), (4, None, "x = (", None), (5, "d.go", None, "r:s"), (6, "e.java", "", None)], "file_id bigint, file_path string, code string, namespace string")
    assert [r.file_id for r in syntax.syntax_errors(df).collect()] == [1]
    rates = {(r.repository, r.language): (r.files, r.invalid_files, r.invalid_rate) for r in syntax.syntax_error_rates(df).collect()}
    assert rates == {("r", "python"): (2, 1, 0.5), ("r", "go"): (1, 0, 0.0), (None, "java"): (1, 0, 0.0)}
    assert syntax.syntax_errors(df.limit(0)).count() == 0


def test_deep_nesting_ends():
    for ext, a, b in (("js", "x = " + "[" * 900, "]" * 900), ("java", "class A { int x = " + "(" * 900 + "1", ")" * 900 + "; }"), ("go", "package a\nvar x = " + "(" * 60_000 + "1", ")" * 60_000), ("py", "x = " + "(" * 60_000, ")" * 60_000)):
        assert syntax.parses(ext, a + b) is (ext != "py")
    long = "a" + " + a" * 60  # a block far behind its head's semicolon
    assert syntax.parses("go", f"package a\nfunc f() {{\n\tif x := b; {long} > 1 {{\n\t}}\n\tfor i := 0; i < {long}; i++ {{\n\t}}\n}}\n")
    assert syntax.parses("js", "x = " + "[" * 30_000 + "]" * 30_000)
