import pytest
from codeweft.llm import handwritten, syntax
from codeweft.llm.languages import LANGUAGES

GOOD = {
    "Python": "import a.b as c\n\n\nclass A(B, metaclass=M):\n    \"\"\"Doc.\"\"\"\n    x: int = 1\n\n    async def f(self, *a, k=2, **kw) -> list[int]:\n        if (n := len(a)) > 1 and not k:\n            return [i for i in a if i]\n        elif n: pass\n        else:\n            raise ValueError(f\"{n}\") from None\n        try:\n            with open(x) as h, y: h.read()\n        except (A, B) as e:\n            yield lambda z, *w: z ** -1\n        finally:\n            del x[1:2, ...]\n",
    "Go": "package p\n\nimport (\n\t\"a\"\n\tb \"c/d\"\n)\n\ntype T[K comparable, V any] struct {\n\tA, B int `tag`\n\t*E\n}\n\nfunc (t *T[K, V]) F(xs ...int) (n int, err error) {\n\tif x, ok := t.m[1]; !ok && x == (T{}) {\n\t\treturn\n\t}\n\tfor i := range xs {\n\t\tgo func(c <-chan int) { c2 <- <-c }(ch)\n\t\t_ = i\n\t}\n\tswitch y := v.(type) {\n\tcase int, string:\n\t\tfallthrough\n\tdefault:\n\t\tn++\n\t}\n\treturn map[string][]int{\"a\": {1, 2}}[\"a\"][0], nil\n}\n",
    "JavaScript": "import d, { a as b } from './x.js';\nexport default class A extends B {\n  #p = 1;\n  static async *gen(x = 1, ...r) { for await (const y of r) yield y; }\n  get v() { return this.#p ?? 0 }\n}\nconst f = async ({ a, b: [c] }, d) => ({ ...a, [d]: `t${c ? `in${d}` : ''}` })\nlabel: for (let i = 0, j; i < 3; i++) { if (/[/]x/g.test(s)) continue label; else break }\nexport { f as g };\n",
    "TypeScript": "import { a, type B } from './x';\nexport type U<T> = { kind: 'a'; n?: number } | readonly T[] | ((x: T) => void);\nabstract class A<T extends object = {}> implements I, J {\n  private readonly m: Map<string, number[]> = new Map<string, number[]>();\n  constructor(public x: number, protected y?: string) { super(); }\n  abstract f(a: T): a is B;\n  static g = <T,>(v: T): T => v as T;\n}\nexport enum E { A = 1, B }\ndeclare const z: unique;\nlet q = x! satisfies Y;\n",
    "Java": "package a.b;\n\nimport java.util.*;\n\n@Ann(x = 1)\npublic final class A<T extends B & C> extends D<T> implements E {\n    private final Map<String, List<? super T>> m = new HashMap<>();\n    A(int... x) throws F { this.m = x; }\n    <R> R f(final T t) {\n        for (Map.Entry<String, Integer> e : m.entrySet()) if (e.getValue() > 1) continue;\n        try (var r = open()) { int[] a = {1, 2}; a[0] += (int) x >> 2; } catch (G | H e) { throw new R(\"s\", e); } finally { }\n        return switch (t) { case 1, 2 -> 'c'; default -> { yield x -> y::z; } };\n    }\n    enum K { P, Q { } ; }\n    record R(int a, String b) { }\n}\n",
    "Rust": "use std::{fmt, collections::HashMap as M};\n\n#[derive(Debug)]\npub struct A<'a, T: Clone + 'a> where T: Copy { pub x: &'a [T], y: Option<Box<dyn Fn(i32) -> i32>> }\n\nimpl<'a, T: Clone> A<'a, T> {\n    pub fn f(&mut self, n: usize) -> Result<(), String> {\n        let v = vec![1, 2]; let s = A { x: &v, ..d };\n        match n { 0 | 1 => Err(format!(\"{}\", n))?, n if n > 2 => { return Ok(()) } _ => v.iter().map(|x| x + 1).collect::<Vec<_>>(), }\n        if let Some(ref x) = self.y && n == 1 { loop { break } } else { 'o: while true { continue 'o; } }\n        for i in 0..=n { self.x[i] }\n        Ok(())\n    }\n}\n",
    "C": "#include <a.h>\n#define M(x) \\\n  (x)\n\ntypedef struct s { int a : 3; const char *b[2]; } s_t;\nstatic int (*fp)(int, char *) = 0;\nenum e { A = 1, B };\n\nint f(const s_t *p, size_t n)\n{\n    size_t i;\n    for (i = 0; i < n && p->a; i++) {\n        switch (p[i].a) { case 1: return sizeof(int) * -1; default: break; }\n    }\n    do { x = (int)y ? *p++ : ~z; } while (0);\n    goto out;\nout:\n    return 0;\n}\n",
    "JSON": '{"a": [1, -2.5e3, true, null, {"b": "\\u00e9"}], "c": {}}\n',
    "TOML": "a = 1\n\"b\".c = [1,\n  2, # x\n]\n[t.u]\nd = 1979-05-27T07:32:00Z\n[[v]]\nf = { g = 'h', i = -1.5e3 }\n",
}


def judge(language, text):
    lexer = syntax.Lexer(LANGUAGES[language])
    lines = lexer.lines(text)
    depth = 0
    for line in lines:
        net, low = lexer.nesting(line)
        if depth + low < 0:
            return False
        depth += net
    return depth == 0 and LANGUAGES[language].grammar.recogniser()("".join(lines))


@pytest.mark.parametrize("language", GOOD)
def test_grammars_accept_valid_code(language):
    assert judge(language, GOOD[language])


@pytest.mark.parametrize("language", GOOD)
def test_pairs_hold_in_valid_code(language):
    lexer = syntax.Lexer(LANGUAGES[language])
    tokens = [syntax._plain(c) for c in "".join(lexer.lines(GOOD[language]))]
    missing = [(a, b) for a, b in zip(tokens, tokens[1:]) if (a, b) not in LANGUAGES[language].grammar.pairs]
    assert not missing


@pytest.mark.parametrize("language", GOOD)
def test_grammars_refuse_damage(language):
    text = GOOD[language]
    assert not judge(language, text[: int(len(text) * 0.7)]) or language == "TOML"
    lines = text.split("\n")
    half = len(lines) // 2
    conflict = [*lines[:half], "<<<<<<< HEAD", lines[half], "=======", lines[half], ">>>>>>> other", *lines[half + 1 :]]
    assert not judge(language, "\n".join(conflict))
    assert not judge(language, "<!doctype html>\n<html><body><p>not found here.</p></body></html>\n")


@pytest.mark.parametrize("language", ["JavaScript", "TypeScript"])
def test_a_script_statement_is_no_object(language):
    assert not judge(language, '{\n  "a": 1,\n  "b": [true]\n}\n') and not judge(language, '{ "a": 1 }')
    for text in ("[1, 2]\n", "{ a: 1 }\n", "{}\n", "({ \"a\": 1 })\n", "x = { \"a\": 1 }\n", "export default { \"a\": 1 }\n", "f(() => ({ a }))\n", "{ f(); }\n[1].map(g)\n"):
        assert judge(language, text), text


FILE = "file_id long, repo_key string, file_path string, content string, ingested_at int, language string, code string"


def rows(spark, *files):
    return spark.createDataFrame([(*f, 1, "x", "y") for f in files], FILE)


def test_parse_status(spark):
    files = [(n, "g/o/r", f"src/f{n}.{e}", GOOD[k]) for n, (k, e) in enumerate([("Python", "py"), ("Go", "go"), ("JavaScript", "mjs"), ("TypeScript", "mts"), ("Java", "java"), ("Rust", "rs"), ("C", "c"), ("JSON", "json"), ("TOML", "toml")])]
    files += [
        (20, "r", "a.py", "def f(:\n  pass\n"), (21, "r", "a.go", "func f() {}\n"), (22, "r", "a.json", ""), (23, "r", "a.py", ""), (24, "r", "a.md", "# ("), (25, "r", "a.toml", "a = 1\na = 2\n"),
        (26, "r", "a.ts", "export const x = {\n"), (27, "r", "a.java", GOOD["Go"]), (28, "r", "a.txt", "((("), (29, None, "a.c", "int x = ;\n"), (30, "r", None, "("), (None, "r", "a.py", "("), (31, "r", "a.py", None),
        (32, "r", "a.py", "if x:\ny\n"), (33, "r", "a.py", "if x:\n    y\n  z\n"), (34, "r", "a.rs", "fn f() { let x = ; }\n"), (20, "r", "a.py", "def f(:\n  pass\n"),
    ]
    df = rows(spark, *files)
    status = {r.file_id: (r.language, r.code) for r in syntax.parse_status(df).collect()}
    assert set(status) == {20, 21, 22, 25, 26, 27, 29, 32, 33, 34}
    assert status[21] == ("Go", "E_ORDER") and status[26] == ("TypeScript", "E_NESTING")
    rates = {(r.repo_key, r.language): (r.n_files, r.n_broken) for r in syntax.broken_rates(df, syntax.parse_status(df)).collect()}
    assert rates["r", "Python"] == (4, 3) and rates[None, "C"] == (1, 1) and rates["r", "Markdown"] == (1, 0)
    assert syntax.parse_status(df.limit(0)).count() == 0


GETTERS = "package xpb\n\ntype X struct{}\n\n" + "".join(f"func (x *X) GetA{i}() string {{\n\tif x != nil {{\n\t\treturn x.a{i}\n\t}}\n\treturn \"\"\n}}\n\n" for i in range(8))


@pytest.mark.parametrize(
    ("path", "text", "rule"),
    [
        ("a.go", "// Code generated by tool. DO NOT EDIT.\npackage a\n", "generated_header"),
        ("a.py", "x = 1\n'''<auto-generated> tool </auto-generated>'''\n", "generated_header"),
        ("a.py", 'BANNER = "// Code generated by %s. DO NOT EDIT."\nx = 1\n', None),
        ("a.js", "// Copied from lib 1.2; fix bugs upstream, not here.\nfoo();\n", "vendored_header"),
        ("a.js", "/* lib 1.2 - (c) the lib authors, see LIB-LICENSE */\nfoo();\n", "vendored_header"),
        ("a.js", "// Copyright the own authors. See LICENSE.\nfoo();\n", None),
        ("src/vendor/lib/a.js", "foo();\n", "vendored_folder"),
        ("src/vendors/a.js", "foo();\n", None),
        ("vendor/lib/a.json", "{}", None),
        ("a.go", GETTERS, "generated_layout"),
        ("a.min.js", "var a=1;", "generated_name"),
        ("a.js", "!function(e,t){" + "var f=function(a){return a?a.b:null};e.q=(a,b)=>a.j>b?a.p:[b,757];" * 20 + "}(this);", "minified"),
        ("a.py", "data = [\n" + "  0x12, 0x34, 0x56, 0x78,\n" * 40 + "]\n", "data"),
        ("a.py", "import os\n\ndef f(a, b, c):\n    for item in table:\n        if item.x > a and item.y < b:\n            yield os.path.join(c, item)\n\ntable = [" + "12, " * 100 + "]\n", None),
        ("a.py", "", None),
    ],
)
def test_rules(path, text, rule):
    assert handwritten.squeezed_or_written(path, text, "gh/me/own") == rule


def test_shared_code_and_trees(spark):
    code = "def work(a, b):\n    return a + b  # {}\n" * 12
    files = [
        (1, "gh/a/x", "lib/one/m.py", code.format(*"abcdefghijkl")), (2, "gh/b/y", "other/q.py", "# ours\n" + code.format(*"abcdefghijkl")), (3, "gh/a/z", "k.py", "own = 1\n" * 40),
        (4, "gh/a/x2", "k.py", "own = 1\n" * 40), (5, "gh/b/y", "e/__init__.py", ""), (6, "gh/a/x", "e/__init__.py", ""), (7, None, "n.py", code), (8, "gh/c/w", "d.json", code), (None, "gh/c/w", "d.py", code),
    ]
    df = rows(spark, *files, files[0]).withColumnRenamed("language", "rule")
    assert {r.file_id for r in handwritten.not_handwritten(df, depth=3).collect()} == {1, 2}
    assert handwritten.not_handwritten(df.limit(0), depth=2).count() == 0
