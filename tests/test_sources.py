import json
import subprocess

from codeweft.operators import relations
from codeweft.sources import git, ignore, parse, records
from codeweft.streaming.relations import counts_stream, distinct_stream

FILES = [
    ("r", "pkg/util.py", "def helper(x):\n    return x\n\n\nclass Base:\n    def run(self):\n        return helper(1)\n"),
    ("r", "pkg/app.py", "from pkg.util import helper, Base\n\n\nclass App(Base):\n    def run(self):\n        return self.go()\n\n    def go(self):\n        return helper(2)\n\n\ndef test_helper():\n    helper(3)\n"),
    ("r", "src/a.ts", "import { b } from './b';\nexport interface I { x: number }\nexport class A implements I {\n  go(v: I): I {\n    bus.emit('done');\n    return b(v);\n  }\n}\nfunction handler() { return 1; }\napp.get('/items', handler);\nfunction load() { return fetch('/items'); }\n"),
    ("r", "src/b.ts", "export function b(v: string) {\n  // b(not a call)\n  return 'b(';\n}\n"),
    ("r", "m.go", "package m\n\ntype T struct{}\n\nfunc (t *T) Do() int {\n\treturn two()\n}\n\nfunc two() int { return 2 }\n"),
    ("r", "bad.py", "def f(:\n"),
    ("r", "x.xyz", "?"),
    (None, "x.py", "a = 1"),
]
FILE = "repo_key string, file_path string, content string"


def test_symbols_and_relations(spark):
    facts = parse.facts(spark.createDataFrame(FILES, FILE)).cache()
    found = relations.symbols(facts)
    ids = {r.symbol_id for r in found.collect()}
    assert {"r:Python:pkg/util.py:method:Base.run", "r:Go:m.go:method:T.Do", "r:TypeScript:src/a.ts:method:A.go", "r:TypeScript:src/b.ts:function:b"} <= ids
    edges = {(r.relation, r.from_id.split(":")[-1], r.to_id.split(":")[-1]) for r in relations.code_graph(facts).collect()}
    assert {
        ("CALLS", "Base.run", "helper"), ("CALLS", "App.go", "helper"), ("CALLS", "App.run", "App.go"), ("CALLS", "A.go", "b"), ("CALLS", "T.Do", "two"), ("CALLS", "load", "handler"),
        ("EXTENDS", "App", "Base"), ("INHERITS", "App", "Base"), ("IMPLEMENTS", "A", "I"), ("OVERRIDES", "App.run", "Base.run"), ("PARAM_TYPE", "A.go", "I"), ("RETURNS_TYPE", "A.go", "I"),
        ("USES_TYPE", "A.go", "I"), ("IMPORTS", "src/a.ts", "src/b.ts"), ("IMPORTS", "pkg/app.py", "pkg/util.py"), ("EMITS", "A.go", "done"), ("HANDLES_ROUTE", "handler", "/items"),
        ("HTTP_CALLS", "load", "/items"), ("CONTAINS", "Base", "Base.run"), ("DEFINES", "m.go", "T"),
    } <= edges
    assert not any(a == b for r, a, b in edges if r == "CALLS")
    assert {r.relation for r in relations.code_graph(facts, "syntax-only").select("relation").distinct().collect()} == {"DEFINES", "CONTAINS"}
    assert {(r.file_path, r.kind) for r in facts.where("fact = 'failure'").collect()} == {("bad.py", "E_PARSE_ERROR"), ("x.xyz", "E_UNSUPPORTED_LANGUAGE")}
    lines = [r.value for r in records.record_lines(facts, found, relations.code_graph(facts, "syntax-only")).orderBy("section", "key").collect()]
    head = json.loads(lines[0])
    assert head["stats"] == {"files": 7, "parsed_files": 5, "symbols": len(ids), "relations": sum(head["completeness"]["relations"].values()), "partial_failures": 1, "completeness_level": "degraded"}
    assert head["completeness"]["languages"]["Go"] == {"files": 1, "symbols": 3} and {w["code"] for w in head["warnings"]} == {"E_PARSE_ERROR", "E_UNSUPPORTED_LANGUAGE"} and head["languages"] == ["Go", "Python", "TypeScript"]
    assert "schema_version" in head and '"summary"' in lines[-1] and sum('"record_type":"symbol"' in x for x in lines) == len(ids)


def test_equal_ids_get_signatures(spark):
    text = "class A { void f(int a) { } void f(String a) { } }\n"
    ids = [r.symbol_id for r in relations.symbols(parse.facts(spark.createDataFrame([("r", "A.java", "class A {\n  void f(int a) {\n  }\n  void f(String a) {\n  }\n}\n")], FILE))).where("name = 'f'").collect()]
    assert len(set(ids)) == 2 and all("#sig:" in i for i in ids) and text


def test_ignore_rules(spark):
    rules = ["*.log", "!keep.log", "/build/", "docs/**/*.tmp", "# note", ""]
    r = ignore.IgnoreRules(rules)
    assert r.ignored("a/b.log") and not r.ignored("a/keep.log") and r.ignored("build/x.py") and not r.ignored("a/build/x.py") and r.ignored("docs/a/b.tmp") and not r.ignored("docs.tmp")
    df = spark.createDataFrame([("a.log",), ("a.py",), (None,)], "p string")
    assert [x.i for x in df.select(ignore.is_ignored(df.p, rules).alias("i")).collect()] == [True, False, False]


def test_git_repository(spark, tmp_path):
    def g(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)

    g("init", "-q", "-b", "main")
    (tmp_path / "a b.txt").write_text("one\ntwo\nthree\n")
    (tmp_path / "c.bin").write_bytes(b"\0x")
    g("add", "-A")
    g("commit", "-qm", "first")
    g("mv", "a b.txt", "d.txt")
    g("commit", "-qm", "second\n\nRef: 77")
    repo = str(tmp_path)
    assert {r.file_path for r in git.list_tree(spark, repo, "HEAD~1").collect()} == {"a b.txt", "c.bin"}
    paths = spark.createDataFrame([("a b.txt",), ("none",), ("c.bin",), (None,)], "file_path string")
    assert {r.file_path: r.content for r in git.read_blobs(paths, repo, git.first_parent(repo, "HEAD")).collect()} == {"a b.txt": "one\ntwo\nthree\n", "none": None, "c.bin": None, None: None}
    assert [tuple(r) for r in git.changed_files(spark, repo, "HEAD~1", "HEAD").collect()] == [("R", "d.txt", "a b.txt")]
    assert git.find_commit(repo, "Ref", "77") == git.rev_parse(repo, "HEAD")
    assert {r.file_path for r in git.history(spark, repo).collect()} == {"a b.txt", "c.bin", "d.txt"}
    assert {r.file_path for r in git.list_index(spark, repo).collect()} == {"d.txt", "c.bin"}


def test_relation_stream(spark, tmp_path):
    rows = spark.sql("SELECT 'r' AS repo_key, 'a' AS from_id, 'b' AS to_id, 'CALLS' AS relation, timestamp'2024-01-01 01:00:00' AS emitted_at UNION ALL SELECT 'r', 'a', 'b', 'CALLS', timestamp'2024-01-01 01:00:00'")
    rows.write.parquet(str(tmp_path / "in"))
    assert [r.n_edges for r in counts_stream(rows).collect()] == [2]
    stream = distinct_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("seen").count() == 1
