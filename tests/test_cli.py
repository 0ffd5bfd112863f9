import json
import subprocess

import pytest
from codeweft import cli, render
from codeweft.sources import cache, git, ignore, parse

APP = "def load(path):\n    return open(path).read()\n\n\ndef main():\n    return load('a')\n"


@pytest.fixture
def folder(tmp_path):
    def g(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)

    g("init", "-q", "-b", "main")
    (tmp_path / "app.py").write_text(APP)
    (tmp_path / ".gitignore").write_text("*.log\n.codeweft/\n")
    g("add", "-A")
    g("commit", "-qm", "first")
    (tmp_path / "app.py").write_text(APP.replace("load", "read_text") + "\n\ndef late():\n    return main()\n")
    for name, text in {"node_modules/x/a.js": "a()", "dist/b.js": "b()", "note.log": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    g("add", "app.py")
    g("commit", "-qm", "second")
    return str(tmp_path)


def test_commands(spark, folder):
    assert {r.file_path for r in git.source_tree(spark, folder).collect()} == {"app.py"}
    found = cli.run(spark, ["search", "read_text", "--folder", folder, "--format", "json"])
    assert json.loads(found)[0]["path"] == "app.py"
    assert "CALLS" in cli.run(spark, ["neighbors", "main", "--folder", folder]) and "late" in cli.run(spark, ["impact", "read_text", "--folder", folder])
    diff = cli.run(spark, ["diff", "--folder", folder])
    assert "+ function late" in diff and "~ function load -> read_text" in diff
    assert json.loads(cli.run(spark, ["index", "--folder", folder]))["built"] and not json.loads(cli.run(spark, ["index", "--folder", folder]))["built"]
    assert '"symbol_id"' in cli.run(spark, ["snapshot", "symbols", "--folder", folder]) and "codeweft" in cli.run(spark, ["version"]) and "CALLS" in cli.run(spark, ["capabilities"])
    with pytest.raises(SystemExit):
        cli.run(spark, ["search", "the of", "--folder", folder])


def test_cache(spark, tmp_path):
    files = [("r", "a.py", APP), ("r", "b.py", "from a import load\n\n\ndef go():\n    return load('b')\n")]
    df = spark.createDataFrame(files, "repo_key string, file_path string, content string")
    assert cache.tree_key(df) == cache.tree_key(df.orderBy("file_path", ascending=False)) != cache.tree_key(df.limit(1))
    assert cache.cache_key("t", ignore_files=[("a", "b")]) != cache.cache_key("t", ignore_files=[("ab", "")]) != cache.cache_key("t")
    held, there = cache.load_or_build(df, parse.facts, str(tmp_path))
    again, there_now = cache.load_or_build(df, parse.facts, str(tmp_path))
    assert (there, there_now) == (False, True) and again["relations"].count() == held["relations"].count() > 0
    key = cache.cache_key(cache.tree_key(df))
    assert cache.load(spark, str(tmp_path), "other") is None
    (tmp_path / key / "complete" / "_SUCCESS").unlink()
    assert cache.load(spark, str(tmp_path), key) is None  # a build that didn't end
    part = cache.selected(held, spark.createDataFrame([("b.py",)], "file_path string"))
    assert {r.file_path for r in part["symbols"].collect()} == {"b.py"} and not [r for r in part["relations"].collect() if "a.py" in r.to_id]


def test_vendored(spark):
    paths = ["src/a.c", "vendor/x.c", "a/third_party/x.c", "libc/a.c", "lib/libc/a.c", "build/a.c", "dist/b.js", "lib/std/a.c"]
    df = spark.createDataFrame([(p,) for p in paths], "file_path string")
    tracked = spark.createDataFrame([("dist/b.js",)], "file_path string")
    assert {r.file_path for r in ignore.without_vendored(df, tracked).collect()} == {"src/a.c", "libc/a.c", "dist/b.js", "lib/std/a.c"}
    assert {r.file_path for r in ignore.without_vendored(df).collect()} == {"src/a.c", "libc/a.c", "dist/b.js", "lib/std/a.c", "build/a.c"}


def test_texts():
    rows = [{"file_path": "a", "change_kind": "renamed", "kind": "function", "name": "b", "old_name": "a"}, {"file_path": "a", "change_kind": "added", "kind": "class", "name": "C"}]
    assert render.diff_text(rows) == "a\n  ~ function a -> b\n  + class C\n" and "\x1b[32m" in render.diff_text(rows, True) and render.diff_text([]) == "no changes\n"
    assert render.cut_text("one\ntwo\nthree", 9) == "one\n…" and render.cut_text("one", 9) == "one" and render.cut_text("äöü", 5) == "ä…"
    assert render.ranked_budgets(3, 6000) == [3000, 2000, 1000] and render.ranked_budgets(2, 100) == [128, 128] and render.ranked_budgets(0, 9) == []
    assert len(render.fit([{"a": "x" * 90}, {"a": 1}, {"a": 2}], 50)) == 1 and len(render.fit([{"a": 1}, {"a": 2}], 500)) == 2
    many = {"callers": [{"depth": 1, "caller_id": f"id{i}" * 20} for i in range(50)]}
    assert "and 42 more" in render.impact_text(many, 900) and len(render.impact_text(many, 100).encode()) <= 100
    assert "2 definitions" in render.ambiguous_text("x", [{"file_path": "a", "start_line": 1, "endpoint_kind": "f", "endpoint_id": "i"}] * 2)
    assert render.coverage_banner(3, 3, "ok") is None and "1 of 3" in render.coverage_banner(3, 1, "unsafe")
    hits = [{"rank": i, "path": "p", "start_line": 1, "end_line": 2, "score": 1.0, "signal": "text", "snippet": "s" * 200} for i in (1, 2, 3)]
    assert render.search_text(hits).count("sss") > 10 and "3. p" in render.search_text(hits) and len(render.search_agent(hits, 900).encode()) <= 903 and render.search_text([]) == "nothing found\n"
