from codeweft.llm import handwritten

PACKAGE = {f"m{i}.py": f"from .core import thing{i}\n__all__ = ['thing{i}', 'other{i}']\n" for i in range(6)}
DEEP = "/".join("abcdefghijk")


def found(spark, files):
    df = spark.createDataFrame([(n, *f, n) for n, f in enumerate(files)], "file_id long, repo_key string, file_path string, content string, ingested_at long")
    return {r.file_id: r.rule for r in handwritten.not_handwritten(df).collect()}


def test_only_the_tree_decides_short_files(spark):
    ours = [("gh/a/x", f"{DEEP}/pkg/{n}", t) for n, t in PACKAGE.items()]
    theirs = [("gh/b/y", f"lib/{i}.py", "# imported\n" + t) for i, t in enumerate(PACKAGE.values())]
    others = [("gh/b/y", "own.py", "print(1)\n"), ("gh/c/z", "m0.py", PACKAGE["m0.py"]), ("gh/c/z", "m9.py", "print(2)\n"), ("gh/a/x", "p/one.py", "x = 1\n"), ("gh/b/y", "q/one.py", "x = 1\n")]
    assert found(spark, ours + theirs + others) == dict.fromkeys(range(12), "shared_tree")


def test_whole_repository_held_in_a_folder(spark):
    root = [("gh/a/x", n, t) for n, t in PACKAGE.items()]
    copy = [("gh/b/y", f"pkg/{n}", t) for n, t in PACKAGE.items()] + [("gh/b/y", "own.py", "print(1)\n")]
    assert found(spark, root + copy) == dict.fromkeys(range(12), "shared_tree")


def test_forks_and_changed_trees_are_no_case(spark):
    fork = [("gh/a/x", f"p/{n}", t) for n, t in PACKAGE.items()] + [("gh/b/x", f"p/{n}", t) for n, t in PACKAGE.items()]
    changed = [("gh/c/z", f"p/{n}", t + "own = 1\n" * (n == "m0.py")) for n, t in PACKAGE.items()]
    assert found(spark, fork + changed) == {}


def test_data_files_are_part_of_trees_but_no_case(spark):
    data = '{"names": [' + ", ".join(f'"name{i}"' for i in range(40)) + "]}"
    tree = {"a.py": "from . import b\n", "names.json": data}
    ours, theirs = [("gh/a/x", f"p/{n}", t) for n, t in tree.items()], [("gh/b/y", f"q/r/{n}", t) for n, t in tree.items()]
    own = [("gh/b/y", "own.py", "print(1)\n"), ("gh/a/x", "own.py", "print(2)\n")]
    assert found(spark, ours + theirs + own) == {0: "shared_tree", 2: "shared_tree"}
    other = [("gh/c/z", "s/a.py", tree["a.py"]), ("gh/c/z", "s/names.json", data.replace("name7", "name8"))]
    assert found(spark, ours + other) == {}


def test_the_tree_comes_before_what_a_file_shows_alone(spark):
    header = "// Code generated by tool. DO NOT EDIT.\n"
    files = [(r, f"{d}/{n}.go", header + f"package p\n\nfunc F{n}() string {{ return \"{'x' * 150}\" }}\n") for r, d in (("gh/a/x", "p"), ("gh/b/y", "q")) for n in "ab"]
    own = [(r, "own.go", f"package {r[-1]}\n") for r in ("gh/a/x", "gh/b/y")]
    assert found(spark, files + own + [("gh/c/z", "g.go", header + "package g\n")]) == {**dict.fromkeys(range(4), "shared_tree"), 6: "generated_header"}
