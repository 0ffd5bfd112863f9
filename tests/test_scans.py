import pytest
from codeweft.operators import reports, scans
from codeweft.sources import parse
from pyspark.sql import functions as F

FILE = "file_id long, file_path string, content string"


def test_greps(spark):
    files = spark.createDataFrame([(1, "a.py", "x = 1\nTODO one\nTODO two\nTODO three"), (2, "b.bin", "TODO\0"), (3, "c.py", ""), (4, None, None)], FILE)
    assert {(r.file_id, r.line) for r in scans.grep_lines(files, ["TODO"], 2).collect()} == {(1, 2), (1, 3)}
    assert scans.grep_lines(files, []).count() == 0 and scans.grep_lines(files.limit(0), ["x"]).count() == 0
    assert {r.file_id for r in scans.grep_paths(files, ["todo"]).collect()} == {1}
    assert {r.file_id for r in scans.grep_paths(files, ["TODO"], ignore_case=False, binary=True).collect()} == {1, 2} and scans.grep_paths(files, []).count() == 0
    tracked = spark.createDataFrame([("a.py",), ("a.py",)], "file_path string")
    assert {r.file_id for r in scans.allowed(files, tracked).collect()} == {1} and {r.file_id for r in scans.untracked(files, tracked).collect()} == {2, 3, 4}


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("left", "right", "n", "mirror"),
    [("src/a/b.js", "dist/a/b.js", 2, True), ("packages/x/src/b.js", "packages/y/dist/b.js", 1, False), ("a/b.js", "c/b.js", 1, False), ("b.js", "b.js", 1, False), ("src/b.js", "lib/b.js", 1, True), ("src/b.js", "lib/c.js", 0, False)],
)
def test_mirrors(spark, left, right, n, mirror):
    assert one(spark, scans.common_suffix(F.lit(left), F.lit(right))) == n and one(spark, scans.mirror_pair(F.lit(left), F.lit(right))) is mirror


def test_predicates(spark):
    for text, want in {"import { a } from 'b'": True, "  export { x }": True, "important": False, "": False}.items():
        assert one(spark, scans.is_import_line(F.lit(text))) is want
    for text, want in {"fooBar": True, "foo_bar": True, "foobar": False, "aB": False, "FOO_BAR": True, "a b c d": False}.items():
        assert one(spark, scans.is_compound(F.lit(text))) is want
    assert one(spark, scans.holds_identifier(F.lit("call foo.bar(x)"), F.lit("bar"))) and not one(spark, scans.holds_identifier(F.lit("foobar"), F.lit("bar")))
    assert one(spark, scans.plain_type(F.lit("Map<String, List<int[]>>"))) == "Map" and one(spark, scans.type_names(F.lit("Map<String, T> foo(List x)"))) == ["Map", "String", "List"]
    assert one(spark, scans.append_unique(F.array(F.lit("b"), F.lit("")), F.array(F.lit("a"), F.lit("b")))) == ["b", "a"]
    empty = F.array().cast("array<string>")
    assert one(spark, scans.labels_meet(empty, empty)) and not one(spark, scans.labels_meet(empty, F.array(F.lit("a"))))
    assert one(spark, scans.terms_in(F.lit("A cache"), ["x", "CACHE"])) == ["CACHE"] and one(spark, scans.terms_in(F.lit(None).cast("string"), ["x"])) == []


@pytest.mark.parametrize(("counts", "level"), [((0, 0, 0, 0), "ok"), ((0, 100, 100, 4000), "ok"), ((0, 3, 3, 0), "degraded"), ((0, 100, 30, 500), "unsafe"), ((2, 100, 98, 4000), "degraded"), ((30, 100, 70, 500), "unsafe")])
def test_completeness(spark, counts, level):
    assert one(spark, reports.completeness_level(*map(F.lit, counts))) == level


def test_scaled(spark):
    for given, want in {(3, 10, 4): 8, (0, 10, 4): 0, (3, 4, 10): 3, (2**62, 100, 1): 2**63 - 1, (3, 10, 0): 3}.items():
        assert one(spark, reports.scaled(*[F.lit(x).cast("bigint") for x in given])) == want


def test_routing():
    assert parse.language_of("a/Dockerfile") == "Dockerfile" and parse.language_of("Dockerfile.dev") == "Dockerfile" and parse.language_of("run", "#!/usr/bin/env python3\n") == "Python"
    assert parse.language_of("run", "#!/bin/bash\n") == "Shell" and parse.language_of("run", "text") is None and parse.language_of("x.xyz", "#!/bin/sh\n") is None
    for path, text, out in [
        ("a_linux.go", "package a\n", False), ("a_windows.go", "package a\n", True), ("a_arm64.go", "package a\n", True), ("a_linux_amd64_test.go", "package a\n", False), ("linux.go", "package a\n", False),
        ("a.go", "//go:build windows || (linux && !cgo)\n\npackage a\n", False), ("a.go", "//go:build !unix\n\npackage a\n", True), ("a.go", "//go:build ignore\n\npackage a\n", True), ("a.go", "package a\n\n//go:build ignore\n", False),
    ]:
        assert parse.go_constrained(path, text) is out, (path, text)
    assert parse.route_of("web/src/app/api/internal/mail/tick/route.ts") == ("/api/internal/mail/tick", "mail") and parse.route_of("src/app/pets/route.ts") == ("/pets", None) and parse.route_of("src/app/pets/page.ts") is None
