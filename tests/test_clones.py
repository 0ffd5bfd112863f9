import random

from codeweft.operators import relations, similarity
from codeweft.plans import text_queries
from codeweft.sources import parse

CLONE = "def {}(rows, limit):\n    kept = []\n    for row in rows:\n        if row.size > limit and row.kind != limit:\n            kept.append(row.name + row.kind)\n    return sorted(kept)\n"
ODD = "\n\n\ndef {0}(x):\n    return [{0}.a * 2, x.{0} - 1, ({0}, x), {{x: {0}}}, x[{0}] ** 3, not x, x or {0}, lambda q: q % x]\n" * 6
GO_CLONE = """func {0}({1} []int, {2} int) (int, error) {{
	{3} := 0
	for _, item := range {1} {{
		if item < 0 || item > {2} {{
			return 0, fmt.Errorf("item %d is outside of %d", item, {2})
		}}
		{3} += item * 2
		if {3} > 1000 {{
			break
		}}
	}}
	return {3}, nil
}}
"""
GO = "package clones\n\nimport \"fmt\"\n\n" + GO_CLONE.format("addItems", "items", "top", "sum") + "\n" + GO_CLONE.format("countItems", "items", "top", "sum")


def test_function_clones_in_other_files_and_the_same_file(spark, tmp_path):
    rows = [
        (1, "gh/a/x", "a.py", CLONE.format("pick") + ODD.format("alpha") + "\n\n" + CLONE.format("choose"), 1),
        (2, "gh/b/y", "b.py", ODD.format("omega").replace("* 2", "// 9").replace("**", "@") + "\n\n" + CLONE.format("take"), 1),
        (3, None, "c.py", "class A:\n" + "".join("    " + x + "\n" for x in CLONE.format("m").split("\n")), 1),
    ]
    spark.createDataFrame(rows, "file_id long, repo_key string, file_path string, content string, ingested_at long").write.parquet(f"{tmp_path}/source_files.parquet")
    pairs = {(r.from_id.split(":")[-1], r.to_id.split(":")[-1]) for r in text_queries.near_clones(spark, str(tmp_path)).collect()}
    linked = {frozenset(p) for p in pairs if set(p) <= {"pick", "choose", "take", "A.m"}}
    reached = {"pick"}
    while more := {x for p in linked if p & reached for x in p} - reached:
        reached |= more
    assert reached == {"pick", "choose", "take", "A.m"}


def test_graph_links_clones_within_a_repository(spark):
    files = [("local/a", "clones.go", GO), ("other/repo", "clones.go", GO)]
    facts = parse.facts(spark.createDataFrame(files, "repo_key string, file_path string, content string"))
    edges = {(r.from_id, r.to_id) for r in relations.code_graph(facts).where("relation = 'SIMILAR_TO'").collect()}
    assert edges == {(f"{r}:Go:clones.go:function:addItems", f"{r}:Go:clones.go:function:countItems") for r in ("local/a", "other/repo")}


def test_pairs_equal_brute_force_in_cells(spark, monkeypatch):
    rng = random.Random(4)
    base = [rng.randrange(2**40) for _ in range(64)]
    rows = [(f"s{n:02}", [x if rng.random() > 0.12 else rng.randrange(2**40) for x in base], "ab"[n % 2]) for n in range(40)]
    monkeypatch.setattr(similarity, "CELL", 7)
    for within in ([], ["repo"]):
        got = [(r.from_id, r.to_id, r.confidence) for r in similarity.similar_pairs(spark.createDataFrame(rows, "symbol_id string, lanes array<bigint>, repo string"), within=within).collect()]
        same = {(a, b): sum(x == y for x, y in zip(la, lb)) / 64 for a, la, ra in rows for b, lb, rb in rows if a < b and (not within or ra == rb)}
        assert sorted(got) == sorted((*p, int(s * 100 + 0.5) / 100) for p, s in same.items() if s >= 0.82) and len(got) > 10


def test_large_and_small_groups_equal_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    bases = [[rng.randrange(-(2**63), 2**63) for _ in range(64)] for _ in range(3)]
    rows = [(f"é{n}" if n % 5 == 0 else f"s{n}", [x if rng.random() > 0.09 else rng.randrange(2**40) for x in bases[n % 3]], "ab"[n % 2]) for n in range(90)]
    same = {(a, b): sum(x == y for x, y in zip(la, lb)) / 64 for a, la, ra in rows for b, lb, rb in rows if a < b and ra == rb}
    want = sorted((*p, int(s * 100 + 0.5) / 100) for p, s in same.items() if s >= 0.82)
    df = spark.createDataFrame(rows, "symbol_id string, lanes array<bigint>, repo string")
    for few, tile, cell in ((0, 4, 4096), (0, 3, 11), (4096, 512, 4096)):
        for name, value in (("FEW", few), ("TILE", tile), ("CELL", cell), ("OUT", 50)):
            monkeypatch.setattr(similarity, name, value)
        got = similarity.similar_pairs(df, within=["repo"])
        assert sorted((r.from_id, r.to_id, r.confidence) for r in got.collect()) == want and len(want) > 100
        assert "FlatMapGroupsInArrow" not in got._jdf.queryExecution().toString()  # one call for many groups
