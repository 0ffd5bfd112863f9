import itertools
import random

import pytest
from codeweft.llm import cooccur, mixing

MEMBER = "space string, basket string, item string, n_both int"


def test_cooccurrence_against_brute_force(spark):
    rng = random.Random(4)
    rows = [("r", f"c{i}", "hub", 0) for i in range(120)]  # one item in every basket
    rows += [("r", f"c{rng.randrange(120)}", f"p{rng.randrange(12)}", 0) for _ in range(600)]
    rows += [("r", "huge", f"q{i}", 0) for i in range(51)] + [("r", "c1", None, 0), (None, "c1", "x", 0), ("r", None, "x", 0)]
    got = {(x.left_item, x.right_item): x for x in cooccur.cooccurrence(spark.createDataFrame(rows, MEMBER)).collect()}
    baskets = {}
    for s, b, i, _ in rows:
        if s and b and i:
            baskets.setdefault(b, set()).add(i)
    baskets = [b for b in baskets.values() if len(b) <= 50]
    pairs = {}
    for b in baskets:
        for p in itertools.combinations(sorted(b), 2):
            pairs[p] = pairs.get(p, 0) + 1
    assert {p: x.n_both for p, x in got.items()} == pairs
    x = got["hub", "p1"]
    assert x.n_baskets == len(baskets) == 120 and x.n_left == 120 and abs(x.llr) < 1e-9 and abs(x.lift - 1) < 1e-12
    strong = {(r.left_item, r.right_item) for r in cooccur.strong_pairs(cooccur.cooccurrence(spark.createDataFrame(rows, MEMBER)), 2, 1).collect()}
    single = {i: sum(i in b for b in baskets) for i in {i for b in baskets for i in b}}
    assert strong == {p for p, c in pairs.items() if c >= 2 and c * 120 >= single[p[0]] * single[p[1]]}


def test_cooccurrence_empty_and_paths(spark):
    empty = spark.createDataFrame([], MEMBER)
    assert cooccur.cooccurrence(empty).count() == 0
    paths = spark.createDataFrame([("./a//b",), ("/a/b",), ("././a/b",), ("/",), (None,)], "p string").select(cooccur.clean_path("p").alias("p"))
    assert [r.p for r in paths.collect()] == ["a/b", "a/b", "a/b", None, None]


DOCS = "doc_id long, source string, text string, n_tokens int"


def test_mix_reaches_shares(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["Web", " web", "we-b"][:2]), "word " * rng.randrange(1, 60), 0) for i in range(900)]
    rows += [(1000 + i, "Small_Src", "some words here " * rng.randrange(1, 9), 0) for i in range(40)]
    rows += [(2000, None, "x", 0), (2001, "web", None, 0), (2002, "web", "", 0), (2003, "other", "x y", 0), (None, "web", "a null id", 0)]
    targets = spark.createDataFrame([("web", 0.6, 1), ("small-src", 0.3, 3), ("absent", 0.1, 2), (None, 0.5, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(spark.createDataFrame(rows, DOCS), targets)
    copies = mixed.collect()
    assert all(r.copies <= (1 if r.source == "web" else 3) for r in copies) and {r.source for r in copies} == {"web", "small_src"}
    report = {r.source: r for r in mixing.mix_report(mixed, targets).collect()}
    assert report["absent"].actual_share == 0 and report["web"].actual_share == pytest.approx(2 / 3, abs=0.01) and report["small_src"].actual_share == pytest.approx(1 / 3, abs=0.01)


def test_mix_empty(spark):
    targets = spark.createDataFrame([("web", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mix(spark.createDataFrame([], DOCS), targets).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, "web", "a b", 0)], DOCS), targets.limit(0)).count() == 0
