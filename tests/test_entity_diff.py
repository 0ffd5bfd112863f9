import itertools
import random

from codeweft.operators import entity_diff
from codeweft.sources import parse

ENTITY = "id string, pos int, file_path string, kind string, name string, signature string, body_hash string, fingerprint string"
FILE = "repo_key string, file_path string, content string"


def changes(spark, before, after):
    rows = entity_diff.compare(spark.createDataFrame(before, ENTITY), spark.createDataFrame(after, ENTITY)).collect()
    return {(r.change_kind, r.before_id, r.after_id) for r in rows}


def test_the_loser_of_a_rename_is_offered_its_second_choice(spark):
    words = "a b c d e f g h i j k l m n o p q r s t u v w x y"
    before = [("b1", 1, "f", "function", "one", words, "h1", None), ("b2", 2, "f", "function", "two", words + " z", "h2", None)]
    after = [("a1", 1, "f", "function", "uno", words, "h3", None), ("a2", 2, "f", "function", "due", words + " z 0", "h4", None)]
    # both like a1 or a2 well enough; b1 takes a1, so b2 is left with a2
    assert changes(spark, before, after) == {("renamed", "b1", "a1"), ("renamed", "b2", "a2")}
    assert changes(spark, before, after[:1]) == {("renamed", "b1", "a1"), ("removed", "b2", None)}
    assert changes(spark, before[:0], after[:0]) == set()


def test_pairs_against_brute_force(spark):
    rng = random.Random(5)
    side = lambda s: [(f"{s}{i}", i, rng.choice("fg"), "function", rng.choice("xy"), rng.choice(["s1", "s2"]), rng.choice(["h1", "h2", None]), rng.choice(["p1", None])) for i in range(30)]
    before, after = side("b"), side("a")
    pairs = {(r.before_id, r.after_id) for r in entity_diff.pair_entities(spark.createDataFrame(before, ENTITY), spark.createDataFrame(after, ENTITY)).collect()}
    facts = {"signature": 5, "body_hash": 6, "fingerprint": 7}
    tiers = [(["signature", "body_hash", "fingerprint"], False, ["body_hash", "fingerprint"]), (["signature", "body_hash"], False, ["body_hash"]), (["signature", "fingerprint"], False, ["fingerprint"]), (["signature"], False, [])]
    tiers += [(["body_hash", "fingerprint"], True, ["body_hash", "fingerprint"]), (["fingerprint"], True, ["fingerprint"]), (["body_hash"], True, ["body_hash"]), ([], False, [])]
    want = set()
    for by, unique, needs in tiers:
        used_b, used_a = {b for b, _ in want}, {a for _, a in want}
        key = lambda e: (e[2], e[4], *(e[facts[c]] for c in by))  # noqa: E731, B023
        groups = [{}, {}]
        for g, rows, used in ((groups[0], before, used_b), (groups[1], after, used_a)):
            for e in rows:
                if e[0] not in used and all(e[facts[c]] for c in needs):
                    g.setdefault(key(e), []).append(e[0])
        for k in groups[0].keys() & groups[1].keys():
            if not unique or len(groups[0][k]) == len(groups[1][k]) == 1:
                want |= set(zip(groups[0][k], groups[1][k]))
    assert pairs == want and len(pairs) > 10


BEFORE = [
    ("r", "a.py", "def one(x):\n    return x + 1\n\n\ndef two(x):\n    return [x, x, x]\n"), ("r", "b.py", "LIMIT = 1\n"), ("r", "c.bin", "?"), ("r", "d.py", "def f():\n    return 1\n"),
    ("r", "same.py", "def g():\n    return 1\n"), ("r", "m.py", "def moving(alpha, beta):\n    return alpha * beta + alpha\n"), ("q", "x.py", "def h():\n    return 1\n"),
]
AFTER = [
    ("r", "a.py", "def one(x, y):\n    return x + 1\n\n\ndef drei(x):\n    return [x, x, x]\n"), ("r", "b.py", "LIMIT = 2\n"), ("r", "c.bin", "!"), ("r", "d.py", "def f(:\n"),
    ("r", "same.py", "def g():\n    return 1\n"), ("r", "n.py", "def moving(alpha, beta):\n    return alpha * beta + alpha\n"), ("q", "x.py", "def h():\n    return 2\n"),
]


def test_range_changes(spark):
    found, warnings = entity_diff.range_changes(spark.createDataFrame(BEFORE, FILE), spark.createDataFrame(AFTER, FILE), parse.facts)
    rows = [(r.change_kind, r.file_path, r.kind, r.name) for r in found.collect()]
    assert set(rows) == {
        ("signature_changed", "a.py", "function", "one"), ("renamed", "a.py", "function", "drei"), ("body_changed", "b.py", "module", "b.py"), ("moved", "n.py", "function", "moving"), ("body_changed", "x.py", "function", "h")
    }
    assert rows[0][1] == "x.py" and [r[1] for r in rows[1:]] == sorted(r[1] for r in rows[1:])
    assert {(r.file_path, r.code) for r in warnings.collect()} == {("c.bin", "W_UNSUPPORTED_FILE"), ("d.py", "E_PARSE_ERROR")}


def test_budget(spark):
    ticks = itertools.count()
    found, warnings = entity_diff.within_budget(spark.createDataFrame(BEFORE, FILE), spark.createDataFrame(AFTER, FILE), parse.facts, 0, 8, lambda: next(ticks))
    codes = {r.code for r in warnings.collect()}
    assert "W_ANALYSIS_BUDGET_EXCEEDED" in codes and len({r.repo_key for r in found.collect()}) <= 1
