from datetime import datetime, timedelta

from codeweft.operators import heavy_keys, snapshot_diff
from pyspark.sql import functions as F

T0 = datetime(2024, 1, 1)
ENTITY = "repo_key string, commit_id string, entity_id string, signature string, body_hash string, delivered_at timestamp, surplus int"
INDEX = "repo_key string, commit_id string, taken_at timestamp, delivered_at timestamp"


def at(n):
    return T0 + timedelta(hours=n)


def test_changes_between_snapshots(spark):
    rows = [
        ("r", "c1", "same", "f( x )", "AB", at(0), 1),
        ("r", "c2", "same", " f( x )  ", "ab", at(1), 1),
        ("r", "c2", "same", " f( x )  ", "ab", at(1), 1),  # repeated
        ("r", "c1", "sig", "f(a)", "AB", at(0), 1),
        ("r", "c2", "sig", "f(b)", "CD", at(1), 1),
        ("r", "c1", "body", "f", None, at(0), 1),
        ("r", "c2", "body", "f", "x", at(1), 1),
        ("r", "c1", "null", "f", None, at(0), 1),
        ("r", "c2", "null", "f", None, at(1), 1),
        ("r", "c1", "gone", "f", "x", at(0), 1),
        ("r", "c2", "come", "f", "old", at(1), 1),
        ("r", "c2", "come", "f", "new", at(2), 1),  # delivered again
        ("r", "c4", "come", "f", "NEW", at(9), 1),
        ("r", None, "lost", "f", "x", at(0), 1),
        (None, "c1", "lost", "f", "x", at(0), 1),
        ("r", "c1", None, "f", "x", at(0), 1),
    ]
    index = [("r", "c4", at(9), None), ("r", "c1", at(0), at(0)), ("r", "c2", at(1), at(5)), ("r", "c2", at(1), at(5)), ("r", "c3", at(3), at(3)), ("r", "c5", None, at(3)), (None, "c1", at(0), None)]
    clashing = {c: F.lit("x") for c in ("snapshot", "pair", "side", "e1", "sig", "body", "base_commit", "taken_at")}
    got = snapshot_diff.snapshot_changes(spark.createDataFrame(rows, ENTITY).withColumns(clashing), spark.createDataFrame(index, INDEX).withColumn("head_commit", F.lit("x")))
    found = {(r.base_commit, r.head_commit, r.entity_id, r.change_kind) for r in got.collect()}
    # c3 never arrived, so c2 and c4 are neighbours
    assert found == {
        ("c1", "c2", "sig", "signature_changed"),
        ("c1", "c2", "body", "body_changed"),
        ("c1", "c2", "gone", "removed"),
        ("c1", "c2", "come", "added"),
        ("c2", "c4", "same", "removed"),
        ("c2", "c4", "sig", "removed"),
        ("c2", "c4", "body", "removed"),
        ("c2", "c4", "null", "removed"),
    }
    assert {r.change_kind: r.n_entities for r in snapshot_diff.change_report(got.where("base_commit = 'c2'")).collect()} == {"removed": 4}


def test_changes_of_empty_tables(spark):
    assert snapshot_diff.snapshot_changes(spark.createDataFrame([], ENTITY), spark.createDataFrame([], INDEX)).count() == 0


def test_except_all_both_counts_copies(spark):
    base, head = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "x string"), spark.createDataFrame([("a",), ("b",), ("b",), ("b",), (None,)], "x string")
    assert {(r.x, r.surplus) for r in snapshot_diff.except_all_both(base, head, ["x"]).collect()} == {("a", -1), ("b", 2)}


RELATION = "from_id string, to_id string, relation string, confidence double, n_rows int"


def test_heavy_keys_and_rollup(spark):
    rows = [("hub", f"t{i % 7}", "CALLS", i / 100, 1) for i in range(60)] + [(f"s{i}", "x", "USES", None, 1) for i in range(40)] + [(None, "x", "USES", 0.5, 1), ("hub", None, None, 0.5, 1)]
    relations = spark.createDataFrame(rows, RELATION)
    found = {(r.endpoint_side, r.endpoint_id, r.relation): r.n_edges for r in heavy_keys.heavy_keys(relations, 0.3).collect()}
    assert found == {("from", "hub", "CALLS"): 60, ("to", "x", "USES"): 41}
    assert heavy_keys.heavy_keys(relations.limit(0)).count() == 0
    ends = spark.createDataFrame([("hub", "h", "type"), ("hub", "h", "type"), ("x", None, None), (None, "n", "type")], "endpoint_id string, endpoint_name string, endpoint_kind string")
    rolled = {(r.endpoint_side, r.endpoint_kind, r.relation): (r.n_edges, r.n_joined) for r in heavy_keys.join_rollup(relations, ends, ends.limit(0)).collect()}
    plain = relations.join(ends, relations.from_id == ends.endpoint_id).where("relation = 'CALLS'").count()
    assert rolled["from", "type", "CALLS"] == (60, plain) == (60, 120)
    assert rolled["to", None, "USES"] == (41, 41)


def test_best_neighbors_against_brute_force(spark):
    rows = [("hub", f"t{i % 50:02}", "CALLS", None if i % 11 == 0 else (i * 37 % 50) / 50, 1) for i in range(400)]
    got = heavy_keys.best_neighbors(spark.createDataFrame(rows, RELATION), k=5).where("endpoint_side = 'from'").orderBy("rank").collect()
    best = {}
    for _, t, _, c, _ in rows:
        n, m = best.get(t, (0, None))
        best[t] = (n + 1, c if m is None else m if c is None else max(m, c))
    order = sorted(best, key=lambda t: (best[t][1] is None, -(best[t][1] or 0), -best[t][0], t))
    assert [r.neighbor_id for r in got] == order[:5]
    assert {r.n_edges for r in got} == {400}
