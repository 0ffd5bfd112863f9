from codeweft.functions import text as T
from codeweft.operators import cochange, entity_diff, graph, search, similarity
from pyspark.sql import functions as F

ENDS = "endpoint_id string, endpoint_name string, qualified_name string, endpoint_kind string, file_path string, start_line int, is_external boolean"
RELS = "from_id string, to_id string, relation string, confidence double, resolution string, reason string"


def ends(spark):
    rows = [
        ("f", "f", "m.f", "function", "src/a.go", 1, False),
        ("g", "g", "m.g", "function", "src/a.go", 9, False),
        ("h", "h", "m.h", "function", "src/b_test.go", 1, False),
        ("x", "x", None, "import", None, None, True),
        ("f", "f", "m.f", "function", "src/a.go", 1, False),
    ]
    return graph.merge_endpoints(spark.createDataFrame(rows, ENDS))


def rels(spark):
    rows = [
        ("g", "f", "CALLS", 0.9, "exact", "r"),
        ("h", "f", "CALLS", 0.95, "exact", "r"),
        ("h", "g", "CALLS", 0.8, "name_only", "r"),
        ("f", "x", "CALLS", 0.7, "import_external", "r"),
        ("f", "g", "CONSTRUCTS", 0.6, None, "r"),
        ("g", "f", "CALLS", 0.5, None, None),
        ("f", "nowhere", "CALLS", 0.9, "exact", "r"),
        (None, "f", "CALLS", 0.9, "exact", "r"),
    ]
    return spark.createDataFrame(rows, RELS)


def test_neighbors_order_and_filters(spark):
    edges, all_ = graph.distinct_relations(rels(spark)), ends(spark)
    focus = graph.focus(all_, "M.F")
    got = graph.neighbors(edges, all_, focus, limit=2).orderBy("direction", "rank").collect()
    # production code before tests although the test's edge is more confident
    assert [(r.direction, r.other_id, r.total) for r in got] == [("in", "g", 2), ("in", "h", 2), ("out", "g", 2), ("out", "x", 2)]
    only = graph.neighbors(edges, all_, focus, relation="CALLS", internal_only=True, exclude_tests=True).collect()
    assert {(r.direction, r.other_id) for r in only} == {("in", "g"), ("out", "g")}
    assert graph.neighbors(edges.limit(0), all_, focus).count() == 0


def test_impact_shallowest_depth(spark):
    got = graph.impact(rels(spark), ends(spark).where("endpoint_id = 'f'"))
    assert {(r.caller_id, r.depth, r.via) for r in got.collect()} == {("g", 1, "f"), ("h", 1, "f")}
    totals = graph.impact_totals(graph.impact(rels(spark), ends(spark).where("endpoint_id = 'x'"))).first()
    assert (totals.total, totals.direct, totals.transitive) == (3, 1, 2)


def test_edge_filter_selector(spark):
    rows = spark.createDataFrame([("a:b:f", "t", "CALLS"), ("b:ff", "t", "CALLS"), ("f", "t", "USES")], "from_id string, to_id string, relation string")
    assert {r.from_id for r in graph.edge_filter(rows, source="f").collect()} == {"a:b:f", "f"}
    assert graph.edge_filter(rows, source="f", relation="USES").count() == 1


def test_enclosing_smallest_span(spark):
    spans = spark.createDataFrame([("outer", "s", 1, 100), ("inner", "s", 10, 20), ("late", "s", 12, 22), ("other", "t", 1, 50)], "span_id string, space string, low int, high int")
    points = spark.createDataFrame([("p", "s", 15), ("q", "s", 90), ("r", "s", 200), ("u", "t", 7)], "point_id string, space string, at int")
    assert {r.point_id: r.span_id for r in graph.enclosing(points, spans).collect()} == {"p": "late", "q": "outer", "u": "other"}


def test_cochange_limits(spark):
    rows = [("r", f"c{c}", c, p) for c in range(3) for p in ("a", "b", "b")] + [("r", "big", 9, f"p{i}") for i in range(60)] + [("r", None, 1, "a")]
    pairs = cochange.cochange_pairs(spark.createDataFrame(rows, "space string, commit string, seq int, path string"))
    assert [(r.left, r.right, r["count"]) for r in pairs.collect()] == [("a", "b", 3)]


def test_text_functions(spark):
    row = spark.range(1).select(
        T.token_variants(F.lit("parseHTTPRequest_v2")).alias("v"), T.sparse_tokens(F.lit("getUser2Name foo_bar 42")).alias("s"), T.is_test_path(F.lit("src/FooTest.java")).alias("t1"),
        T.is_test_path(F.lit("src/latest.java")).alias("t2"), T.route_parameters(F.lit("/a/[id]/$b/<int:c>")).alias("r"), T.url_path(F.lit("https://h.io/x/y?z=1")).alias("u"),
        T.signature_jaccard(F.lit("f(a, b)"), F.lit("f(a, c)")).alias("j"), T.external_short_name(F.lit("core/fmt.Print")).alias("e"), T.test_subject(F.lit("TestParse")).alias("ts"),
    ).first()
    assert row.v == ["parsehttprequest_v2", "parsehttprequest", "v2", "parse", "http", "request"]
    assert row.s == ["get", "user", "2", "name", "foo", "bar", "42"]
    assert (row.t1, row.t2) == (True, False)
    assert row.r == "/a/{id}/{b}/{c}" and row.u == "/x/y" and row.j == 0.5 and row.e == "Print" and row.ts == "Parse"


def test_query_and_diverse_choice():
    q = search.build_query("fix parsing in HttpClient")
    assert q.weights["httpclient"] == 2.5 and q.weights["http"] == 1.1 and q.weights["parsing"] == 1.0 and q.weights["parse"] == 0.55 and "in" not in q.weights
    regions = [search.Region("a.py", 1, 10, 10.0), search.Region("a.py", 11, 20, 9.9), search.Region("a.py", 2, 9, 9.8), search.Region("b.py", 1, 5, 9.0)]
    assert [(r.path, r.start) for r in search.diverse(regions, 3)] == [("a.py", 1), ("b.py", 1), ("a.py", 11)]


def test_bm25_against_brute_force(spark):
    import math

    docs = [(1, "p1", "alpha beta alpha"), (2, "p2", "beta gamma"), (3, "p3", "delta")]
    df = spark.createDataFrame(docs, "doc_id int, path string, body string")
    terms = spark.createDataFrame([("alpha", 1.0), ("beta", 1.0)], "term string, weight double")
    got = {r.region_id: r for r in search.bm25(df.withColumnRenamed("doc_id", "region_id"), df, terms).collect()}
    idf = lambda n: math.log(1 + (3 - n + 0.5) / (n + 0.5))
    average = (3 + 2 + 1) / 3
    part = lambda tf, length: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / average))
    assert abs(got[1].bm25 - round(idf(1) * part(2, 3) + idf(2) * part(1, 3), 4)) < 1e-4
    assert got[1].coverage == 1.0 and set(got) == {1, 2}


def test_clone_signatures(spark):
    body = "func sum(xs []int) int {\n total := 0\n for _, x := range xs {\n if x > 0 { total += x }\n }\n return total\n}"
    other = "class Foo(Bar):\n def run(self, name, size):\n  return [name for _ in range(size) if name and size != 3]"
    rows = [("a", body), ("b", body.replace("sum", "tally")), ("c", other), ("d", body), ("e", None), ("f", "x")]
    pairs = {(r.from_id, r.to_id): r.confidence for r in similarity.similar_pairs(similarity.signatures(spark.createDataFrame(rows, "symbol_id string, body string"))).collect()}
    assert pairs["a", "d"] == 1.0 and 0.82 <= pairs["a", "b"] < 1.0 and not any("c" in p for p in pairs)


ENTITIES = "id string, pos int, file_path string, kind string, name string, signature string, body_hash string, fingerprint string"


def test_entity_compare(spark):
    before = [
        ("b1", 1, "a.py", "function", "keep", "def keep(x)", "h1", "p1"),
        ("b2", 2, "a.py", "function", "edit", "def edit(x)", "h2", "p2"),
        ("b3", 3, "a.py", "function", "sign", "def sign(x)", "h3", "p3"),
        ("b4", 4, "a.py", "function", "old", "def old(x)", "h4", "p4"),
        ("b5", 5, "a.py", "function", "walk", "def walk(x)", "h5", "p5"),
        ("b6", 6, "a.py", "function", "dead", "def dead(y)", "h6", "p6"),
    ]
    after = [
        ("a1", 1, "a.py", "function", "keep", "def keep(x)", "h1", "p1"),
        ("a2", 2, "a.py", "function", "edit", "def edit(x)", "h9", "p9"),
        ("a3", 3, "a.py", "function", "sign", "def sign(x, y)", "h3", "p3"),
        ("a4", 4, "a.py", "function", "new", "def new(x)", "h8", "p4"),
        ("a5", 5, "b.py", "function", "walk", "def walk(x)", "h5", "p5"),
        ("a6", 6, "b.py", "function", "born", "def born(z)", "h7", "p7"),
    ]
    got = entity_diff.compare(spark.createDataFrame(before, ENTITIES), spark.createDataFrame(after, ENTITIES))
    assert {(r.change_kind, r.before_id, r.after_id) for r in got.collect()} == {
        ("body_changed", "b2", "a2"), ("signature_changed", "b3", "a3"), ("renamed", "b4", "a4"), ("moved", "b5", "a5"), ("removed", "b6", None), ("added", None, "a6"),
    }


def test_dependents(spark):
    names = spark.createDataFrame([("run",), ("lone",), (None,)], "name string")
    blocks = spark.createDataFrame([(1, "m.run", "run()"), (2, "m.a", "run(); run()"), (3, None, "x.run")], "block_id int, own_name string, body string")
    assert {r.name: r.n_dependents for r in entity_diff.dependents(names, blocks).collect()} == {"run": 2, "lone": 0}
