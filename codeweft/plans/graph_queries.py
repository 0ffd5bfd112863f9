"""Queries over the code graph tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators import cochange, graph, relations
from codeweft.tables import table


def _endpoints(spark: SparkSession, d: str) -> DataFrame:
    return graph.merge_endpoints(table(spark, d, "endpoints"), table(spark, d, "shared_endpoints"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.distinct_relations(table(spark, d, "relations"))


def endpoint_union(spark: SparkSession, d: str) -> DataFrame:
    return _endpoints(spark, d)


def relation_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


def edge_filter(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_filter(_edges(spark, d), target="function:Wrap", relation="CALLS").select("from_id", "to_id", "relation")


def resolved_edges(spark: SparkSession, d: str) -> DataFrame:
    kinds = _endpoints(spark, d).select("endpoint_id", "endpoint_kind")
    edges = _edges(spark, d).join(kinds.toDF("from_id", "from_kind"), "from_id").join(kinds.toDF("to_id", "to_kind"), "to_id")
    return edges.groupBy("from_kind", "relation", "to_kind").agg(F.count(F.lit(1)).alias("n_edges"))


def neighbors_topk(spark: SparkSession, d: str) -> DataFrame:
    ends = _endpoints(spark, d)
    found = graph.neighbors(_edges(spark, d), ends, ends, limit=5)
    return found.select("focus_id", "direction", "rank", "total", "other_id", "relation")


def neighbors_production(spark: SparkSession, d: str) -> DataFrame:
    ends = _endpoints(spark, d)
    found = graph.neighbors(_edges(spark, d), ends, ends, limit=3, relation="CALLS", internal_only=True, exclude_tests=True)
    return found.select("focus_id", "direction", "rank", "total", "other_id", "relation")


def focus_lookup(spark: SparkSession, d: str) -> DataFrame:
    return graph.focus(_endpoints(spark, d), "wrap").select("endpoint_id", "endpoint_kind", "file_path")


def two_hop_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.two_hop_paths(_edges(spark, d), _endpoints(spark, d), limit=10)


def impact_callers(spark: SparkSession, d: str) -> DataFrame:
    return graph.impact(table(spark, d, "relations"), table(spark, d, "shared_endpoints"), depth=2)


def impact_totals(spark: SparkSession, d: str) -> DataFrame:
    return graph.impact_totals(impact_callers(spark, d))


def impact_asked(spark: SparkSession, d: str) -> DataFrame:
    """Impact of the shared endpoints and of each endpoint whose id's hash is divisible by 20."""
    ids = [_endpoints(spark, d).where(F.pmod(F.xxhash64("endpoint_id"), F.lit(20)) == 0), table(spark, d, "shared_endpoints")]
    return graph.impact(table(spark, d, "relations"), ids[0].select("endpoint_id").unionByName(ids[1].select("endpoint_id")), depth=2)


def impact_asked_totals(spark: SparkSession, d: str) -> DataFrame:
    return graph.impact_totals(impact_asked(spark, d))


def siblings_members(spark: SparkSession, d: str) -> DataFrame:
    ends = _endpoints(spark, d)
    return graph.members(ends, ends.where("endpoint_kind = 'type'"))


def container_members(spark: SparkSession, d: str) -> DataFrame:
    """What types of the same name hold, for each method; a type may be spread over files."""
    inside = F.regexp_extract("qualified_name", r"^(.+)\.[^.]+$", 1)
    ends = _endpoints(spark, d).withColumn("container", F.when(inside != "", inside))
    return graph.members(ends, ends.where("endpoint_kind = 'method'"), "container")


def inbound_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.inbound_degree(_edges(spark, d))


def confidence_bands(spark: SparkSession, d: str) -> DataFrame:
    return graph.confidence_report(table(spark, d, "relations"))


def completeness_rollup(spark: SparkSession, d: str) -> DataFrame:
    return graph.language_rollup(_endpoints(spark, d))


def enclosing_symbol(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entity_snapshots").where("repo_key IS NOT NULL AND commit_id IS NOT NULL AND entity_id IS NOT NULL AND file_path IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL")
    one = rows.groupBy("repo_key", "commit_id", "entity_id").agg(F.max(F.struct("delivered_at", "file_path", "start_line", "end_line")).alias("r"))
    flat = one.select(F.concat_ws(" ", "commit_id", "entity_id").alias("span_id"), F.concat_ws(" ", "repo_key", "commit_id", "r.file_path").alias("space"), F.col("r.start_line").alias("low"), F.col("r.end_line").alias("high"))
    points = flat.select(F.col("span_id").alias("point_id"), "space", F.floor((F.col("low") + F.col("high")) / 2).alias("at"))
    return graph.enclosing(points, flat)


def adjacent_siblings(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacent(_endpoints(spark, d).where("file_path IS NOT NULL"), ["file_path"], ["start_line", "endpoint_id"], "endpoint_id")


def gap_islands(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "commit_files").where("repo_key IS NOT NULL AND file_path IS NOT NULL AND commit_seq IS NOT NULL").select("repo_key", "file_path", "commit_seq").distinct()
    return graph.islands(rows, ["repo_key", "file_path"], "commit_seq", 17)


def _changes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "commit_files")
    return rows.select(F.col("repo_key").alias("space"), F.col("commit_id").alias("commit"), F.col("commit_seq").alias("seq"), F.col("file_path").alias("path"))


def cochange_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cochange.cochange_pairs(_changes(spark, d))


def cochange_top(spark: SparkSession, d: str) -> DataFrame:
    return cochange.top_pairs(cochange.cochange_pairs(_changes(spark, d)), 100)


def cochange_partners(spark: SparkSession, d: str) -> DataFrame:
    pairs = cochange.cochange_pairs(_changes(spark, d), min_count=3)
    return cochange.partners(pairs, _changes(spark, d).where("space IS NOT NULL AND path IS NOT NULL").select("space", "path").distinct())


def file_changes_with(spark: SparkSession, d: str) -> DataFrame:
    """Files that changed together, as edges of the graph."""
    return relations.co_changes(cochange.cochange_pairs(_changes(spark, d))).select("repo_key", "from_id", "to_id", "relation", "confidence", "reason")


QUERIES = (
    endpoint_union, relation_dedup, edge_filter, resolved_edges, neighbors_topk, neighbors_production, focus_lookup, two_hop_paths, impact_callers, impact_totals, impact_asked, impact_asked_totals, siblings_members, container_members, file_changes_with,
    inbound_degree, confidence_bands, completeness_rollup, enclosing_symbol, adjacent_siblings, gap_islands, cochange_pairs, cochange_top, cochange_partners,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


_ENDS = """ends AS (SELECT endpoint_id, min(endpoint_name) AS endpoint_name, min(qualified_name) AS qualified_name, min(endpoint_kind) AS endpoint_kind, min(file_path) AS file_path,
  min(start_line) AS start_line, min(is_external) AS is_external
  FROM (SELECT * FROM endpoints UNION ALL BY NAME SELECT * FROM shared_endpoints) WHERE endpoint_id IS NOT NULL GROUP BY endpoint_id)"""
_ENDS_ALL = """ends AS (SELECT endpoint_id, min(qualified_name) AS qualified_name, min(endpoint_kind) AS endpoint_kind, min(file_path) AS file_path
  FROM (SELECT * FROM endpoints UNION ALL SELECT * FROM shared_endpoints) WHERE endpoint_id IS NOT NULL GROUP BY endpoint_id)"""
_TIER = "CASE WHEN resolution = 'exact' THEN 0 WHEN resolution = 'import_resolved' THEN 1 ELSE 2 END"
_EDGES = f"""edges AS (SELECT from_id, to_id, relation, confidence, resolution, reason FROM relations WHERE from_id IS NOT NULL AND to_id IS NOT NULL AND relation IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY from_id, to_id, relation ORDER BY confidence DESC NULLS LAST, {_TIER}, resolution NULLS FIRST, reason NULLS FIRST) = 1)"""
_TEST = r"""coalesce(regexp_matches(file_path, '(?i)(^|/)(test|tests|__tests__|spec|specs|testdata)/') OR regexp_matches(lower(parse_filename(file_path)), '\.(test|spec)\.|_test\.(go|py)$|^test_.*\.py$|_spec\.rb$|^tests?\.rs$')
  OR regexp_matches(regexp_replace(parse_filename(file_path), '\.[^.]*$', ''), '(Test|Tests|TestCase)$'), false)"""


def _neighbors(limit: int, where: str) -> str:
    return f"""WITH {_ENDS}, {_EDGES},
inc AS (SELECT to_id AS focus_id, 'in' AS direction, from_id AS other_id, relation, confidence, resolution, reason FROM edges
  UNION ALL SELECT from_id, 'out', to_id, relation, confidence, resolution, reason FROM edges),
ranked AS (SELECT focus_id, direction, other_id, relation,
  row_number() OVER (PARTITION BY focus_id, direction ORDER BY CASE WHEN coalesce(is_external, false) THEN 2 WHEN {_TEST} THEN 1 ELSE 0 END, {_TIER},
    confidence DESC NULLS LAST, file_path NULLS FIRST, start_line NULLS FIRST, CASE WHEN coalesce(qualified_name, '') <> '' THEN qualified_name ELSE endpoint_name END NULLS FIRST, other_id, relation,
    resolution NULLS FIRST, reason NULLS FIRST)::INTEGER AS rank, count(*) OVER (PARTITION BY focus_id, direction) AS total
  FROM inc SEMI JOIN (SELECT endpoint_id AS focus_id FROM ends) USING (focus_id) JOIN ends ON ends.endpoint_id = other_id WHERE {where})
SELECT focus_id, direction, rank, total, other_id, relation FROM ranked WHERE rank <= {limit}"""


_PAIRS = """member AS (SELECT DISTINCT repo_key AS space, commit_id, file_path AS path FROM commit_files WHERE repo_key IS NOT NULL AND commit_id IS NOT NULL AND file_path IS NOT NULL),
fits AS (SELECT space, commit_id FROM member GROUP BY ALL HAVING count(*) BETWEEN 2 AND 50),
kept AS (SELECT * FROM member SEMI JOIN fits USING (space, commit_id)),
pairs AS (SELECT a.space, a.path AS "left", b.path AS "right", count(*) AS count FROM kept a JOIN kept b ON a.space = b.space AND a.commit_id = b.commit_id AND a.path < b.path GROUP BY ALL HAVING count(*) >= {least})"""
_CALLS = """calls AS (SELECT DISTINCT from_id, to_id FROM relations WHERE relation IN ('CALLS', 'ASYNC_CALLS', 'CONSTRUCTS') AND from_id IS NOT NULL AND to_id IS NOT NULL),
focus AS (SELECT DISTINCT endpoint_id AS focus_id FROM shared_endpoints),
one AS (SELECT focus_id, from_id AS caller_id, 1 AS depth, focus_id AS via FROM focus JOIN calls ON to_id = focus_id WHERE from_id <> focus_id),
two AS (SELECT focus_id, from_id AS caller_id, 2 AS depth, min(to_id) AS via FROM one JOIN calls ON to_id = caller_id
  WHERE from_id <> focus_id AND (focus_id, from_id) NOT IN (SELECT (focus_id, caller_id) FROM one) GROUP BY focus_id, from_id),
callers AS (SELECT * FROM one UNION ALL SELECT * FROM two)"""


def oracle_sql() -> dict[str, str]:
    return {
        "endpoint_union": f"WITH {_ENDS} SELECT * FROM ends",
        "relation_dedup": f"WITH {_EDGES} SELECT * FROM edges",
        "edge_filter": "SELECT DISTINCT from_id, to_id, relation FROM relations WHERE from_id IS NOT NULL AND relation = 'CALLS' AND (to_id = 'function:Wrap' OR suffix(to_id, ':function:Wrap'))",
        "resolved_edges": f"""WITH {_ENDS}, e AS (SELECT DISTINCT from_id, to_id, relation FROM relations WHERE relation IS NOT NULL)
SELECT f.endpoint_kind AS from_kind, relation, t.endpoint_kind AS to_kind, count(*) AS n_edges FROM e JOIN ends f ON f.endpoint_id = from_id JOIN ends t ON t.endpoint_id = to_id GROUP BY ALL""",
        "neighbors_topk": _neighbors(5, "true"),
        "neighbors_production": _neighbors(3, f"relation IN ('CALLS', 'CONSTRUCTS') AND NOT coalesce(is_external, false) AND NOT {_TEST}"),
        "focus_lookup": f"WITH {_ENDS} SELECT endpoint_id, endpoint_kind, file_path FROM ends WHERE lower(endpoint_name) = 'wrap' OR lower(qualified_name) = 'wrap'",
        "two_hop_paths": f"""WITH {_ENDS}, e AS (SELECT DISTINCT from_id, to_id FROM relations WHERE relation IN ('CALLS', 'CONSTRUCTS') AND from_id IS NOT NULL AND to_id IS NOT NULL),
p AS (SELECT a.to_id AS focus_id, a.from_id AS caller_id, b.to_id AS callee_id FROM e a JOIN e b ON b.from_id = a.to_id SEMI JOIN ends ON ends.endpoint_id = a.to_id)
SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY focus_id ORDER BY caller_id, callee_id) <= 10""",
        "impact_callers": f"WITH {_CALLS} SELECT * FROM callers",
        "impact_totals": f"WITH {_CALLS} SELECT focus_id, count(*) AS total, count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 1) AS transitive FROM callers GROUP BY focus_id",
        "siblings_members": f"""WITH {_ENDS} SELECT f.endpoint_id AS focus_id, m.endpoint_id AS member_id FROM ends f JOIN ends m ON f.file_path = m.file_path AND f.endpoint_id <> m.endpoint_id
WHERE f.endpoint_kind = 'type'""",
        "inbound_degree": f"""WITH {_EDGES} SELECT to_id, count(*) AS degree, round(least(6.0, 1.6 * ln(1 + count(*))), 4) AS bonus FROM edges
WHERE relation IN ('CALLS', 'ASYNC_CALLS', 'IMPLEMENTS', 'OVERRIDES') GROUP BY to_id""",
        "confidence_bands": """SELECT relation, resolution, CASE WHEN coalesce(confidence, 0) >= 0.9 THEN 'exact' WHEN confidence >= 0.7 THEN 'strong' WHEN confidence >= 0.4 THEN 'heuristic' ELSE 'weak' END AS band,
count(*) AS n_relations FROM relations WHERE relation IS NOT NULL GROUP BY ALL""",
        "completeness_rollup": f"WITH {_ENDS} SELECT endpoint_kind, count(*) AS n_endpoints, count(DISTINCT file_path) AS n_files FROM ends WHERE NOT coalesce(is_external, false) GROUP BY ROLLUP (endpoint_kind)",
        "enclosing_symbol": """WITH one AS (SELECT repo_key, commit_id, entity_id, file_path, start_line, end_line FROM entity_snapshots
  WHERE repo_key IS NOT NULL AND commit_id IS NOT NULL AND entity_id IS NOT NULL AND file_path IS NOT NULL AND start_line IS NOT NULL AND end_line IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY repo_key, commit_id, entity_id ORDER BY delivered_at DESC NULLS LAST, file_path DESC, start_line DESC, end_line DESC) = 1),
flat AS (SELECT commit_id || ' ' || entity_id AS span_id, repo_key || ' ' || commit_id || ' ' || file_path AS space, start_line AS low, end_line AS high FROM one)
SELECT p.span_id AS point_id, s.span_id FROM flat p JOIN flat s ON s.space = p.space AND floor((p.low + p.high) / 2) BETWEEN s.low AND s.high
QUALIFY row_number() OVER (PARTITION BY p.span_id ORDER BY s.high - s.low, s.low DESC, s.span_id) = 1""",
        "adjacent_siblings": f"""WITH {_ENDS} SELECT file_path, endpoint_id, lag(endpoint_id) OVER w AS before, lead(endpoint_id) OVER w AS after FROM ends WHERE file_path IS NOT NULL
WINDOW w AS (PARTITION BY file_path ORDER BY start_line NULLS FIRST, endpoint_id)""",
        "gap_islands": """WITH r AS (SELECT DISTINCT repo_key, file_path, commit_seq FROM commit_files WHERE repo_key IS NOT NULL AND file_path IS NOT NULL AND commit_seq IS NOT NULL),
f AS (SELECT *, CASE WHEN commit_seq - lag(commit_seq) OVER w <= 17 THEN 0 ELSE 1 END AS fresh FROM r WINDOW w AS (PARTITION BY repo_key, file_path ORDER BY commit_seq)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY repo_key, file_path ORDER BY commit_seq) AS island FROM f)
SELECT repo_key, file_path, min(commit_seq) AS low, max(commit_seq) AS high, count(*) AS n_rows FROM g GROUP BY repo_key, file_path, island""",
        "container_members": f"""WITH {_ENDS_ALL}, c AS (SELECT endpoint_id, endpoint_kind, nullif(regexp_extract(qualified_name, '^(.+)\\.[^.]+$', 1), '') AS container FROM ends)
SELECT f.endpoint_id AS focus_id, m.endpoint_id AS member_id FROM c f JOIN c m ON f.container = m.container AND f.endpoint_id <> m.endpoint_id WHERE f.endpoint_kind = 'method'""",
        "file_changes_with": f"""WITH {_PAIRS.format(least=2)} SELECT space AS repo_key, space || ':file:' || "left" AS from_id, space || ':file:' || "right" AS to_id, 'FILE_CHANGES_WITH' AS relation,
least(0.95, 0.5 + 0.05 * count)::DOUBLE AS confidence, 'files changed together in ' || count || ' recent commits' AS reason FROM pairs""",
        "cochange_pairs": f"WITH {_PAIRS.format(least=2)} SELECT * FROM pairs",
        "cochange_top": f"""WITH {_PAIRS.format(least=2)} SELECT *, (row_number() OVER (PARTITION BY space ORDER BY count DESC, "left", "right"))::INTEGER AS rank FROM pairs QUALIFY rank <= 100""",
        "cochange_partners": f"""WITH {_PAIRS.format(least=3)} SELECT space, "left" AS path, "right" AS partner, count FROM pairs UNION ALL SELECT space, "right", "left", count FROM pairs""",
    }
