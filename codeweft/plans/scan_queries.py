"""Queries over the scans and reports, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeweft.functions.text import identifiers
from codeweft.operators import graph, reports, scans
from codeweft.plans.graph_queries import _edges, _endpoints, impact_callers
from codeweft.plans.text_queries import _FILES
from codeweft.tables import latest_content, table

PATTERNS = ["return None", "throw new", "Errorf("]
TERMS = ["budget", "Snapshot", "resolver", "cache layer", "lorem"]


def _files(spark: SparkSession, d: str) -> DataFrame:
    return latest_content(table(spark, d, "source_files"), ["file_path", "content"])


def grep_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first two lines of each file that hold one of three fixed strings."""
    return scans.grep_lines(_files(spark, d), PATTERNS, 2)


def grep_paths(spark: SparkSession, d: str) -> DataFrame:
    """Files that hold one of two strings without letter case."""
    return scans.grep_paths(_files(spark, d), ["CACHE is cold", "drops tokens"])


def grep_paths_exact(spark: SparkSession, d: str) -> DataFrame:
    """Files, binary ones too, that hold a string with letter case."""
    return scans.grep_paths(_files(spark, d), ["DO NOT EDIT"], ignore_case=False, binary=True)


def untracked_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of source files that no commit touched, without the marks that mean nothing."""
    tracked = table(spark, d, "commit_files").where("file_path IS NOT NULL").select(F.regexp_replace("file_path", r"^(\./|/)+", "").alias("file_path"))
    return scans.untracked(_files(spark, d).select("file_path").distinct(), tracked)


def terms_in_documents(spark: SparkSession, d: str) -> DataFrame:
    """Which of five terms each document holds, and how many documents hold each set."""
    held = F.array_join(scans.terms_in(F.col("text"), TERMS), ",").alias("terms")
    return table(spark, d, "documents").where("text IS NOT NULL").select(held).groupBy("terms").agg(F.count(F.lit(1)).alias("n_docs"))


def import_lines(spark: SparkSession, d: str) -> DataFrame:
    """JavaScript import lines of each file that has some."""
    lines = _files(spark, d).select("file_id", F.explode(F.split("content", "\n")).alias("text"))
    return lines.where(scans.is_import_line(F.col("text"))).groupBy("file_id").agg(F.count(F.lit(1)).alias("n_lines"))


def compound_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of endpoints that are compound identifiers."""
    names = table(spark, d, "endpoints").where("endpoint_name IS NOT NULL").select("endpoint_name").distinct()
    return names.where(scans.is_compound(F.col("endpoint_name")))


def identifier_holders(spark: SparkSession, d: str) -> DataFrame:
    """Files that hold the name of a shared endpoint as a whole identifier."""
    names = table(spark, d, "shared_endpoints").where("endpoint_name IS NOT NULL").select(F.col("endpoint_name").alias("name")).distinct()
    used = _files(spark, d).select("file_id", F.explode(F.array_distinct(identifiers(F.col("content")))).alias("name"))
    hits = used.join(F.broadcast(names), "name")  # a table that doesn't grow
    return hits.groupBy("name").agg(F.count_distinct("file_id").alias("n_files"))


def signature_types(spark: SparkSession, d: str) -> DataFrame:
    """How often each type name occurs in the signatures of entities."""
    rows = table(spark, d, "entity_snapshots").where("signature IS NOT NULL").select(F.explode(scans.type_names(F.col("signature"))).alias("type_name"))
    return rows.groupBy("type_name").agg(F.count(F.lit(1)).alias("n"))


def plain_types(spark: SparkSession, d: str) -> DataFrame:
    """Signatures without arguments of types, pointers and marks."""
    return table(spark, d, "entity_snapshots").where("signature IS NOT NULL").select("signature").distinct().select("signature", scans.plain_type(F.col("signature")).alias("plain"))


def path_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Paths with their package, penalty and depth."""
    paths = _files(spark, d).select("file_path").distinct()
    return paths.select("file_path", scans.monorepo_unit(F.col("file_path")).alias("unit"), scans.path_penalty(F.col("file_path")).alias("penalty"), F.size(scans.path_parts(F.col("file_path"))).alias("depth"))


def mirror_groups(spark: SparkSession, d: str) -> DataFrame:
    """Files of one repository with the same content, and which of them is the one to keep."""
    files = latest_content(table(spark, d, "source_files"), ["repo_key", "file_path", "content"]).where("repo_key IS NOT NULL AND content <> ''")
    keyed = files.select("repo_key", "file_path", F.sha2("content", 256).alias("h"))
    keep = keyed.groupBy("repo_key", "h").agg(F.min(F.struct(scans.path_penalty(F.col("file_path")).alias("p"), F.size(scans.path_parts(F.col("file_path"))).alias("n"), "file_path")).alias("k"), F.count(F.lit(1)).alias("n_copies"))
    both = keyed.join(keep.where("n_copies > 1"), ["repo_key", "h"]).where("file_path <> k.file_path")
    return both.select("repo_key", "file_path", F.col("k.file_path").alias("kept_path"), scans.common_suffix(F.col("file_path"), F.col("k.file_path")).alias("n_common"))


def appended_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Endpoints by file, with the shared ones that no file row names."""
    columns = ["endpoint_id", "endpoint_kind"]
    return scans.append_missing(table(spark, d, "endpoints").where("endpoint_id IS NOT NULL").select(*columns).distinct(), table(spark, d, "shared_endpoints").select(*columns).distinct(), ["endpoint_id"])


def scaled_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source with a language, scaled from those to all of the source."""
    counted = table(spark, d, "documents").groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count(F.lit(1)).alias("n_all"), F.count("lang").alias("n_seen"), F.count_if(F.lower("text").contains("budget")).alias("n_hits"))
    return counted.select("source", "n_all", "n_seen", "n_hits", reports.scaled(F.col("n_hits"), F.col("n_all"), F.col("n_seen")).alias("n_scaled"))


def language_totals(spark: SparkSession, d: str) -> DataFrame:
    """Files, bytes, lines and failures by recorded language and in all."""
    files = latest_content(table(spark, d, "source_files"), ["file_language", "n_bytes", "content", "parse_error"])
    rows = files.select(F.lower(F.trim("file_language")).alias("language"), "n_bytes", F.size(F.split("content", "\n")).alias("n_lines"), F.coalesce("parse_error", F.lit(False)).alias("failed"), F.lit(2).alias("seconds"))
    return reports.language_totals(rows)


def repository_levels(spark: SparkSession, d: str) -> DataFrame:
    """How complete each repository was read."""
    files = latest_content(table(spark, d, "source_files"), ["repo_key", "content", "parse_error"]).where("repo_key IS NOT NULL")
    rows = files.groupBy("repo_key").agg(F.count(F.lit(1)).alias("n_files"), F.count_if("parse_error").alias("n_failures"), F.count_if(F.col("content") != "").alias("n_parsed"), F.sum(F.size(F.split("content", "\n"))).alias("n_lines"))
    return rows.select("repo_key", "n_files", "n_failures", reports.completeness_level(F.col("n_failures"), F.col("n_files"), F.col("n_parsed"), F.col("n_lines")).alias("level"))


def coverage_counts(spark: SparkSession, d: str) -> DataFrame:
    return reports.coverage_counts(_endpoints(spark, d), _edges(spark, d))


def best_relations(spark: SparkSession, d: str) -> DataFrame:
    """The most confident relation into each endpoint."""
    return reports.best_of(_edges(spark, d), ["to_id"], "confidence", ["from_id", "relation"])


def record_bytes(spark: SparkSession, d: str) -> DataFrame:
    ends = reports.record_bytes(_endpoints(spark, d), "endpoint", ["endpoint_id", "endpoint_name", "qualified_name", "endpoint_kind", "file_path"])
    return ends.unionByName(reports.record_bytes(_edges(spark, d), "relation", ["from_id", "to_id", "relation", "resolution", "reason"]))


def relation_violations(spark: SparkSession, d: str) -> DataFrame:
    return reports.violations(table(spark, d, "relations"))


def supported_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations by type and language of their source where the language supports the type."""
    language = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])[F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1))]
    ends = _endpoints(spark, d).select("endpoint_id", language.alias("language")).where("language IS NOT NULL")
    return reports.supported(_edges(spark, d), ends).groupBy("relation", "language").agg(F.count(F.lit(1)).alias("n"))


def impact_sections(spark: SparkSession, d: str) -> DataFrame:
    return reports.impact_sections(impact_callers(spark, d), _endpoints(spark, d))


def ambiguous_names(spark: SparkSession, d: str) -> DataFrame:
    return reports.definitions(_endpoints(spark, d))


def focus_order(spark: SparkSession, d: str) -> DataFrame:
    """The endpoints that a name finds, in order of path, line and id."""
    found = graph.focus(_endpoints(spark, d), "decodeWindow")
    order = ["file_path", "start_line", "endpoint_id"]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(F.lower("endpoint_name")).orderBy(*order))).select("rank", "endpoint_id")


EXTENSIONS = {"py": "Python", "go": "Go", "js": "JavaScript", "ts": "TypeScript", "java": "Java", "rs": "Rust", "c": "C", "md": "Markdown"}
QUERIES = (
    grep_lines, grep_paths, grep_paths_exact, untracked_paths, terms_in_documents, import_lines, compound_names, identifier_holders, signature_types, plain_types, path_kinds, mirror_groups, appended_endpoints,
    scaled_frequencies, language_totals, repository_levels, coverage_counts, best_relations, record_bytes, relation_violations, supported_relations, impact_sections, ambiguous_names, focus_order,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


_ENDS = """ends AS (SELECT endpoint_id, min(endpoint_name) AS endpoint_name, min(qualified_name) AS qualified_name, min(endpoint_kind) AS endpoint_kind, min(file_path) AS file_path, min(start_line) AS start_line, min(is_external) AS is_external
  FROM (SELECT * FROM endpoints UNION ALL SELECT * FROM shared_endpoints) WHERE endpoint_id IS NOT NULL GROUP BY endpoint_id)"""
_TIER = "CASE WHEN resolution = 'exact' THEN 0 WHEN resolution = 'import_resolved' THEN 1 ELSE 2 END"
_ONE = f"""one AS (SELECT from_id, to_id, relation, confidence, resolution, reason FROM relations WHERE from_id IS NOT NULL AND to_id IS NOT NULL AND relation IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY from_id, to_id, relation ORDER BY coalesce(confidence, -1) DESC, {_TIER}, resolution NULLS FIRST, reason NULLS FIRST) = 1)"""


def oracle_sql() -> dict[str, str]:
    any_of = lambda column, patterns: " OR ".join(f"contains({column}, '{p}')" for p in patterns)
    parts = "[x FOR x IN string_split({}, '/') IF x NOT IN ('', '.')]"
    value = lambda x: f"CASE WHEN {x} IN {scans.GENERATED_DIRS} THEN 100 WHEN {x} IN {scans.BUILT_DIRS} THEN 30 WHEN {x} IN {scans.WRITTEN_DIRS} THEN -20 ELSE 0 END"
    penalty = lambda p: f"coalesce(list_sum([{value('lower(f)')} FOR f IN list_reverse(list_reverse({parts.format(p)})[2:])]), 0)::INTEGER"
    held = "array_to_string([x FOR x IN [" + ", ".join(f"CASE WHEN contains(lower(text), '{t.lower()}') THEN '{t}' END" for t in TERMS) + "] IF x IS NOT NULL], ',')"
    bare = "signature"
    for _ in range(4):
        bare = f"regexp_replace({bare}, '<[^<>]*>', '', 'g')"
    listed = ", ".join(f"('{r}', '{lang}')" for r, langs in reports.CAPABILITIES.items() for lang in langs)
    extension = "CASE lower(regexp_extract(file_path, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EXTENSIONS.items()) + " END"
    rules = [
        ("no source", "from_id IS NULL"), ("no target", "to_id IS NULL"), ("no type", "relation IS NULL"), ("confidence out of range", "NOT coalesce(confidence > 0 AND confidence <= 1, false)"),
        ("points at itself", "coalesce(from_id = to_id, false)"), ("no warning codes", "warning_codes IS NULL"), ("no resolution", "resolution IS NULL"),
    ]
    whole = "(^|[^A-Za-z0-9_$])' || regexp_escape(name) || '([^A-Za-z0-9_$]|$)"
    return {
        "grep_lines": f"""WITH {_FILES}, l AS (SELECT file_id, file_path, unnest(string_split(content, chr(10))) AS text, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line FROM files WHERE NOT contains(content, chr(0)))
SELECT file_id, file_path, line::INTEGER AS line, text FROM l WHERE {any_of('text', PATTERNS)} QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY line) <= 2""",
        "grep_paths": f"WITH {_FILES} SELECT file_id, file_path FROM files WHERE (contains(lower(content), 'cache is cold') OR contains(lower(content), 'drops tokens')) AND NOT contains(content, chr(0))",
        "grep_paths_exact": f"WITH {_FILES} SELECT file_id, file_path FROM files WHERE contains(content, 'DO NOT EDIT')",
        "untracked_paths": f"WITH {_FILES} SELECT DISTINCT file_path FROM files WHERE file_path NOT IN (SELECT regexp_replace(file_path, '^(\\./|/)+', '') FROM commit_files WHERE file_path IS NOT NULL)",
        "terms_in_documents": f"SELECT {held} AS terms, count(*) AS n_docs FROM documents WHERE text IS NOT NULL GROUP BY 1",
        "import_lines": f"WITH {_FILES}, l AS (SELECT file_id, unnest(string_split(content, chr(10))) AS text FROM files) SELECT file_id, count(*) AS n_lines FROM l WHERE regexp_matches(text, '^\\s*(import[ {{]|export ?\\{{)') GROUP BY file_id",
        "compound_names": "SELECT DISTINCT endpoint_name FROM endpoints WHERE strlen(endpoint_name) >= 6 AND regexp_matches(endpoint_name, '^[A-Za-z0-9_$-]+$') AND (regexp_matches(endpoint_name, '[a-z][A-Z]|[A-Z].*[a-z]') OR regexp_matches(endpoint_name, '[A-Za-z0-9][_-][A-Za-z]'))",
        "identifier_holders": f"WITH {_FILES}, names AS (SELECT DISTINCT endpoint_name AS name FROM shared_endpoints WHERE endpoint_name IS NOT NULL) SELECT name, count(DISTINCT file_id) AS n_files FROM files, names WHERE regexp_matches(content, '{whole}') GROUP BY name",
        "signature_types": "SELECT type_name, count(*) AS n FROM (SELECT unnest(list_distinct([x FOR x IN regexp_extract_all(signature, '[A-Za-z_]\\w*') IF regexp_matches(x, '^[A-Z]\\w')])) AS type_name FROM entity_snapshots WHERE signature IS NOT NULL) GROUP BY type_name",
        "plain_types": f"SELECT DISTINCT signature, trim(regexp_replace({bare}, '\\[[^\\[\\]]*\\]|[*&?!]', '', 'g')) AS plain FROM entity_snapshots WHERE signature IS NOT NULL",
        "path_kinds": f"WITH {_FILES} SELECT DISTINCT file_path, lower(regexp_extract(file_path, '(?i)(?:^|/)((?:{'|'.join(scans.UNIT_DIRS)})/[^/]+)/', 1)) AS unit, {penalty('file_path')} AS penalty, len({parts.format('file_path')})::INTEGER AS depth FROM files",
        "mirror_groups": f"""WITH files AS (SELECT file_id, repo_key, file_path, content FROM source_files WHERE file_id IS NOT NULL AND file_path IS NOT NULL AND content IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ingested_at DESC NULLS LAST, repo_key DESC NULLS LAST, file_path DESC, content DESC) = 1),
k AS (SELECT repo_key, file_path, sha256(content) AS h, {penalty('file_path')} AS p, len({parts.format('file_path')}) AS n FROM files WHERE repo_key IS NOT NULL AND content <> ''),
g AS (SELECT *, first(file_path) OVER (PARTITION BY repo_key, h ORDER BY p, n, file_path) AS kept_path FROM k),
s AS (SELECT repo_key, file_path, kept_path, list_reverse({parts.format('file_path')}) AS a, list_reverse({parts.format('kept_path')}) AS b FROM g WHERE file_path <> kept_path)
SELECT repo_key, file_path, kept_path, coalesce(list_min([i FOR i IN range(1, least(len(a), len(b)) + 1) IF a[i] <> b[i]]) - 1, least(len(a), len(b)))::INTEGER AS n_common FROM s""",
        "appended_endpoints": "SELECT DISTINCT endpoint_id, endpoint_kind FROM endpoints WHERE endpoint_id IS NOT NULL UNION ALL SELECT DISTINCT endpoint_id, endpoint_kind FROM shared_endpoints WHERE endpoint_id NOT IN (SELECT endpoint_id FROM endpoints WHERE endpoint_id IS NOT NULL)",
        "scaled_frequencies": """WITH c AS (SELECT coalesce(source, 'none') AS source, count(*) AS n_all, count(lang) AS n_seen, count(*) FILTER (contains(lower(text), 'budget')) AS n_hits FROM documents GROUP BY 1)
SELECT *, CASE WHEN n_hits <= 0 OR n_all <= n_seen OR n_seen <= 0 THEN n_hits ELSE (n_hits * n_all + n_seen - 1) // n_seen END::BIGINT AS n_scaled FROM c""",
        "language_totals": """WITH files AS (SELECT file_id, file_language, n_bytes, content, parse_error FROM source_files WHERE file_id IS NOT NULL AND file_path IS NOT NULL AND content IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ingested_at DESC NULLS LAST, file_language DESC NULLS LAST, n_bytes DESC NULLS LAST, content DESC, parse_error DESC NULLS LAST) = 1),
r AS (SELECT lower(trim(file_language)) AS language, n_bytes, len(string_split(content, chr(10))) AS n_lines, coalesce(parse_error, false) AS failed FROM files WHERE file_language IS NOT NULL)
SELECT language, count(*) AS n_files, count(*) FILTER (failed) AS n_failed, coalesce(sum(n_bytes) FILTER (NOT failed), 0)::BIGINT AS n_bytes, coalesce(sum(n_lines) FILTER (NOT failed), 0)::BIGINT AS n_lines, coalesce(2 * count(*) FILTER (NOT failed), 0)::BIGINT AS seconds,
  round(CASE WHEN count(*) FILTER (NOT failed) > 0 THEN sum(n_lines) FILTER (NOT failed) / (2.0 * count(*) FILTER (NOT failed)) END, 2) AS lines_a_second FROM r GROUP BY ROLLUP (language)""",
        "repository_levels": """WITH files AS (SELECT file_id, repo_key, content, parse_error FROM source_files WHERE file_id IS NOT NULL AND file_path IS NOT NULL AND content IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ingested_at DESC NULLS LAST, repo_key DESC NULLS LAST, content DESC, parse_error DESC NULLS LAST) = 1),
r AS (SELECT repo_key, count(*) AS n_files, count(*) FILTER (parse_error) AS n_failures, count(*) FILTER (content <> '') AS p, sum(len(string_split(content, chr(10)))) AS s FROM files WHERE repo_key IS NOT NULL GROUP BY repo_key)
SELECT repo_key, n_files, n_failures, CASE WHEN n_files = 0 THEN 'ok' WHEN p * 2 < n_files OR n_failures * 5 > n_files THEN 'unsafe' WHEN n_failures > 0 OR s = 0 THEN 'degraded' ELSE 'ok' END AS level FROM r""",
        "coverage_counts": f"WITH {_ENDS}, {_ONE} SELECT 'kind' AS what, endpoint_kind AS name, count(*) AS n FROM ends WHERE endpoint_kind IS NOT NULL GROUP BY ALL UNION ALL SELECT 'relation', relation, count(*) FROM one GROUP BY ALL",
        "best_relations": f"WITH {_ONE} SELECT to_id, confidence, from_id, relation, count(*) OVER (PARTITION BY to_id) AS n_rows FROM one QUALIFY row_number() OVER (PARTITION BY to_id ORDER BY confidence DESC NULLS LAST, from_id, relation) = 1",
        "record_bytes": f"""WITH {_ENDS}, {_ONE} SELECT 'endpoint' AS kind, count(*) AS n_rows, sum(strlen(endpoint_id) + coalesce(strlen(endpoint_name), 0) + coalesce(strlen(qualified_name), 0) + coalesce(strlen(endpoint_kind), 0) + coalesce(strlen(file_path), 0))::BIGINT AS n_bytes FROM ends
UNION ALL SELECT 'relation', count(*), sum(strlen(from_id) + strlen(to_id) + strlen(relation) + coalesce(strlen(resolution), 0) + coalesce(strlen(reason), 0))::BIGINT FROM one""",
        "relation_violations": " UNION ALL ".join(f"SELECT '{name}' AS rule, count(*) AS n_relations FROM relations WHERE {test} HAVING count(*) > 0" for name, test in rules),
        "supported_relations": f"""WITH {_ENDS}, {_ONE}, cap(relation, language) AS (VALUES {listed}), lang AS (SELECT endpoint_id, {extension} AS language FROM ends)
SELECT relation, language, count(*) AS n FROM one JOIN lang ON from_id = endpoint_id WHERE language IS NOT NULL AND (relation NOT IN (SELECT relation FROM cap) OR (relation, language) IN (SELECT relation, language FROM cap)) GROUP BY ALL""",
        "impact_sections": f"""WITH {_ENDS}, calls AS (SELECT DISTINCT from_id, to_id FROM relations WHERE relation IN ('CALLS', 'ASYNC_CALLS', 'CONSTRUCTS') AND from_id IS NOT NULL AND to_id IS NOT NULL),
f AS (SELECT DISTINCT endpoint_id AS focus_id FROM shared_endpoints), d1 AS (SELECT focus_id, from_id AS caller_id, 1 AS depth, min(to_id) AS via FROM f JOIN calls ON to_id = focus_id WHERE from_id <> focus_id GROUP BY ALL),
d2 AS (SELECT focus_id, from_id AS caller_id, 2 AS depth, min(to_id) AS via FROM d1 JOIN calls ON to_id = caller_id WHERE from_id <> focus_id AND (focus_id, from_id) NOT IN (SELECT focus_id, caller_id FROM d1) GROUP BY focus_id, from_id),
c AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2), n AS (SELECT c.*, file_path, start_line, endpoint_name FROM c JOIN ends ON endpoint_id = caller_id)
SELECT focus_id, row_number() OVER (PARTITION BY focus_id ORDER BY depth, file_path NULLS FIRST, start_line NULLS FIRST, endpoint_name NULLS FIRST, caller_id)::INTEGER AS rank, count(*) OVER (PARTITION BY focus_id) AS total,
  count(*) FILTER (depth = 1) OVER (PARTITION BY focus_id) AS direct, count(*) OVER (PARTITION BY focus_id) > 15 AS truncated, caller_id, depth, via FROM n QUALIFY rank <= 15""",
        "ambiguous_names": f"""WITH {_ENDS}, n AS (SELECT lower(endpoint_name) AS name, * EXCLUDE (endpoint_name) FROM ends WHERE endpoint_name IS NOT NULL AND NOT coalesce(is_external, false))
SELECT name, count(*) OVER (PARTITION BY name) AS n_definitions, row_number() OVER (PARTITION BY name ORDER BY file_path NULLS FIRST, start_line NULLS FIRST, endpoint_id)::INTEGER AS rank, endpoint_id, endpoint_kind, file_path, start_line FROM n QUALIFY n_definitions > 1""",
        "focus_order": f"WITH {_ENDS} SELECT row_number() OVER (PARTITION BY lower(endpoint_name) ORDER BY file_path NULLS FIRST, start_line NULLS FIRST, endpoint_id)::INTEGER AS rank, endpoint_id FROM ends WHERE lower(endpoint_name) = 'decodewindow' OR lower(qualified_name) = 'decodewindow'",
    }
