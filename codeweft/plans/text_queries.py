"""Queries over documents, entities and source files, and their SQL.

Documents stand for files: the path is made of language, source and id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions import text as T
from codeweft.operators import entity_diff, relations, search, similarity, snapshot_diff
from codeweft.sources import parse
from codeweft.tables import latest_content, short_hash, table

QUERY = "budget warning in the snapshot writer"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat_ws("/", F.coalesce("lang", F.lit("und")), F.coalesce("source", F.lit("none")), F.col("doc_id").cast("string"))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", path.alias("path"), F.col("text").alias("body"))


def _regions(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select(F.col("doc_id").alias("region_id"), "path", "body")


def doc_frequency(spark: SparkSession, d: str) -> DataFrame:
    terms = search.build_query(QUERY).table(spark)
    return search.document_frequency(_documents(spark, d), terms).select("term", "df", "n_docs", F.round("idf", 6).alias("idf"))


def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    terms = search.build_query(QUERY).table(spark)
    return search.bm25(_regions(spark, d), _documents(spark, d), terms)


def bm25_top(spark: SparkSession, d: str) -> DataFrame:
    query = search.build_query(QUERY)
    scores = search.bm25(_regions(spark, d), _documents(spark, d), query.table(spark)).join(_regions(spark, d).select("region_id", "path"), "region_id")
    total = F.col("score") + search.path_score(F.col("path"), query) + search.path_prior(F.col("path"), query)
    return search.ranked(scores.select("region_id", "path", F.round(total, 4).alias("score")), "score", ["path", "region_id"], 10)


def sparse_chunks(spark: SparkSession, d: str) -> DataFrame:
    files = latest_content(table(spark, d, "source_files"), ["content"]).select(F.col("file_id").alias("doc_id"), F.col("content").alias("body"))
    return search.chunks(files).select("region_id", "start_line", "end_line", short_hash(F.col("body")).alias("chunk_hash"))


def sparse_bm25(spark: SparkSession, d: str) -> DataFrame:
    terms = search.build_query(QUERY).table(spark)
    chunks = search.chunks(_documents(spark, d).select("doc_id", "body"))
    return search.bm25(chunks.select("region_id", "body"), _documents(spark, d), terms, sparse=True)


def path_prior(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "commit_files").where("file_path IS NOT NULL").select("file_path").distinct()
    return paths.select("file_path", search.path_prior(F.col("file_path")).alias("prior"), T.is_test_path(F.col("file_path")).alias("is_test"))


def focus_line(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", search.focus_line(F.col("body"), search.build_query(QUERY)).alias("focus"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    """The query set: each document whose id is divisible by 20 asks for what it says."""
    asked = table(spark, d, "documents").where("doc_id % 20 = 0 AND text IS NOT NULL").groupBy("doc_id").agg(F.min("text").alias("text"))
    return search.build_queries(asked.withColumnRenamed("doc_id", "query_id"))


def doc_frequency_batch(spark: SparkSession, d: str) -> DataFrame:
    terms = _queries(spark, d).select(F.inline("terms"))
    return search.substring_frequency(_documents(spark, d), terms).select("term", "df", "n_docs", F.round("idf", 6).alias("idf"))


def bm25_batch_top(spark: SparkSession, d: str) -> DataFrame:
    """The first ten documents for each query of the query set."""
    best = search.bm25_first(_regions(spark, d), _documents(spark, d), _queries(spark, d).persist(), 10)
    return best.select("query_id", "region_id", "path", "score", "rank")


def sparse_batch_top(spark: SparkSession, d: str) -> DataFrame:
    """The first ten runs of lines for each query of the query set."""
    chunks = search.chunks(_documents(spark, d).select("doc_id", "body"))
    best = search.bm25_first(chunks.select("region_id", "body"), _documents(spark, d), _queries(spark, d).persist(), 10, sparse=True)
    return best.select("query_id", "region_id", "score", "rank")


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    counted = table(spark, d, "commit_files").where("repo_key IS NOT NULL AND file_path IS NOT NULL").groupBy("repo_key", "file_path").agg(F.count(F.lit(1)).alias("n"), F.max("commit_seq").alias("seq"))
    sparse = search.ranked(counted, "n", ["file_path", "repo_key"], 500).select(F.concat_ws(":", "repo_key", "file_path").alias("region_id"), F.col("file_path").alias("path"), "rank")
    semantic = search.ranked(counted, "seq", ["file_path", "repo_key"], 500).select(F.col("file_path").alias("path"), "rank")
    return search.fuse(sparse, semantic)


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    body = F.col("body")
    return _documents(spark, d).select("doc_id", F.size(T.search_words(body)).alias("n_words"), F.size(F.array_distinct(T.identifiers(body))).alias("n_identifiers"))


def minified_share(spark: SparkSession, d: str) -> DataFrame:
    files = latest_content(table(spark, d, "source_files"), ["content"])
    return files.select("file_id", F.round(T.long_line_share(F.col("content"), 500), 6).alias("long_share"))


def body_hash_groups(spark: SparkSession, d: str) -> DataFrame:
    files = latest_content(table(spark, d, "source_files"), ["content"])
    return files.groupBy(short_hash(F.trim(F.regexp_replace("content", r"\s+", " "))).alias("body_hash")).agg(F.count(F.lit(1)).alias("n_files")).where("n_files > 1")


def dependents_count(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "endpoints").where("endpoint_kind <> 'file'").select(F.col("endpoint_name").alias("name"))
    files = latest_content(table(spark, d, "source_files"), ["file_path", "content"])
    return entity_diff.dependents(names, files.select(F.col("file_id").alias("block_id"), F.lit("").alias("own_name"), F.col("content").alias("body")))


def signature_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "entity_snapshots").where("entity_id IS NOT NULL AND signature IS NOT NULL").groupBy("entity_id").agg(F.min("signature").alias("a"), F.max("signature").alias("b"))
    return rows.select("entity_id", T.signature_jaccard(F.col("a"), F.col("b")).alias("overlap"))


def entity_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes between consecutive snapshots with renames and moves told from removals and additions."""
    rows = table(spark, d, "entity_snapshots").where("repo_key IS NOT NULL AND commit_id IS NOT NULL AND entity_id IS NOT NULL")
    facts = ["entity_kind", "entity_name", "file_path", "start_line", "signature", "body_hash", "fingerprint"]
    current = snapshot_diff.latest_rows(rows, ["repo_key", "commit_id", "entity_id"], "delivered_at", facts)
    pairs = snapshot_diff.consecutive_snapshots(table(spark, d, "snapshot_index"), rows.select("repo_key", "commit_id").distinct())

    def side(name: str) -> DataFrame:
        placed = current.join(pairs, (current.repo_key == pairs.repo_key) & (current.commit_id == pairs[name])).drop(pairs.repo_key)
        return placed.select(
            F.concat_ws(" ", "base_commit", "head_commit", "entity_id").alias("id"), F.concat_ws(" ", "repo_key", "base_commit", "head_commit").alias("pair"), F.col("start_line").alias("pos"),
            "file_path", F.col("entity_kind").alias("kind"), F.col("entity_name").alias("name"), F.trim(F.regexp_replace("signature", r"\s+", " ")).alias("signature"),
            F.lower("body_hash").alias("body_hash"), "fingerprint",
        )

    return entity_diff.compare(side("base_commit"), side("head_commit"), ["pair"])


def near_clones(spark: SparkSession, d: str) -> DataFrame:
    """Near-clones among the functions and methods of all files, within a file, across files and across repositories."""
    files = latest_content(table(spark, d, "source_files"), ["repo_key", "file_path", "content"]).withColumn("repo_key", F.coalesce("repo_key", F.lit("")))
    return similarity.similar_pairs(similarity.signatures(relations.bodies(relations.symbols(parse.facts(files)))))


QUERIES = (
    doc_frequency, bm25_search, bm25_top, sparse_chunks, sparse_bm25, path_prior, focus_line, rrf_fusion, token_counts, minified_share, body_hash_groups, dependents_count, signature_overlap,
    entity_changes, near_clones, doc_frequency_batch, bm25_batch_top, sparse_batch_top,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


_DOCS = "docs AS (SELECT doc_id, coalesce(lang, 'und') || '/' || coalesce(source, 'none') || '/' || doc_id AS path, text AS body FROM documents WHERE text IS NOT NULL)"
_FILES = "files AS (SELECT file_id, file_path, content FROM source_files WHERE file_id IS NOT NULL AND file_path IS NOT NULL AND content IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY ingested_at DESC NULLS LAST, content DESC) = 1)"


def _terms() -> str:
    query = search.build_query(QUERY)
    return "terms(term, weight) AS (VALUES " + ", ".join(f"('{t}', {query.weights[t]}::DOUBLE)" for t in query.terms) + ")"


def _df() -> str:
    return f"""{_DOCS}, {_terms()}, n AS (SELECT count(*) AS n_docs FROM docs),
idf AS (SELECT term, any_value(weight) AS weight, count(*) FILTER (contains(lower(path || chr(10) || body), term)) AS df, any_value(n_docs) AS n_docs,
  ln(1 + (any_value(n_docs) - count(*) FILTER (contains(lower(path || chr(10) || body), term)) + 0.5) / (count(*) FILTER (contains(lower(path || chr(10) || body), term)) + 0.5)) AS idf
  FROM docs, terms, n GROUP BY term)"""


def _spaced(word: str, rules: list[tuple[str, str]]) -> str:
    """SQL that puts blanks at the borders in a word."""
    for pattern, instead in rules:
        word = f"regexp_replace({word}, '{pattern}', '{instead}', 'g')"
    return word


CAMEL = [("([a-z0-9])([A-Z])", r"\1 \2"), ("([A-Z])([A-Z][a-z])", r"\1 \2")]
SPARSE = [("_+", " "), ("([a-z])([A-Z])", r"\1 \2"), ("([A-Z])([A-Z][a-z])", r"\1 \2"), ("([0-9])([A-Za-z])", r"\1 \2"), ("([A-Za-z])([0-9])", r"\1 \2")]
#: Tokens of a text, as SQL over ``body``.
TERM_TOKENS = f"""[t FOR t IN flatten([list_distinct(list_concat([lower(w)], [x FOR x IN string_split_regex(lower(w), '[^a-z0-9]+') IF x <> ''], [x FOR x IN string_split_regex(lower({_spaced('w', CAMEL)}), '[^a-z0-9]+') IF x <> '']))
  FOR w IN [regexp_replace(v, '^[./:-]+|[./:-]+$', '', 'g') FOR v IN regexp_extract_all(body, '[A-Za-z0-9_./:+#-]+')] IF w <> '']) IF strlen(t) >= 2]"""
SPARSE_TOKENS = f"[t FOR t IN flatten([string_split(lower({_spaced('w', SPARSE)}), ' ') FOR w IN regexp_extract_all(body, '[A-Za-z][A-Za-z0-9_]*|[0-9]+')]) IF t <> '']"


def _bm25_sql(regions: str, tokens: str) -> str:
    """Common tables up to ``scored`` (region_id, bm25, coverage, score) over ``regions`` (region_id, body)."""
    return f"""{_df()}, regions AS ({regions}), toks AS (SELECT region_id, {tokens} AS t FROM regions),
lens AS (SELECT region_id, len(t) AS length FROM toks), mean AS (SELECT avg(greatest(length, 1)) AS average FROM lens),
tf AS (SELECT region_id, term, count(*) AS tf FROM (SELECT region_id, unnest(t) AS term FROM toks) SEMI JOIN idf USING (term) GROUP BY ALL),
w AS (SELECT term, weight, idf * weight AS w FROM idf), allw AS (SELECT sum(w) AS all_w FROM w),
parts AS (SELECT region_id, sum(w * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(length, 1) / average)))) AS bm25, sum(w) AS covered, sum(CASE WHEN weight >= 2 THEN 6 * weight ELSE 0 END) AS code
  FROM tf JOIN w USING (term) JOIN lens USING (region_id), mean GROUP BY region_id),
cov AS (SELECT region_id, bm25, code, CASE WHEN all_w > 0 THEN covered / all_w ELSE 0 END AS coverage FROM parts, allw),
scored AS (SELECT region_id, round(bm25, 4) AS bm25, round(coverage, 4) AS coverage, round(bm25 + 7 * coverage + least(24.0, code) + CASE WHEN coverage >= 1 - 1e-12 THEN 2 ELSE 0 END, 4) AS score FROM cov)"""


def _path_sql(query: search.Query) -> str:
    """Path score and prior of ``path``."""
    base = "lower(parse_filename(path))"
    terms = " + ".join(f"CASE WHEN contains({base}, '{t}') THEN {2.5 * w} WHEN contains(lower(path), '{t}') THEN {1.25 * w} ELSE 0 END" for t in query.terms if (w := query.weights[t]) == 1 or w >= 1.25)
    priors = " + ".join(f"CASE WHEN regexp_matches('/' || lower(path), '{p}') THEN {v} ELSE 0 END" for p, v, words in search.PRIORS if "(?!" not in p and not (words and query.supplies(*words.split())))
    return f"({terms or '0'}) + ({priors})"


def oracle_sql() -> dict[str, str]:
    # variants of a search word, for texts of plain words: no lookaround in this dialect, so borders are marked first
    query = search.build_query(QUERY)
    focus = " + ".join(f"CASE WHEN contains(lower(l), '{t}') THEN {query.weights[t]} ELSE 0 END" for t in query.terms)
    priors = " + ".join(
        f"CASE WHEN regexp_matches('/' || lower(file_path), '{p}') THEN {v} ELSE 0 END"
        for p, v, _ in [(r"/\.github/" if "(?!" in p else p, 0.0 if "(?!" in p else v, w) for p, v, w in search.PRIORS]
    )
    test = r"""regexp_matches(file_path, '(?i)(^|/)(test|tests|__tests__|spec|specs|testdata)/') OR regexp_matches(lower(parse_filename(file_path)), '\.(test|spec)\.|_test\.(go|py)$|^test_.*\.py$|_spec\.rb$|^tests?\.rs$')
  OR regexp_matches(regexp_replace(parse_filename(file_path), '\.[^.]*$', ''), '(Test|Tests|TestCase)$')"""
    whole = "SELECT doc_id AS region_id, path, body FROM docs"
    lines = """SELECT doc_id || ':' || (k * 60 + 1) AS region_id, array_to_string(a[k * 60 + 1 : k * 60 + 80], chr(10)) AS body
  FROM (SELECT doc_id, a, unnest(range(0, greatest(0, ceil((len(a) - 80) / 60.0))::BIGINT + 1)) AS k FROM (SELECT doc_id, string_split(body, chr(10)) AS a FROM docs))"""
    return {
        "bm25_search": f"WITH {_bm25_sql(whole, TERM_TOKENS)} SELECT * FROM scored",
        "sparse_bm25": f"WITH {_bm25_sql(lines, SPARSE_TOKENS)} SELECT * FROM scored",
        "bm25_top": f"""WITH {_bm25_sql(whole, TERM_TOKENS)}, placed AS (SELECT region_id, path, round(score + {_path_sql(query)}, 4) AS score FROM scored JOIN regions USING (region_id))
SELECT region_id, path, score, row_number() OVER (ORDER BY score DESC, path, region_id)::INTEGER AS rank FROM placed QUALIFY rank <= 10""",
        "doc_frequency": f"WITH {_df()} SELECT term, df, n_docs, round(idf, 6) AS idf FROM idf",
        "sparse_chunks": f"""WITH {_FILES}, s AS (SELECT file_id, string_split(content, chr(10)) AS a FROM files),
k AS (SELECT file_id, a, len(a) AS n, unnest(range(0, greatest(0, ceil((len(a) - 80) / 60.0))::BIGINT + 1)) AS k FROM s)
SELECT file_id || ':' || (k * 60 + 1) AS region_id, k * 60 + 1 AS start_line, least(k * 60 + 80, n) AS end_line,
  substr(sha256(array_to_string(a[k * 60 + 1 : k * 60 + 80], chr(10))), 1, 16) AS chunk_hash FROM k""",
        "path_prior": f"SELECT file_path, ({priors})::DOUBLE AS prior, {test} AS is_test FROM (SELECT DISTINCT file_path FROM commit_files WHERE file_path IS NOT NULL AND NOT contains(lower(file_path), '.github'))",
        "focus_line": f"""WITH {_DOCS}, l AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS l, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS n FROM docs),
w AS (SELECT doc_id, n, round({focus}, 6) AS w FROM l) SELECT doc_id, n::INTEGER AS focus FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, n) = 1""",
        "rrf_fusion": """WITH c AS (SELECT repo_key, file_path, count(*) AS n, max(commit_seq) AS seq FROM commit_files WHERE repo_key IS NOT NULL AND file_path IS NOT NULL GROUP BY ALL),
sp AS (SELECT *, row_number() OVER (ORDER BY n DESC, file_path, repo_key) AS rank FROM c QUALIFY rank <= 500),
se AS (SELECT file_path, min(rank) AS fr FROM (SELECT *, row_number() OVER (ORDER BY seq DESC NULLS LAST, file_path, repo_key) AS rank FROM c QUALIFY rank <= 500) GROUP BY file_path)
SELECT repo_key || ':' || sp.file_path AS region_id, sp.file_path AS path, round(1.0 / (60 + rank) + coalesce(2.0 / (60 + fr), 0), 8) AS score FROM sp LEFT JOIN se USING (file_path)""",
        "token_counts": f"""WITH {_DOCS} SELECT doc_id, len(regexp_extract_all(body, '[A-Za-z0-9_./:+#-]+'))::INTEGER AS n_words,
len(list_distinct(regexp_extract_all(body, '[A-Za-z0-9_$]+')))::INTEGER AS n_identifiers FROM docs""",
        "minified_share": f"""WITH {_FILES}, l AS (SELECT file_id, content, unnest(string_split(content, chr(10))) AS l FROM files)
SELECT file_id, round(CASE WHEN strlen(any_value(content)) = 0 THEN 0.0 ELSE coalesce(sum(strlen(l)) FILTER (strlen(l) > 500), 0) / strlen(any_value(content)) END, 6) AS long_share FROM l GROUP BY file_id""",
        "body_hash_groups": f"WITH {_FILES} SELECT substr(sha256(trim(regexp_replace(content, '\\s+', ' ', 'g'))), 1, 16) AS body_hash, count(*) AS n_files FROM files GROUP BY 1 HAVING count(*) > 1",
        "dependents_count": f"""WITH {_FILES}, asked AS (SELECT DISTINCT endpoint_name AS name FROM endpoints WHERE endpoint_kind <> 'file' AND endpoint_name IS NOT NULL),
used AS (SELECT DISTINCT file_id, unnest(regexp_extract_all(content, '[A-Za-z0-9_$]+')) AS name FROM files)
SELECT asked.name, count(file_id) AS n_dependents FROM asked LEFT JOIN used ON used.name = asked.name AND asked.name <> '' GROUP BY asked.name""",
        "signature_overlap": """WITH r AS (SELECT entity_id, min(signature) AS a, max(signature) AS b FROM entity_snapshots WHERE entity_id IS NOT NULL AND signature IS NOT NULL GROUP BY entity_id),
w AS (SELECT entity_id, list_distinct(regexp_extract_all(a, '[A-Za-z0-9_]+')) AS a, list_distinct(regexp_extract_all(b, '[A-Za-z0-9_]+')) AS b FROM r),
u AS (SELECT *, len(list_intersect(a, b)) AS i, len(list_distinct(list_concat(a, b))) AS u FROM w)
SELECT entity_id, CASE WHEN u = 0 THEN 1.0 ELSE floor(i::DOUBLE / u * 100 + 0.5) / 100 END AS overlap FROM u""",
    }
