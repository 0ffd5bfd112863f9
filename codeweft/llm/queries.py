"""Queries over the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm import cooccur, handwritten, leakage, mixing, residue, syntax
from codeweft.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files that aren't valid syntax."""
    return syntax.parse_status(table(spark, sf_dir, "source_files")).select("file_id")


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of broken files by repository and language."""
    files = table(spark, sf_dir, "source_files")
    return syntax.broken_rates(files, syntax.parse_status(files))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files nobody of the project wrote by hand."""
    return handwritten.not_handwritten(table(spark, sf_dir, "source_files")).select("file_id")


def p3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Such files by rule."""
    return handwritten.not_handwritten(table(spark, sf_dir, "source_files")).groupBy("rule").agg(F.count(F.lit(1)).alias("n_files"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File pairs that change together clearly more often than chance."""
    pairs = cooccur.strong_pairs(cooccur.cochange(table(spark, sf_dir, "commit_files")))
    return pairs.select(F.col("space").alias("repo_key"), F.col("left_item").alias("left_path"), F.col("right_item").alias("right_path"))


def p5_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All file pairs with their counts, lift and log-likelihood ratio."""
    pairs = cooccur.cochange(table(spark, sf_dir, "commit_files"))
    return pairs.select(
        F.col("space").alias("repo_key"), F.col("left_item").alias("left_path"), F.col("right_item").alias("right_path"), "n_both", "n_left", "n_right", "n_baskets",
        F.round("lift", 4).alias("lift"), F.round("llr", 4).alias("llr"),
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least 12 consecutive words of an evaluation passage."""
    leaks = leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return leaks.select("doc_id", "item_id")


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items with the number of documents and the longest run."""
    return leakage.leak_report(leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document enters the mix."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares the mix reaches."""
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.mix_report(mixing.mix(table(spark, sf_dir, "documents"), targets), targets)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with template residue, filler, empty forms, error pages or script notices."""
    return residue.residue_documents(table(spark, sf_dir, "documents")).select("doc_id")


def p8_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Such documents by kind."""
    return residue.residue_documents(table(spark, sf_dir, "documents")).groupBy("label").agg(F.count(F.lit(1)).alias("n_docs"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p2_found, p2_rates, p3_found, p3_rules, p5_found, p5_ranked, p6_found, p6_report, p7_mix, p7_report, p8_found, p8_kinds)
    return {f.__name__: f for f in own}


_PATHS = """
WITH member AS (
  SELECT DISTINCT repo_key, commit_id, regexp_replace(regexp_replace(file_path, '/+', '/', 'g'), '^(\\./|/)+', '') AS path
  FROM commit_files WHERE repo_key IS NOT NULL AND commit_id IS NOT NULL AND file_path IS NOT NULL),
named AS (SELECT * FROM member WHERE path <> ''),
fits AS (SELECT repo_key, commit_id FROM named GROUP BY ALL HAVING count(*) <= 50),
kept AS (SELECT named.* FROM named SEMI JOIN fits USING (repo_key, commit_id)),
single AS (SELECT repo_key, path, count(*) AS k FROM kept GROUP BY ALL),
total AS (SELECT repo_key, count(*) AS n FROM fits GROUP BY ALL),
pair AS (
  SELECT a.repo_key, a.path AS left_path, b.path AS right_path, count(*) AS c
  FROM kept a JOIN kept b ON a.repo_key = b.repo_key AND a.commit_id = b.commit_id AND a.path < b.path GROUP BY ALL),
counted AS (
  SELECT pair.*, l.k AS a, r.k AS b, n FROM pair
  JOIN single l ON l.repo_key = pair.repo_key AND l.path = left_path
  JOIN single r ON r.repo_key = pair.repo_key AND r.path = right_path
  JOIN total ON total.repo_key = pair.repo_key)
"""


def oracle_sql() -> dict[str, str]:
    words = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
    leaks = f"""
WITH d AS (SELECT doc_id, string_split({words.format('text')}, ' ') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, string_split({words.format('passage')}, ' ') AS w FROM eval_items WHERE passage IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)"""
    return {
        "p5_found": _PATHS + "SELECT repo_key, left_path, right_path FROM counted WHERE c >= 5 AND c * n >= 4 * a * b",
        "p5_ranked": _PATHS
        + """, wide AS (SELECT repo_key, left_path, right_path, c AS n_both, a AS n_left, b AS n_right, n AS n_baskets, c::DOUBLE AS c, a::DOUBLE AS a, b::DOUBLE AS b, n::DOUBLE AS n FROM counted),
g AS (SELECT *, 2 * (c * ln(c / (a * b / n)) + CASE WHEN a > c THEN (a - c) * ln((a - c) / (a * (n - b) / n)) ELSE 0 END
  + CASE WHEN b > c THEN (b - c) * ln((b - c) / ((n - a) * b / n)) ELSE 0 END + CASE WHEN n - a - b + c > 0 THEN (n - a - b + c) * ln((n - a - b + c) / ((n - a) * (n - b) / n)) ELSE 0 END) AS g2 FROM wide)
SELECT repo_key, left_path, right_path, n_both, n_left, n_right, n_baskets, round(c * n / (a * b), 4) AS lift,
  round(CASE WHEN c * n < a * b THEN -1 ELSE 1 END * greatest(g2, 0), 4) + 0.0 AS llr FROM g""",
        "p6_found": leaks,
        "p6_report": f"""
WITH d AS (SELECT doc_id, string_split({words.format('text')}, ' ') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT DISTINCT item_id, string_split({words.format('passage')}, ' ') AS w FROM eval_items WHERE passage IS NOT NULL),
dg AS (SELECT doc_id, k AS dk, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)),
ig AS (SELECT item_id, k AS ik, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12)),
m AS (SELECT doc_id, item_id, dk - ik AS diagonal, dk, dk - row_number() OVER (PARTITION BY doc_id, item_id, dk - ik ORDER BY dk) AS island FROM dg JOIN ig USING (g)),
runs AS (SELECT doc_id, item_id, count(*) + 11 AS run FROM m GROUP BY doc_id, item_id, diagonal, island)
SELECT item_id, count(DISTINCT doc_id) AS n_docs, max(run)::INTEGER AS run_words FROM runs GROUP BY item_id""",
    }
