"""Queries of the general problems 1 and 4, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeweft.operators import heavy_keys, snapshot_diff
from codeweft.tables import table


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_diff.snapshot_changes(table(spark, sf_dir, "entity_snapshots"), table(spark, sf_dir, "snapshot_index"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities added, removed or changed between consecutive snapshots."""
    return _changes(spark, sf_dir)


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of changes by pair of snapshots and kind."""
    return snapshot_diff.change_report(_changes(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that hold at least a hundredth of all relations."""
    return heavy_keys.heavy_keys(table(spark, sf_dir, "relations")).select("endpoint_side", "endpoint_id", "relation")


def p4_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key's edges and best neighbours."""
    return heavy_keys.best_neighbors(table(spark, sf_dir, "relations"))


def p4_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges and joined rows by endpoint kind and relation, from joined states."""
    return heavy_keys.join_rollup(table(spark, sf_dir, "relations"), table(spark, sf_dir, "endpoints"), table(spark, sf_dir, "shared_endpoints"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_report, p4_found, p4_neighbors, p4_rollup)}


_CHANGES = r"""
WITH named AS (
  SELECT repo_key, commit_id, taken_at FROM snapshot_index
  WHERE repo_key IS NOT NULL AND commit_id IS NOT NULL AND taken_at IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY repo_key, commit_id ORDER BY delivered_at DESC NULLS LAST, taken_at DESC) = 1),
arrived AS (SELECT DISTINCT repo_key, commit_id FROM entity_snapshots WHERE entity_id IS NOT NULL),
pairs AS (
  SELECT repo_key, commit_id AS base_commit, lead(commit_id) OVER (PARTITION BY repo_key ORDER BY taken_at, commit_id) AS head_commit
  FROM named SEMI JOIN arrived USING (repo_key, commit_id) QUALIFY head_commit IS NOT NULL),
cur AS (
  SELECT repo_key, commit_id, entity_id, trim(regexp_replace(signature, '\s+', ' ', 'g')) AS sig, lower(body_hash) AS body
  FROM entity_snapshots WHERE repo_key IS NOT NULL AND commit_id IS NOT NULL AND entity_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY repo_key, commit_id, entity_id ORDER BY delivered_at DESC NULLS LAST, sig DESC NULLS LAST, body DESC NULLS LAST) = 1),
b AS (SELECT pairs.*, entity_id, sig, body FROM pairs JOIN cur ON cur.repo_key = pairs.repo_key AND cur.commit_id = base_commit),
h AS (SELECT pairs.*, entity_id, sig, body FROM pairs JOIN cur ON cur.repo_key = pairs.repo_key AND cur.commit_id = head_commit),
changes AS (
  SELECT coalesce(h.repo_key, b.repo_key) AS repo_key, coalesce(h.base_commit, b.base_commit) AS base_commit,
    coalesce(h.head_commit, b.head_commit) AS head_commit, coalesce(h.entity_id, b.entity_id) AS entity_id,
    CASE WHEN b.entity_id IS NULL THEN 'added' WHEN h.entity_id IS NULL THEN 'removed'
      WHEN b.sig IS DISTINCT FROM h.sig THEN 'signature_changed' ELSE 'body_changed' END AS change_kind
  FROM b FULL JOIN h ON b.repo_key = h.repo_key AND b.base_commit = h.base_commit AND b.head_commit = h.head_commit AND b.entity_id = h.entity_id
  WHERE b.entity_id IS NULL OR h.entity_id IS NULL OR b.sig IS DISTINCT FROM h.sig OR b.body IS DISTINCT FROM h.body)
"""

_SIDES = """
WITH side AS (
  SELECT 'from' AS endpoint_side, from_id AS endpoint_id, relation, to_id AS neighbor_id, confidence FROM relations WHERE from_id IS NOT NULL AND relation IS NOT NULL
  UNION ALL
  SELECT 'to', to_id, relation, from_id, confidence FROM relations WHERE to_id IS NOT NULL AND relation IS NOT NULL)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _CHANGES + "SELECT * FROM changes",
        "p1_report": _CHANGES + "SELECT repo_key, base_commit, head_commit, change_kind, count(*) AS n_entities FROM changes GROUP BY ALL",
        "p4_found": _SIDES + "SELECT endpoint_side, endpoint_id, relation FROM side GROUP BY ALL HAVING 100 * count(*) >= (SELECT count(*) FROM relations)",
        "p4_neighbors": _SIDES
        + """, merged AS (SELECT endpoint_side, endpoint_id, relation, neighbor_id, count(*) AS n, max(confidence) AS confidence FROM side GROUP BY ALL),
total AS (SELECT endpoint_side, endpoint_id, relation, sum(n)::BIGINT AS n_edges FROM merged GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY endpoint_side, endpoint_id, relation ORDER BY confidence DESC NULLS LAST, n DESC, neighbor_id) AS rank
  FROM merged WHERE neighbor_id IS NOT NULL)
SELECT endpoint_side, endpoint_id, relation, n_edges, rank::INTEGER AS rank, neighbor_id, n AS neighbor_edges, confidence
FROM ranked JOIN total USING (endpoint_side, endpoint_id, relation) WHERE rank <= 3""",
        "p4_rollup": _SIDES
        + """, ep AS (SELECT endpoint_id, endpoint_kind FROM endpoints WHERE endpoint_id IS NOT NULL UNION ALL SELECT endpoint_id, endpoint_kind FROM shared_endpoints WHERE endpoint_id IS NOT NULL),
kind AS (SELECT endpoint_id, min(endpoint_kind) AS endpoint_kind, count(*) AS m FROM ep GROUP BY ALL)
SELECT endpoint_side, endpoint_kind, relation, count(*)::BIGINT AS n_edges, sum(coalesce(m, 0))::BIGINT AS n_joined,
  round(sum(confidence * coalesce(m, 0)) / nullif(sum(CASE WHEN confidence IS NOT NULL THEN coalesce(m, 0) ELSE 0 END), 0), 6) AS mean_confidence
FROM side LEFT JOIN kind USING (endpoint_id) GROUP BY ALL""",
    }
