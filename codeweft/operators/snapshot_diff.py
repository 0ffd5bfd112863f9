"""Problem 1: what changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeweft.tables import collapse_blanks, cut, small


def except_all_both(base: DataFrame, head: DataFrame, columns: list[str]) -> DataFrame:
    """``head EXCEPT ALL base`` and ``base EXCEPT ALL head`` in one aggregation.

    Both set differences need the multiplicity of every row on either side, so
    one signed count gives both: the result has ``columns`` and ``surplus``,
    positive for rows that head has more often, negative for base. Rows that
    are identical on both sides vanish before anything is joined. Nulls count
    as equal, as in EXCEPT ALL.
    """
    return surplus(head.select(*columns, F.lit(1).alias("side")).unionByName(base.select(*columns, F.lit(-1).alias("side"))), columns)


def surplus(sides: DataFrame, columns: list[str]) -> DataFrame:
    """Both EXCEPT ALL differences of rows whose ``side`` is 1 (head) or -1 (base): columns, surplus."""
    return sides.groupBy(*columns).agg(F.sum("side").alias("surplus")).where(F.col("surplus") != 0)


def latest_rows(rows: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """One row a key: that of the greatest ``at``; among equal ones the greatest ``values``.

    ``max(struct)`` combines on the map side, so a key repeated very often costs
    no more than any other.
    """
    best = F.max(F.struct(at, *values)).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{v}").alias(v) for v in values])


def consecutive_snapshots(index: DataFrame, arrived: DataFrame) -> DataFrame:
    """(repo_key, base_commit, head_commit) of neighbours by taken_at among snapshots with rows.

    A commit announced repeatedly counts once, with the values of its last
    delivery; one without taken_at has no place in the order and is left out.
    """
    named = latest_rows(
        index.where("repo_key IS NOT NULL AND commit_id IS NOT NULL AND taken_at IS NOT NULL"), ["repo_key", "commit_id"], "delivered_at", ["taken_at"]
    )
    order = Window.partitionBy("repo_key").orderBy("taken_at", "commit_id")
    return (
        named.join(arrived, ["repo_key", "commit_id"], "left_semi")
        .withColumn("head_commit", F.lead("commit_id").over(order))
        .where("head_commit IS NOT NULL")
        .select("repo_key", F.col("commit_id").alias("base_commit"), "head_commit")
    )


def _id_hashes(value: str) -> list[Column]:
    """128 bits that stand for an id, as two numbers."""
    return [F.xxhash64(value).alias("e1"), F.xxhash64(F.lit(1), value).alias("e2")]


def snapshot_changes(rows: DataFrame, index: DataFrame, signature: Column | None = None, body: Column | None = None) -> DataFrame:
    """Entity changes between each two consecutive snapshots of a repository.

    Result: repo_key, base_commit, head_commit, entity_id, change_kind with
    change_kind in added, removed, signature_changed, body_changed. Signatures
    are compared with blanks collapsed, body hashes without letter case; null
    equals null and differs from any value. Of several rows of an entity in a
    snapshot that of the last delivered_at holds, of those the greatest
    signature and body. Rows without repo_key, commit_id or entity_id identify
    nothing and are ignored; an empty table gives no rows; columns beyond those
    named are never read.

    Pairs of snapshots are numbered, and what is compared travels as hashes
    (128 bits of the id, 64 of signature and body hash each), so a row costs
    40 bytes whatever its texts; ids come back only for what changed.
    """
    signature = collapse_blanks(F.col("signature")) if signature is None else signature
    body = F.lower(F.col("body_hash")) if body is None else body
    known = rows.where("repo_key IS NOT NULL AND commit_id IS NOT NULL AND entity_id IS NOT NULL").select("repo_key", "commit_id", "entity_id", "delivered_at", signature.alias("sig"), body.alias("body"))
    pairs = cut(consecutive_snapshots(index, known.select("repo_key", "commit_id").distinct()).withColumn("pair", F.monotonically_increasing_id()))
    # each snapshot is head of one pair and base of the next
    none = F.lit(None).cast("bigint")
    roles = pairs.select("repo_key", F.col("base_commit").alias("commit_id"), F.col("pair").alias("as_base"), none.alias("as_head")).unionByName(
        pairs.select("repo_key", F.col("head_commit").alias("commit_id"), none.alias("as_base"), F.col("pair").alias("as_head"))
    )
    roles = roles.groupBy("repo_key", "commit_id").agg(F.max("as_base").alias("as_base"), F.max("as_head").alias("as_head"))
    roles = cut(roles.withColumn("snapshot", F.coalesce(F.col("as_base") * 2, F.col("as_head") * 2 + 1)))
    placed = known.join(small(roles), ["repo_key", "commit_id"]).select("snapshot", *_id_hashes("entity_id"), "delivered_at", "sig", "body")
    current = latest_rows(placed, ["snapshot", "e1", "e2"], "delivered_at", ["sig", "body"]).join(small(roles.select("snapshot", "as_base", "as_head")), "snapshot")
    both = F.explode(F.array(F.struct(F.col("as_base").alias("pair"), F.lit(-1).alias("side")), F.struct(F.col("as_head").alias("pair"), F.lit(1).alias("side"))))
    sides = current.select(both.alias("r"), "e1", "e2", F.xxhash64("sig").alias("s"), F.xxhash64("body").alias("b")).select("r.*", "e1", "e2", "s", "b").where("pair IS NOT NULL")
    key = ["pair", "e1", "e2"]
    residue = cut(surplus(sides, [*key, "s", "b"]))
    gone = residue.where("surplus < 0").select(*key, F.struct("s", "b").alias("was"))
    come = residue.where("surplus > 0").select(*key, F.struct("s", "b").alias("now"))
    changes = gone.join(come, key, "full").select(
        *key,
        F.when(F.col("was").isNull(), "added")
        .when(F.col("now").isNull(), "removed")
        .when(F.col("was.s") != F.col("now.s"), "signature_changed")
        .otherwise("body_changed")
        .alias("change_kind"),
    )
    asked = residue.select("e1", "e2")
    names = known.select(*_id_hashes("entity_id"), "entity_id").join(small(asked), ["e1", "e2"], "left_semi").distinct()
    return changes.join(small(pairs), "pair").join(names, ["e1", "e2"]).select("repo_key", "base_commit", "head_commit", "entity_id", "change_kind")


def change_report(changes: DataFrame) -> DataFrame:
    """Number of changes by pair of snapshots and kind."""
    return changes.groupBy("repo_key", "base_commit", "head_commit", "change_kind").agg(F.count(F.lit(1)).alias("n_entities"))
