"""Problem 4: results per key although a few keys hold most rows.

The rows of a heavy key never meet in one task. Both inputs of the join are
first reduced to one compact state a key (partial aggregation happens before
the shuffle, so a key with a billion rows sends one state per map task), the
states are joined, and counts are multiplied instead of rows being repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def edge_sides(relations: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Each relation once from either end: endpoint_side, endpoint_id, relation, neighbor_id, confidence, and the columns ``more``.

    A null id or relation is no key and gives no row.
    """
    ends = F.inline(
        F.array(
            F.struct(F.lit("from").alias("endpoint_side"), F.col("from_id").alias("endpoint_id"), F.col("to_id").alias("neighbor_id")),
            F.struct(F.lit("to").alias("endpoint_side"), F.col("to_id").alias("endpoint_id"), F.col("from_id").alias("neighbor_id")),
        )
    )
    return relations.select("relation", "confidence", *more, ends).where("endpoint_id IS NOT NULL AND relation IS NOT NULL")


def edge_states(relations: DataFrame) -> DataFrame:
    """The compact state of every (endpoint_side, endpoint_id, relation).

    n_edges counts rows as delivered, n_scored those with a confidence;
    sum_confidence and max_confidence ignore null.
    """
    return (
        edge_sides(relations)
        .groupBy("endpoint_side", "endpoint_id", "relation")
        .agg(
            F.count(F.lit(1)).alias("n_edges"),
            F.count("confidence").alias("n_scored"),
            F.sum("confidence").alias("sum_confidence"),
            F.max("confidence").alias("max_confidence"),
        )
    )


def heavy_keys(relations: DataFrame, share: float = 0.01) -> DataFrame:
    """The keys that hold at least ``share`` of all rows of relations.

    Columns: endpoint_side, endpoint_id, relation, n_edges. An empty table has
    no heavy key.
    """
    total = relations.agg(F.count(F.lit(1)).alias("n_rows"))  # one row, from the Parquet footers
    return (
        edge_states(relations)
        .join(F.broadcast(total))
        .where((F.col("n_edges") > 0) & (F.col("n_edges") >= F.lit(share) * F.col("n_rows")))
        .select("endpoint_side", "endpoint_id", "relation", "n_edges")
    )


def endpoint_states(endpoints: DataFrame, shared: DataFrame) -> DataFrame:
    """One state an endpoint: how often it was delivered, and its kind and name."""
    columns = ["endpoint_id", "endpoint_name", "endpoint_kind"]
    both = endpoints.select(*columns).unionByName(shared.select(*columns)).where("endpoint_id IS NOT NULL")
    return both.groupBy("endpoint_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("endpoint_kind").alias("endpoint_kind"), F.min("endpoint_name").alias("endpoint_name")
    )


def join_rollup(relations: DataFrame, endpoints: DataFrame, shared: DataFrame) -> DataFrame:
    """Per endpoint kind and relation what ``relations JOIN endpoints`` would count, without that join.

    n_edges: relation rows; n_joined: rows of the plain join (edges times
    deliveries of the endpoint); mean_confidence: mean over the joined rows
    with a confidence. Ids without an endpoint row fall under kind null with
    n_joined 0.
    """
    states = edge_states(relations).join(endpoint_states(endpoints, shared), "endpoint_id", "left")
    times = F.coalesce(F.col("n_rows"), F.lit(0))
    return (
        states.groupBy("endpoint_side", "endpoint_kind", "relation")
        .agg(
            F.sum("n_edges").alias("n_edges"),
            F.sum(F.col("n_edges") * times).alias("n_joined"),
            F.sum(F.col("sum_confidence") * times).alias("_sum"),
            F.sum(F.col("n_scored") * times).alias("_n"),
        )
        .select("endpoint_side", "endpoint_kind", "relation", "n_edges", "n_joined", F.round(F.col("_sum") / F.nullif(F.col("_n"), F.lit(0)), 6).alias("mean_confidence"))
    )


def best_neighbors(relations: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` best distinct neighbours of every key, with the key's number of edges.

    Best: greatest confidence (null last), then most edges, then id. Equal
    edges are merged once for both ends, by partial aggregation. Of a key each
    task passes on its own ``k`` best (a group limit before the shuffle), so
    no task sees all neighbours of a heavy key.
    """
    key = ["endpoint_side", "endpoint_id", "relation"]
    edges = relations.where("relation IS NOT NULL").groupBy("from_id", "to_id", "relation").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"))
    merged = edge_sides(edges, ["n"])
    counts = merged.groupBy(*key).agg(F.sum("n").alias("n_edges"))
    order = [F.col("confidence").desc_nulls_last(), F.col("n").desc(), F.col("neighbor_id").asc_nulls_last()]
    top = merged.where("neighbor_id IS NOT NULL").withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)
    return top.join(counts, key).select(*key, "n_edges", "rank", "neighbor_id", F.col("n").alias("neighbor_edges"), "confidence")
